import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from tamarack.llm import common, sharding

from .conftest import ODD, prose


def test_odd_rows(odd):
    rows = sharding.shard_documents(odd, 16).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ODD if i is not None
    )
    assert len(rows) == len(ODD)
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.shard, r.grown_shard))
        assert r.region == r.shard // 8 and r.rack == r.shard // 4
    assert all(len(x) == 1 for x in by_id.values())


def test_empty(none):
    assert sharding.shard_documents(none, 16).collect() == []


@pytest.mark.parametrize("coarse", [1, 3])
def test_slots_are_gapless_also_over_many_buckets(spark, docs, monkeypatch, coarse):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 2)
    monkeypatch.setattr(common, "COARSE_DIGITS", coarse)
    rows = sharding.shard_documents(docs([(i, prose(i % 50, 5)) for i in range(400)] * 2), 5).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 5


@pytest.mark.parametrize("shards", range(1, 20))
def test_one_more_shard_takes_rows_only_into_itself(spark, docs, shards):
    rows = sharding.shard_documents(docs([(i, "x") for i in range(200)]), shards).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert all(r.grown_shard == shards for r in moved) and moved


def placed(spark, n, tree):
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    return {r.doc_id: r.place for r in sharding.placed(ids, "doc_id", tree, "place").collect()}


def test_weights(spark):
    count = Counter(p.shard for p in placed(spark, 20000, sharding.layout(6, [1, 2, 3, 0, 1, 3])).values())
    assert 3 not in count and all(abs(count[s] / 2000 - w) < 0.2 for s, w in enumerate([1, 2, 3, 0, 1, 3]))


@pytest.mark.parametrize("shards", [1, 5, 8, 11, 16, 17, 23])
def test_shares_are_equal_also_where_a_region_is_part_full(spark, shards):
    count = Counter(p.shard for p in placed(spark, 2000 * shards, sharding.layout(shards)).values())
    assert set(count) == set(range(shards)) and all(abs(n - 2000) < 220 for n in count.values())


def unit(name, doc_id):
    return (int(hashlib.md5(f"{name}:{doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def descended(doc_id, weights):
    """One level at a time, by the definition; the tree is full."""

    def least(kind, numbers, weigh):
        return min((-math.log(unit(f"{kind}-0-{n}", doc_id)) / weigh(n), n) for n in numbers if weigh(n))[1]

    region = least("region", range(len(weights) // 8), lambda n: sum(weights[n * 8 : n * 8 + 8]))
    rack = least("rack", range(region * 2, region * 2 + 2), lambda n: sum(weights[n * 4 : n * 4 + 4]))
    return region, rack, least("shard", range(rack * 4, rack * 4 + 4), lambda n: weights[n])


def test_levels_are_descended(spark):
    for weights in ([1.0] * 16, [float(i % 3) for i in range(24)]):
        found = placed(spark, 500, sharding.layout(len(weights), weights))
        assert all((p.region, p.rack, p.shard) == descended(i, weights) for i, p in found.items())


def test_moves_stay_in_the_subtrees_whose_weight_changes(spark):
    before, after = sharding.layout(24), sharding.layout(24, [1.0] * 9 + [3.0] + [1.0] * 14)
    a, b = placed(spark, 6000, before), placed(spark, 6000, after)
    moved = [(a[i], b[i]) for i in a if a[i] != b[i]]
    assert moved and all(1 in (x.region, y.region) for x, y in moved)
    for x, y in moved:
        assert y.region == 1  # its weight grew: nothing leaves the region
        if x.region == 1:
            assert y.rack == 2 and (x.rack != 2 or y.shard == 9)
    same = Counter(x.region for x, _ in moved)
    assert set(same) == {0, 1, 2} and all(y.shard == 9 or x.region != 1 or x.rack != y.rack for x, y in moved)


def test_wrong_weights(spark, docs):
    with pytest.raises(ValueError):
        sharding.layout(3, [1.0])
    with pytest.raises(ValueError):
        placed(spark, 1, sharding.layout(2, [0.0, 0.0]))
