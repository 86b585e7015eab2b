import hashlib
import math
from collections import Counter

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tamarack.llm import common, mixing

from .conftest import ODD, prose


def unit(*parts):
    return (int(hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def md5(text):
    return hashlib.md5((text or "").encode()).hexdigest()


def poisson(mean, u):
    k, p = 0, math.exp(-mean)
    total = p
    while total < u and k < 1000:
        k += 1
        p *= mean / k
        total += p
    return k


def brute(rows, weights=None, scale=1.0):
    """Copies of each row by the definition."""
    size = Counter()
    for _, text, source in rows:
        size[source] += len((text or "").encode()) + 1
    weight = {s: math.sqrt(b) if weights is None else weights.get(s, 0.0) for s, b in size.items()}
    whole = sum(weight.values())
    found = Counter()
    for doc_id, text, source in rows:
        rate = weight[source] * scale * sum(size.values()) / whole / size[source] if whole else 0
        parts = max(1, math.ceil(rate / mixing.LARGEST_PART))
        n = sum(poisson(rate / parts, unit("copies-20", doc_id, md5(text), part)) for part in range(1, parts + 1))
        found.update({(doc_id, text, source, copy): 1 for copy in range(1, n + 1)})
    return found


def got(df):
    return Counter((r.doc_id, r.text, r.source, r.copy) for r in df.collect())


def test_odd_rows(odd):
    rows = [(r[0], r[1], r[3] if len(r) > 3 else "s0") for r in ODD]
    mixed = mixing.mix_sources(odd)
    assert got(mixed) == brute(rows)
    positions = [r.position for r in mixed.collect()]
    assert sorted(positions) == list(range(len(positions)))
    assert mixing.mix_sources(odd, numbered=False).columns == odd.columns


def test_empty(none):
    assert mixing.mix_sources(none).collect() == []
    assert mixing.mix_sources(none).columns == [*none.columns, "copy", "position"]


@pytest.mark.parametrize("coarse", [1, 3])
def test_weights_scale_and_large_rates(docs, monkeypatch, coarse):
    monkeypatch.setattr(mixing, "BYTES_PER_BUCKET", 30)
    monkeypatch.setattr(common, "COARSE_DIGITS", coarse)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0 if coarse == 1 else 100)
    rows = [(i, prose(i, 4), f"s{i % 3}") for i in range(40)] + [(1000, "x", "tiny")]
    df = docs([(a, b, "en", c) for a, b, c in rows])
    weights = {"s0": 2.0, "s1": 1.0, "tiny": 1.0}
    mixed = mixing.mix_sources(df, weights, scale=3.0)
    assert got(mixed) == brute(rows, weights, 3.0)
    assert {r.source for r in mixed.collect()} <= {"s0", "s1", "tiny"}
    found = sorted(mixed.collect(), key=lambda r: r.position)
    keys = [hashlib.md5(f"order-20:{r.doc_id}:{md5(r.text)}:{r.copy}".encode()).hexdigest() for r in found]
    assert keys == sorted(keys)
    assert mixing.mix_sources(df, {}).collect() == []


def test_shares_follow_the_weights(docs):
    df = docs([(i, prose(i, 6), "en", "big" if i % 10 else "small") for i in range(3000)])
    sizes = Counter()
    for r in mixing.mix_sources(df, {"big": 1.0, "small": 1.0}).collect():
        sizes[r.source] += len(r.text) + 1
    assert abs(sizes["big"] / sum(sizes.values()) - 0.5) < 0.05


def test_no_python_in_the_plan(odd):
    plan = mixing.mix_sources(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("mix", [lambda df: corpus_pipeline.mix(df.sparkSession, df, ""), mixing.mix_sources])
def test_null_and_repeated_ids_are_drawn_by_their_texts(docs, mix):
    df = docs([(None, prose(i, 5)) for i in range(400)] + [(7, prose(1000 + i, 5)) for i in range(400)])
    mixed = mix(df).collect()
    for doc_id in (None, 7):
        copies = Counter(r.text for r in mixed if r.doc_id == doc_id)
        assert 340 <= sum(copies.values()) <= 460 and 200 <= len(copies) <= 300 and max(copies.values()) >= 3


def test_unnumbered_rows_are_written_in_random_order(docs, tmp_path):
    df = docs([(i, prose(i, 5)) for i in range(500)]).coalesce(1)
    mixing.mix_sources(df, scale=4.0, numbered=False).write.parquet(str(tmp_path / "mixed"))
    total = side_by_side = rising = 0
    for file in sorted((tmp_path / "mixed").glob("*.parquet")):
        ids = pq.read_table(file)["doc_id"].to_pylist()
        total += len(ids)
        side_by_side += sum(a == b for a, b in zip(ids, ids[1:], strict=False))
        rising += sum(a < b for a, b in zip(ids, ids[1:], strict=False))
    assert 1800 < total < 2200 and side_by_side < 30 and 0.44 * total < rising < 0.56 * total


def test_unnumbered_rows_are_those_of_the_numbered_mixture_in_its_order(docs):
    df = docs([(i, prose(i, 5)) for i in range(300)]).coalesce(1)
    place = {}
    for r in mixing.mix_sources(df, scale=0.5).collect():
        place.setdefault(r.doc_id, []).append(r.position)
    parts = mixing.mix_sources(df, scale=0.5, numbered=False).rdd.glom().collect()
    assert Counter(r.doc_id for p in parts for r in p) == {i: len(n) for i, n in place.items()}
    for p in parts:
        held = [place[r.doc_id][0] for r in p if len(place[r.doc_id]) == 1]
        assert held == sorted(held)
