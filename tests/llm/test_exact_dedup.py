import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tamarack.llm import common, exact_dedup

from .conftest import ODD


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, keep=max):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    found = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = keep(known) if known else None
        first = True
        for i in ids:
            found.append((i, best, len(ids), i == best and first, hashlib.sha256(text.encode()).hexdigest()))
            first = first and i != best
    return sorted(found, key=repr)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.sha.hex()) for r in df.collect()), key=repr)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("bits", [256, 4])
@pytest.mark.parametrize("fan", [1, 8])
def test_odd_rows_and_colliding_digests(odd, keep, bits, fan, monkeypatch):
    """With four bits digests of other texts are equal, and only the verification tells them apart."""
    monkeypatch.setattr(exact_dedup, "FAN", fan)
    assert result(exact_dedup.exact_groups(odd, keep=keep, bits=bits)) == brute(ODD, max if keep == "largest" else min)


def test_empty(none):
    assert exact_dedup.exact_groups(none).collect() == []
    assert exact_dedup.drop_exact_copies(none).collect() == []


@pytest.mark.parametrize("bits", [64, 1 << 27])
def test_kept_rows_have_all_columns(odd, bits, monkeypatch):
    """A filter of 64 bits marks rows that aren't among its keys."""
    monkeypatch.setattr(common, "FILTER_BLOCK", min(bits, 1 << 15))
    monkeypatch.setattr(common, "FILTER_MOST_BITS", bits)
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns
    texts = sorted(lowered(r.text) for r in kept.collect())
    assert texts == sorted({lowered(r[1]) for r in ODD})


def test_a_hot_group(docs):
    rows = [(i, "Same Text") for i in range(300)] + [(1000 + i, f"other {i}") for i in range(50)]
    assert result(exact_dedup.exact_groups(docs(rows).repartition(8))) == brute(rows)


def test_levels_and_filters(spark, docs):
    index = exact_dedup.DigestIndex(spark, common.scratch(spark, "test"))
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    index.flush(docs(rows[:600]).repartition(25))
    index.flush(docs(rows[600:]).repartition(15))
    merged = index.compact()
    assert index.levels == [40, 5, 1] and merged.count() == 700 and index.hits().count() == 300
    marked = index.hit_filter().mark(index.runs(), F.xxhash64("digest"), "asked").groupBy("asked").count().collect()
    asked = next(r["count"] for r in marked if r.asked)
    assert 600 <= asked < 640  # all rows of the hits, and few others


@pytest.mark.parametrize("bits", [64, 1 << 15, 1 << 22])
def test_a_filter_marks_its_keys(spark, bits, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BLOCK", min(bits, 1 << 15))
    monkeypatch.setattr(common, "FILTER_MOST_BITS", bits)
    keys = spark.range(0, 2000, 2).select(F.xxhash64("id").alias("h"))
    found = common.KeyFilter(keys).mark(spark.range(2000), F.xxhash64("id"), "held").where("held").collect()
    held = {r.id for r in found}
    assert held >= set(range(0, 2000, 2)) and len(found) == len(held)
    assert len(held) < 1000 + {64: 1001, 1 << 15: 60, 1 << 22: 60}[bits]
    assert common.KeyFilter(keys.where("false")).mark(spark.range(9), F.xxhash64("id"), "held").where("held").collect() == []


def test_index_grows_by_batches(spark, docs):
    index = exact_dedup.DigestIndex(spark, common.scratch(spark, "test"), keep="smallest")
    index.flush(docs([(5, "a"), (6, "b")]))
    index.flush(docs([(3, "A"), (9, "c"), (9, "c")]))
    merged = {r.keep_id: r.n for r in index.compact().collect()}
    assert merged == {3: 2, 6: 1, 9: 2}
    found = index.lookup(docs([(100, "B"), (101, "new")], extra=False))
    assert sorted((r.doc_id, r.keep_id) for r in found.collect()) == [(100, 6), (101, None)]


def test_no_python_in_the_plan(odd):
    for df in (exact_dedup.exact_groups(odd), exact_dedup.drop_exact_copies(odd)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_a_column_is_missing(spark):
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(spark.range(3))
