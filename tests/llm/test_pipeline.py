"""The stages in a row, against the operators' brute-force rules."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tamarack.llm import packing
from tamarack.llm.queries import ORACLES, QUERIES

from .test_exact_dedup import lowered as ascii_lowered
from .test_langid import text as language_text
from .test_packing import check
from .test_simhash import brute_near

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, docs, tmp_path):
    rows = [(i, language_text(lang := ("en", "de", "fr")[i % 3], i), lang, f"s{i % 2}") for i in range(150)]
    rows += [(200 + i, rows[i][1].upper(), "en", "s0") for i in range(10)] + [(300, "123 456", "en", "s0"), (301, None, None, None), (5, rows[5][1], "fr", "s1")]
    df = docs(rows, extra=True)
    after = [("documents", df)]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, "")
        out.write.parquet(str(tmp_path / str(n)))
        df = spark.read.parquet(str(tmp_path / str(n)))
        after.append((name, df))
    for name, df in after[1:-1]:
        assert df.columns == after[0][1].columns, name
    ids = [Counter(r.doc_id for r in df.collect()) for _, df in after]
    assert set(ids[0]) - set(ids[1]) >= {300, 301} and len(ids[1]) >= 158
    held = sorted(after[1][1].collect(), key=lambda r: r.doc_id)
    lowered = {}
    for r in held:
        lowered[ascii_lowered(r.text)] = max(r.doc_id, lowered.get(ascii_lowered(r.text), -1))
    assert ids[2] == Counter(lowered.values())
    rows2 = sorted(after[2][1].collect(), key=lambda r: r.doc_id)
    label = brute_near([r.text for r in rows2])
    assert ids[3] == Counter({rows2[i].doc_id: 1 for i in set(label)})
    assert set(ids[4]) <= set(ids[3]) and sum(ids[4].values()) > 50
    texts = {}
    for r in after[4][1].collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    check(after[5][1].collect(), texts)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    used = {r.sequence_id for r in rows}
    assert used == set(range(len(used))) and max(r.offset + r.length for r in rows) <= packing.CAPACITY


def test_empty(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_duckdb(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    df = QUERIES[name](spark, SMALL)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    at = [columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs_over_the_whole_table(spark, name):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    rows = QUERIES[name](spark, SMALL).count()
    assert rows == n if name.split("_")[0] in ("op1", "op3", "op4", "op7", "op8", "op9", "op10") else rows > 0
