"""From raw documents to packed training sequences, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm import common, exact_dedup, langid, mixing, packing, simhash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letters, or a score below the calibrated least."""
    return langid.keep_identified(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, that with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of edited copies, that with the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources' bytes follow the square root of what they have, in random order."""
    return mixing.mix_sources(docs, numbered=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's pieces in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", dedup_exact),
    ("SimHash near-dedup", dedup_near),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: No SQL: subword embeddings, fingerprints and tokens have no SQL form. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each one's result is written to the shared folder and read by the next.

    What a stage read is removed once its own result is written.
    """
    docs, read = common.documents(spark, sf_dir), None
    for number, (_, stage) in enumerate(STAGES[:-1]):
        written = common.scratch(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(written)
        if read:
            common.remove(spark, read)
        docs, read = spark.read.parquet(written), written
    return STAGES[-1][1](spark, docs, sf_dir)
