"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source has a mean repetition rate: its target share of the bytes over its present share. A document's
number of copies is a Poisson number with that mean, got by inverting the distribution at a uniform number
hashed from its identifier and a digest of its text. Copies are exploded and put in one global random order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 20
#: Target weights, where none are given, are the sources' bytes to this power.
SMOOTHING = 0.5
#: Bytes that one task of the global order holds.
BYTES_PER_BUCKET = 32 << 20
#: The rates of up to so many sources are broadcast (at most 1.1 kB each, 11 MB); beyond, Spark joins by shuffles.
BROADCAST_SOURCES = 10_000
#: A Poisson number of a larger mean is a sum of several with at most this one.
LARGEST_PART = 32.0


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, scale: float = 1.0, text: str = "text") -> DataFrame:
    """For each source (null is one): source, rows, bytes, rate. All rows count, in one aggregation.

    weights gives shares of the output's bytes, in any unit; a source that it doesn't name gets none.
    scale is the output's bytes over the input's.
    """
    size = F.octet_length(common.text_or_empty(text)).cast("bigint") + 1
    totals = docs.select(F.col("source").cast("string").alias("source"), size.alias("b")).groupBy("source")
    totals = totals.agg(F.count(F.lit(1)).alias("rows"), F.sum("b").alias("bytes"))
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(SMOOTHING))
    else:
        pairs = [F.lit(x) for k, w in weights.items() for x in (k, float(w))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    totals = common.cut(totals.withColumn("weight", weight))
    all_bytes, all_weight = totals.agg(F.sum("bytes"), F.sum("weight")).first()
    rate = F.col("weight") * F.lit(float(scale) * (all_bytes or 0) / all_weight if all_weight else 0.0) / F.col("bytes")
    return totals.select("source", "rows", "bytes", rate.alias("rate"))


def with_distribution(rates: DataFrame) -> DataFrame:
    """Adds parts, the number of Poisson numbers to sum, and cdf, the cumulated chances of 0, 1, 2 ... for one.

    cdf ends where the rest is below 1e-16: at mean + 12 standard deviations + 30.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_PART)).cast("int")
    rates = rates.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts"))
    steps = F.sequence(F.lit(1), (F.col("mean") + 12 * F.sqrt("mean") + 30).cast("int"))
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * F.col("mean") / i
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return rates.withColumn("cdf", F.aggregate(steps, start, step, lambda acc: acc["cdf"])).drop("mean")


def _copies(key: Sequence[Column], parts: Column, cdf: Column, seed: int) -> Column:
    def one(part: Column) -> Column:
        u = common.hash_unit(F.lit(f"copies-{seed}"), *key, part)
        return F.size(F.filter(cdf, lambda chance: chance < u))

    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, part: n + one(part))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    scale: float = 1.0,
    text: str = "text",
    seed: int = SEED,
    numbered: bool = True,
) -> DataFrame:
    """The mixture: all columns of docs for each copy, then copy (from 1) and position (0, 1, 2 ... overall).

    Rows come out in the order of position within each partition, and partitions hold random parts of it.
    Without `numbered` the columns are those of docs alone; partitions are dealt by the key that position
    orders by and sorted by it, with no numbers and so no counts.

    The number of copies, which may be 0, is drawn from doc_id and the text's MD5: different texts draw independently
    though they share a doc_id, as those with a null one do; rows that share both draw alike. A null source is a
    source of its own. position orders by an MD5 of seed, doc_id, the text's MD5 and copy, then by doc_id and copy.
    Null text is empty. Empty table: empty result. Numbered,
    columns named copy or position in docs are replaced.
    """
    common.require(docs, doc_id="bigint", source="string", **{text: "string"})
    rates = common.cut(with_distribution(source_rates(docs, weights, scale, text)))
    shares = common.broadcast_if_small(rates.select(F.col("source").alias("r_source"), "parts", "cdf"), BROADCAST_SOURCES)

    def exploded(rows: DataFrame) -> DataFrame:
        joined = rows.join(shares, F.col("m_source").eqNullSafe(F.col("r_source")))
        counted = joined.withColumn("m_n", _copies(key, F.col("parts"), F.col("cdf"), seed)).where("m_n > 0")
        copies = counted.drop("parts", "cdf", "r_source", "m_source").withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_n"))))
        at = F.md5(F.concat_ws(":", F.lit(f"order-{seed}"), *[F.coalesce(k.cast("string"), F.lit("")) for k in key], F.col("m_copy")))
        return copies.withColumn("m_at", at).drop("m_n", "m_digest")

    names = [F.col("doc_id").alias("m_id"), F.col("source").cast("string").alias("m_source")]
    names.append(F.md5(common.text_or_empty(text).cast("binary")).alias("m_digest"))
    key = [F.col("m_id"), F.col("m_digest")]
    wide = exploded(docs.select(common.packed(docs).alias("row"), *names))
    order = [F.col("m_id"), F.col("m_copy")]
    if not numbered:
        return common.unpacked(wide.repartition("m_at").sortWithinPartitions("m_at", *order), "row", docs.schema)
    planned = rates.agg(F.sum(F.col("bytes") * F.col("rate"))).first()[0] or 0.0
    digits = common.bucket_digits(math.ceil(planned), BYTES_PER_BUCKET)
    thin = exploded(docs.select(*names))
    ranked = common.gapless_rank(wide, [], order, "m_at", digits, "m_position", thin)
    kept = [f for f in docs.columns if f not in ("copy", "position")]
    return ranked.select(
        *[F.col("row")[c].alias(c) for c in kept], F.col("m_copy").alias("copy"), F.col("m_position").cast("bigint").alias("position")
    )
