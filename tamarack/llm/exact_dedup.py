"""Exact deduplication by a log-structured merge index of text digests, in DataFrame operations only.

* Memtables: the rows of one scan task are one. `flush` sorts each by digest and writes it as one Parquet file,
  a sorted run of level 0 with minimum, maximum and Bloom filter of the digests.
* Compaction: `compact` merges groups of runs into the runs of the next level, until one is left: a row for each
  digest with the identifier that stays and the number of rows. Partial aggregation leaves one row for each
  digest and task, so a digest that a third of all rows share costs no more than others.
* Filters: a level's digests are probed through a filter of bounded size. Rows that the filter of the digests
  with several rows doesn't mark are alone; they are joined with nothing.
* Verification: texts of digests with several rows are compared byte by byte with the text that stays. Rows
  that differ from it (equal digests, other texts) are grouped anew by their whole text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits of SHA-256 that an index keys on. Tests lower it to make digests collide.
DIGEST_BITS = 256
#: Runs that one compaction merges, at least; more where two levels wouldn't be enough.
FAN = 8


def normalised(text: str = "text") -> Column:
    return common.ascii_lower(common.text_or_empty(text))


def digest(text: Column, bits: int = DIGEST_BITS) -> Column:
    """Never null, so that a join needn't check that it isn't by digesting the text once more."""
    whole = F.sha2(text, 256)
    return F.coalesce(F.unhex(whole if bits == 256 else F.substring(whole, 1, bits // 4)), F.lit(b""))


def _order(keep: str) -> Column:
    """What the row that stays has most of; null identifiers stay only where there are no others."""
    known = F.col("doc_id").isNotNull()
    signed = F.col("doc_id") if keep == "largest" else -F.col("doc_id").cast("decimal(20,0)")
    return F.struct(known.alias("known"), signed.alias("signed"), (-F.col("batch")).alias("batch"), (-F.col("at")).alias("at"))


def _best(keep: str) -> list[Column]:
    sign = 1 if keep == "largest" else -1
    return [
        (F.col("best.signed") * sign).cast("bigint").alias("keep_id"),
        (-F.col("best.batch")).alias("keep_batch"),
        (-F.col("best.at")).alias("keep_at"),
        "n",
    ]


class DigestIndex:
    """The index under `path`: runs of level 0 for each flush, and the levels that compaction makes of them."""

    def __init__(self, spark: SparkSession, path: str, keep: str = "largest", bits: int = DIGEST_BITS):
        if keep not in ("largest", "smallest"):
            raise ValueError(keep)
        self.spark, self.path, self.keep, self.bits, self.flushed, self.merged = spark, path, keep, bits, 0, None
        self.levels: list[int] = []

    def _write(self, rows: DataFrame, name: str, *order: str) -> DataFrame:
        """Each task's rows as one sorted file with a Bloom filter."""
        target = f"{self.path}/{name}"
        (
            rows.sortWithinPartitions(*order)
            .write.option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .parquet(target)
        )
        return self.spark.read.parquet(target)

    def flush(self, docs: DataFrame, text: str = "text") -> None:
        """Writes the documents' digests as sorted runs, one for each task's memtable; no shuffle."""
        whole = normalised(text)
        rows = docs.select(
            "doc_id",
            common.row_key(text).alias("key"),
            digest(whole, self.bits).alias("digest"),
            digest(whole).alias("sha"),
            F.lit(self.flushed).alias("batch"),
            F.monotonically_increasing_id().alias("at"),
        )
        self._write(rows.drop("sha") if self.bits == DIGEST_BITS else rows, f"level-0-{self.flushed}", "digest", "at")
        self.flushed += 1

    def runs(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/level-0-{n}" for n in range(self.flushed)])

    def compact(self) -> DataFrame:
        """Merges level by level into one run: digest, best, keep_id, keep_batch, keep_at, n."""
        task = F.shiftrightunsigned("at", 33)  # its number is in the upper bits of `at`
        level = self.runs().select("digest", "batch", task.alias("task"), _order(self.keep).alias("best"), F.lit(1).cast("bigint").alias("n"))
        count = level.select("batch", "task").distinct().count()
        self.levels = [count]
        fan = max(FAN, math.isqrt(max(0, count - 1)) + 1)
        merges = F.xxhash64("batch", "task")  # which runs are merged with each other
        while len(self.levels) == 1 or count > 1:
            count = max(1, -(-count // fan))
            merged = level.groupBy(F.pmod(merges, F.lit(count)).cast("int").alias("run"), "digest").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
            level, merges = self._write(merged, f"level-{len(self.levels)}-{self.flushed}", "run", "digest"), F.col("run")
            self.levels.append(count)
        self.merged = level.select("digest", *_best(self.keep))
        return self.merged

    def hits(self) -> DataFrame:
        """Digests with several rows."""
        return self.merged.where("n > 1")

    def hit_filter(self) -> common.KeyFilter:
        return common.KeyFilter(self.hits().select(F.xxhash64("digest")))

    def lookup(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The documents' columns and keep_id: the identifier in the index of an equal digest, or null.

        Documents that the filter of all digests doesn't mark are new, and aren't joined.
        """
        row = docs.select(common.packed(docs).alias("row"), digest(normalised(text), self.bits).alias("digest"))
        marked = common.KeyFilter(self.merged.select(F.xxhash64("digest"))).mark(row, F.xxhash64("digest"), "asked")
        new = marked.where("NOT asked").select("row", F.lit(None).cast("bigint").alias("keep_id"))
        found = marked.where("asked").join(self.merged.select("digest", "keep_id"), "digest", "left").select("row", "keep_id")
        return new.union(found).select("row.*", "keep_id")

    def impostors(self, docs: DataFrame, hit_filter: common.KeyFilter, text: str = "text") -> DataFrame:
        """Byte verification: the rows (digest, doc_id, whole) whose text differs from the one that stays.

        Only texts that the filter marks are shuffled. The join is one row for each member, against one text for
        each digest; Spark splits a hot digest's members over tasks.
        """
        members = docs.select("doc_id", normalised(text).alias("whole")).withColumn("digest", digest(F.col("whole"), self.bits))
        members = hit_filter.mark(members, F.xxhash64("digest"), "asked").where("asked").drop("asked")
        hit = members.join(self.hits().select("digest", "keep_id"), "digest")
        kept = hit.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        # Cut, so that the members' side of the join below is a plain shuffle, which Spark can split.
        kept = common.cut(kept.groupBy("digest").agg(F.min("whole").alias("kept_text")))
        return members.join(kept, "digest").where("whole != kept_text").select("digest", "doc_id", "whole")


def exact_groups(docs: DataFrame, text: str = "text", keep: str = "largest", bits: int = DIGEST_BITS) -> DataFrame:
    """One row per document: doc_id, key, keep_id, group_size, kept, sha (SHA-256 of the normalised text).

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the row
    with the largest (or smallest) doc_id stays. Null doc_ids stay only among themselves. Of repeated rows
    that could both stay, the first read does. key is a hash of the text as it is. An empty table gives an empty
    result. Other columns aren't read.
    """
    common.require(docs, doc_id="bigint", **{text: "string"})
    spark = docs.sparkSession
    index = DigestIndex(spark, common.scratch(spark, "digests"), keep, bits)
    index.flush(docs, text)
    merged = index.compact()
    hit_filter = index.hit_filter()
    odd = common.cut(index.impostors(docs, hit_filter, text))
    rows = index.runs()
    if bits == DIGEST_BITS:
        rows = rows.withColumn("sha", F.col("digest"))
    if not odd.isEmpty():
        return _regrouped(rows, odd, keep)
    marked = hit_filter.mark(rows, F.xxhash64("digest"), "asked")
    alone = marked.where("NOT asked").select("doc_id", "key", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return alone.union(_result(marked.where("asked").join(merged, "digest")))


def _result(joined: DataFrame) -> DataFrame:
    stays = (F.col("batch") == F.col("keep_batch")) & (F.col("at") == F.col("keep_at"))
    return joined.select("doc_id", "key", "keep_id", F.col("n").alias("group_size"), stays.alias("kept"), "sha")


def _regrouped(rows: DataFrame, odd: DataFrame, keep: str) -> DataFrame:
    """Groups by digest and, where texts of one digest differ, by the whole text's full digest as well."""
    clash = odd.select("digest").distinct()
    marked = rows.join(clash.withColumn("clash", F.lit(True)), "digest", "left")
    split = marked.withColumn("part", F.when(F.col("clash"), F.col("sha")))
    best = split.groupBy("digest", "part").agg(F.max(_order(keep)).alias("best"), F.count(F.lit(1)).alias("n"))
    best = best.select(F.col("digest").alias("d"), F.col("part").alias("p"), *_best(keep))
    return _result(split.join(best, (F.col("digest") == F.col("d")) & F.col("part").eqNullSafe(F.col("p"))))


def drop_exact_copies(docs: DataFrame, text: str = "text", keep: str = "largest") -> DataFrame:
    """The documents without their exact copies: all columns of the rows that stay.

    Cases as in exact_groups. Rows that repeat both doc_id and text count as one document; one stays.
    """
    decided = common.cut(exact_groups(docs, text, keep).select("doc_id", "key", "kept"))
    return common.keep_rows(docs, decided, common.row_key(text))
