"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import hashlib
import math
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset (tests) one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tamarack-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder; Spark removes it with its last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what has been cut: it does once the driver's collector finds them unused."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/tamarack-scratch/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Removes every written scratch table; call it when no result that reads one is still to be computed."""
    remove(spark, f"{shared_dir(spark)}/tamarack-scratch")


def _ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once for each Spark application; they may have no copy of it."""
    sc = spark.sparkContext
    if getattr(sc, "_tamarack_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tamarack-package-")) / "tamarack.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(archive))
    sc._tamarack_shipped = True


def in_python(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Maps a DataFrame's Arrow batches by a function of this package."""
    _ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Where bytes and characters agree in number the text is ASCII, and lower() is the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )


def hash_unit(*parts: Column) -> Column:
    """A uniform number inside (0, 1) from the parts: 52 bits of their MD5, so that any SQL engine can repeat it."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


#: Buckets' counts are summed in two steps if they have more hex digits than this.
COARSE_DIGITS = 3


def bucket_digits(total: int, each: int) -> int:
    """So many hex digits that `total` splits into parts of about `each`, by the first digits of a uniform key."""
    return max(1, math.ceil(math.log(max(1.0, total / each), 16)))


def _sum_before(counts: DataFrame, groups: Sequence[str], bucket: str, name: str) -> DataFrame:
    before = Window.partitionBy(*groups or [F.lit(0)]).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum("__n").over(before), F.lit(0)))


def _first_ranks(counts: DataFrame, groups: Sequence[str], digits: int) -> DataFrame:
    """Adds __first: the number of a group's rows in buckets before. No task gets more than a part of the counts."""
    if digits <= COARSE_DIGITS:
        return _sum_before(counts, groups, "__b", "__first").drop("__n")
    coarse = F.substring("__b", 1, COARSE_DIGITS)
    fine = _sum_before(counts.withColumn("__c", coarse), [*groups, "__c"], "__b", "__within").drop("__n")
    sums = counts.groupBy(*groups, coarse.alias("__c")).agg(F.sum("__n").alias("__n"))
    sums = _sum_before(sums, groups, "__c", "__before").drop("__n")
    return fine.join(sums, [*groups, "__c"]).withColumn("__first", F.col("__before") + F.col("__within")).drop("__c", "__before", "__within")


def gapless_rank(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], key: str, digits: int, name: str, counted: DataFrame | None = None) -> DataFrame:
    """Adds `name`: 0, 1, 2 ... within each group, by the hex column `key`, which is uniform, and then by order.

    No group meets in one task. Rows are dealt by group and the key's first digits, their bucket; the small
    table of counts for each group and bucket gives every bucket its first number. Groups must not be null.
    `counted` may hold the same groups and keys, to be counted without dragging wide rows along.
    """
    bucket = F.substring(key, 1, digits)
    rows = rows.withColumn("__b", bucket)
    keys = [*groups, "__b"]
    narrow = (rows if counted is None else counted.withColumn("__b", bucket)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    ranked = rows.join(_first_ranks(narrow, groups, digits), keys).withColumn(
        name, F.col("__first") + F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(key), *order)) - 1
    )
    return ranked.drop("__b", "__first")


def sliced(batch, size_of, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Splits 0..len(batch) into runs of which each holds `limit` bytes or one row."""
    start, held = 0, 0
    for i, row in enumerate(batch):
        n = size_of(row)
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n + 1
    if start < len(batch):
        yield start, len(batch)


def mark(text: bytes) -> bytes:
    """Stands for a text among those of one batch, in less memory."""
    return hashlib.blake2b(text, digest_size=16).digest()


def packed(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that added columns can't clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(df: DataFrame, row: str, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(row)[f.name].alias(f.name) for f in schema.fields])


#: Tables of at most so many narrow rows (100 bytes each at most) may be broadcast: 20 MB.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks a cut table for broadcast if it has so few rows (BROADCAST_ROWS); else Spark joins by shuffles."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


#: Bits of a filter: at least one block, so many for each key, and at most 16 MB, which is broadcast.
FILTER_BLOCK, FILTER_BITS_EACH, FILTER_MOST_BITS = 1 << 15, 64, 1 << 27


class KeyFilter:
    """A Bloom filter with one hash, as rows of a block's number and its bitmap.

    Its size is bounded whatever the number of keys; the more keys there are beyond, the more rows that aren't
    among them are marked too (1.6 % below two million keys). So it is for choosing the rows that a shuffle
    looks at closely, and every result is the same with any filter.
    """

    def __init__(self, hashes: DataFrame):
        """hashes: a cut or written table with one column of hashes."""
        wanted = max(1, hashes.count()) * FILTER_BITS_EACH
        self.bits = min(FILTER_MOST_BITS, max(FILTER_BLOCK, 1 << (wanted - 1).bit_length()))
        at = self._place(F.col(hashes.columns[0]))
        blocks = hashes.select(*at).groupBy("f_block").agg(F.bitmap_construct_agg("f_bit").alias("f_map"))
        self.blocks = cut(blocks)

    def _place(self, hashed: Column) -> list[Column]:
        """In operations that are never null: a join then needn't check that they aren't, by hashing once more."""
        at, digits = hashed.bitwiseAND(self.bits - 1), FILTER_BLOCK.bit_length() - 1
        return [F.shiftright(at, digits).cast("int").alias("f_block"), at.bitwiseAND(FILTER_BLOCK - 1).cast("int").alias("f_bit")]

    def mark(self, rows: DataFrame, hashed: Column, name: str) -> DataFrame:
        """Adds whether the filter may hold the hash: always true for its own keys."""
        block, bit = self._place(hashed)
        placed = rows.select("*", block.alias("f_at"), bit.alias("f_bit"))
        joined = placed.join(F.broadcast(self.blocks), F.col("f_at") == F.col("f_block"), "left")
        byte = F.conv(F.hex(F.substring("f_map", F.shiftright("f_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
        held = F.call_function("shiftright", byte, F.col("f_bit") % 8) % 2 == 1
        return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("f_map").isNotNull() & held).alias(name))


def _keyed(docs: DataFrame, key: Column) -> DataFrame:
    return docs.select(packed(docs).alias("row"), F.col("doc_id").alias("d_id"), key.alias("d_key"))


def _same() -> Column:
    return F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_key") == F.col("key"))


def row_key(text: str = "text") -> Column:
    """With doc_id, what tells a document from others."""
    return F.xxhash64(text_or_empty(text))


def without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """All columns of the documents whose doc_id and `key` aren't in gone (doc_id, key: a cut table).

    Only the documents that a filter of gone marks are shuffled and joined; the others pass as they are read.
    """
    asked = KeyFilter(gone.select(F.xxhash64("doc_id", "key")))
    marked = asked.mark(_keyed(docs, key), F.xxhash64("d_id", "d_key"), "asked")
    # With `asked` in its condition the join can't be moved below the mark, to where all documents are.
    stay = marked.where("asked").join(gone, _same() & F.col("asked"), "left_anti")
    return unpacked(marked.where("NOT asked").union(stay), "row", docs.schema)


def keep_rows(docs: DataFrame, decided: DataFrame, key: Column) -> DataFrame:
    """All columns of the documents that stay, each once.

    decided has one row per document: doc_id, key, kept, where key is the value of `key` for that document.
    Rows that repeat both doc_id and key are one document; if any of them stays, one does. Only the rows
    that go are joined, by their keys.
    """
    documents = decided.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    special = cut(documents.where("n > 1 OR NOT kept"))
    again = special.where("kept").select("doc_id", "key")
    kept = without(docs, special.select("doc_id", "key"), key)
    if again.isEmpty():
        return kept
    asked = KeyFilter(again.select(F.xxhash64("doc_id", "key")))
    marked = asked.mark(_keyed(docs, key), F.xxhash64("d_id", "d_key"), "asked").where("asked")
    once = marked.join(again, _same() & F.col("asked"), "left_semi").dropDuplicates(["d_id", "d_key"])
    return kept.unionByName(unpacked(once, "row", docs.schema))


def require(df: DataFrame, **kinds: str) -> None:
    """Complains about a missing column at once rather than within a job."""
    missing = [c for c in kinds if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
