"""Line dedup within one edit, by a join of deletion neighbourhoods.

Two lines are within one edit (a character put in, taken out or replaced) exactly if they share a variant:
the line with the character at one position taken out, or, where the lengths differ, the shorter line whole.
Equal lines are first made one, by digest. Variants are then emitted as hashed keys in two steps:

1. Coarse: for each third of a line, the hash of the line without that third. Lines within one edit share
   such a key, for the third that holds the edit; other lines rarely do.
2. Fine: only where a coarse key is shared, the variants that take out one character of that third.

Lines that share a fine key are linked to the earliest of them. The edit distance of every link is verified
on the texts, and a line with a verified link to an earlier one goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, rolling

#: Shorter lines go only if they are equal to an earlier one, where a caller doesn't choose another length.
LEAST_LENGTH = 20
PARTS = 3
BLANKS = " \t\r\x0b\x0c"
#: Variants that a Python worker gathers before it sends them on.
VARIANTS_AT_ONCE = 1 << 16


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, key, line_no, line of every line that isn't blank; lines are compared without blanks at their ends."""
    whole = common.text_or_empty(text)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(whole).alias("key"), F.posexplode(F.split(whole, "\n")).alias("line_no", "raw"))
    return rows.select("doc_id", "key", "line_no", F.btrim("raw", F.lit(BLANKS)).alias("line")).where("line != ''")


def _coarse_keys(line: Column, least_length: int) -> list[Column]:
    """The line as one of its own length, and as the longer of a pair: without each third, for either."""
    length = F.char_length(line)
    keys = []
    for longer in (0, 1):
        shorter = length - longer
        for i in range(PARTS):
            begin, end = F.floor(shorter * i / PARTS).cast("int"), F.floor(shorter * (i + 1) / PARTS).cast("int")
            key = F.xxhash64(shorter, F.lit(i), F.substring(line, F.lit(1), begin), F.substring(line, end + longer + 1, length))
            keys.append(F.when(length >= least_length, key))
    return keys


def _variants(line: str, slots: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Fine keys of a line for the coarse keys it shares, and each one's role: 0 replaced, 1 shorter, 2 longer."""
    sums = rolling.prefix_sums(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4"))
    n = len(sums) - 1
    keys, roles = [], []

    def without(at: np.ndarray) -> np.ndarray:
        joined = sums[at] - sums[0] + (sums[n] - sums[at + 1]) * rolling.POWERS.down[1]
        return rolling.mixed(joined + np.uint64(n - 1))

    for longer in (0, 1):
        held = [s % PARTS for s in slots if s // PARTS == longer]
        shorter = n - longer
        spans = [np.arange(shorter * i // PARTS, shorter * (i + 1) // PARTS + longer) for i in held]
        if not spans:
            continue
        at = np.unique(np.concatenate(spans))
        if longer:
            keys.append(np.unique(without(at)))
            roles.append(np.full(len(keys[-1]), 2, np.int32))
        else:
            keys.append(rolling.mixed(without(at) + at.astype(np.uint64) + np.uint64(1)))
            roles.append(np.zeros(len(at), np.int32))
            keys.append(rolling.mixed(sums[n:] - sums[0] + np.uint64(n)))
            roles.append(np.ones(1, np.int32))
    return np.concatenate(keys), np.concatenate(roles)


def _variant_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0
        for lid, line, slots in zip(batch.column("lid").to_pylist(), batch.column("line"), batch.column("slots"), strict=True):
            keys, roles = _variants(line.as_py(), slots.as_py())
            held.append((np.full(len(keys), lid, np.int64), keys.view(np.int64), roles))
            rows += len(keys)
            if rows >= VARIANTS_AT_ONCE:
                yield _variant_batch(held)
                held, rows = [], 0
        if held:
            yield _variant_batch(held)


def _variant_batch(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["lid", "variant", "role"])


def _order(*names: str) -> Column:
    """Earlier lines have less: by doc_id (null first), key of the text, number in the text."""
    return F.struct(*[F.col(n) for n in names])


def distinct_lines(docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """The first line of each set of equal ones: lid, doc_id, key, line_no, and the coarse keys k0 to k5."""
    lines = _lines(docs, text)
    keyed = lines.select(
        F.unhex(F.md5("line")).alias("digest"), "doc_id", "key", "line_no", *[k.alias(f"k{i}") for i, k in enumerate(_coarse_keys(F.col("line"), least_length))]
    )
    slots = [f"k{i}" for i in range(2 * PARTS)]
    first = keyed.groupBy("digest").agg(F.min(_order("doc_id", "key", "line_no")).alias("first"), *[F.max(k).alias(k) for k in slots])
    return common.cut(first.select(F.monotonically_increasing_id().alias("lid"), "first.doc_id", "first.key", "first.line_no", *slots))


def candidates(firsts: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Lines that share a coarse key: lid, doc_id, key, line_no, slots (which keys), line."""
    slots = F.array(*[F.col(f"k{i}") for i in range(2 * PARTS)])
    keyed = firsts.select("lid", F.posexplode(slots).alias("slot", "coarse")).where("coarse IS NOT NULL")
    shared = common.cut(keyed.groupBy("coarse").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("coarse"))
    found = keyed.join(shared, "coarse").groupBy("lid").agg(F.collect_set("slot").alias("slots"))
    found = common.cut(firsts.select("lid", "doc_id", "key", "line_no").join(found, "lid"))
    # Their texts are read again. Filters choose the documents that are split and the lines that are shuffled.
    documents = common.KeyFilter(found.select(F.xxhash64("doc_id", "key")))
    lines = common.KeyFilter(found.select(F.xxhash64("doc_id", "key", "line_no")))
    whole = common.text_or_empty(text)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("t_id"), F.xxhash64(whole).alias("t_key"), whole.alias("t_text"))
    texts = documents.mark(texts, F.xxhash64("t_id", "t_key"), "asked").where("asked")
    texts = texts.select("t_id", "t_key", F.posexplode(F.split("t_text", "\n")).alias("t_no", "t_raw"))
    texts = lines.mark(texts, F.xxhash64("t_id", "t_key", "t_no"), "asked").where("asked")
    same = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("key") == F.col("t_key")) & (F.col("line_no") == F.col("t_no"))
    named = texts.join(found, same).select("lid", "doc_id", "key", "line_no", "slots", F.btrim("t_raw", F.lit(BLANKS)).alias("line"))
    return common.cut(named.dropDuplicates(["lid"]))


def near_links(lines: DataFrame) -> DataFrame:
    """late, early: lids of candidates within one edit, the later line first; each late line's earlier ones are reached.

    Lines that share a variant by replacement are all within one edit of each other, so each is linked to
    the earliest. Those that share one by insertion are linked to the one shorter line that is the variant.
    A group has one line for each character that fits its place, so it is small however common a line is.
    """
    variants = common.in_python(lines.select("lid", "line", "slots"), _variant_batches, "lid bigint, variant bigint, role int")
    whole = F.struct("doc_id", "key", "line_no", "lid")
    ranked = variants.join(lines.select("lid", "doc_id", "key", "line_no"), "lid").select("variant", "role", whole.alias("at"))
    group = Window.partitionBy("variant", F.col("role") == 0)
    centre = F.when(F.col("role") == 0, F.min("at").over(group)).otherwise(F.max(F.when(F.col("role") == 1, F.col("at"))).over(group))
    pairs = ranked.withColumn("centre", centre).where("centre.lid != at.lid")
    pairs = pairs.select(F.greatest("at", "centre")["lid"].alias("late"), F.least("at", "centre")["lid"].alias("early")).distinct()
    late = lines.select(F.col("lid").alias("late"), F.col("line").alias("late_line"))
    early = lines.select(F.col("lid").alias("early"), F.col("line").alias("early_line"))
    checked = pairs.join(late, "late").join(early, "early")
    return checked.where(F.levenshtein("late_line", "early_line", 1).between(0, 1)).select("late", "early")


def _blank_places(lines: Column) -> Column:
    """Numbers of the lines that are blank."""
    numbered = F.transform(lines, lambda line, i: F.when(F.btrim(line, F.lit(BLANKS)) == "", i))
    return F.filter(numbered, lambda i: i.isNotNull())


def dedup_lines(docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """One row per document: doc_id, n_lines, n_kept, kept_text.

    A line goes if an earlier one (by doc_id, then place in the text) is equal to it, blanks at the ends
    aside, or within one edit of it, where both have least_length characters or more; the earlier line may
    itself have gone. Blank lines stay and don't count. Null text is empty. Null doc_ids come first.
    Rows that repeat both doc_id and text are one document and lose the same lines. Empty table: empty
    result. Other columns aren't read.
    """
    common.require(docs, doc_id="bigint", **{text: "string"})
    firsts = distinct_lines(docs, text, least_length)
    gone = common.cut(near_links(candidates(firsts, docs, text)).select(F.col("late").alias("lid")).distinct())
    common.release(docs.sparkSession)
    kept = firsts.join(gone, "lid", "left_anti").groupBy("doc_id", "key").agg(F.collect_list("line_no").alias("held"))
    kept = kept.select(F.col("doc_id").alias("k_id"), F.col("key").alias("k_key"), "held")
    whole = common.text_or_empty(text)
    # Lines are split before the join, so that the steps after it find each line by its number.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(whole).alias("key"), F.split(whole, "\n").alias("lines"))
    joined = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("key") == F.col("k_key")), "left")
    found = joined.select("doc_id", "lines", F.coalesce("held", F.array().cast("array<int>")).alias("held"), _blank_places(F.col("lines")).alias("blank"))
    stay = F.transform(F.array_sort(F.concat("held", "blank")), lambda i: F.get(F.col("lines"), i))
    return found.select(
        "doc_id",
        (F.size("lines") - F.size("blank")).cast("bigint").alias("n_lines"),
        F.size("held").cast("bigint").alias("n_kept"),
        F.array_join(stay, "\n").alias("kept_text"),
    )
