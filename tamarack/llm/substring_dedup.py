"""Substring dedup by content-defined chunks.

A gear hash rolls over the last GEAR bytes. Of any REACH successive places the one with the least gear hash is a
cut, so cuts follow the content alone: bytes put in or taken out change the cuts around them and no others, and
cuts are less than REACH bytes apart. From each cut a chunk goes to the first cut that is LEAST_CHUNK bytes away
or more. Chunks of variable length are deduplicated by digest: digests found in more than one document are joined
back to their places, the earliest document keeps its bytes, and elsewhere touching chunks are joined to runs.

A chunk's neighbours see the bytes around a passage, so the passage goes on beyond its chunks. Each run is
therefore extended byte by byte against the earlier document, and only then measured in bytes and words.
Two texts that share SURE_BYTES share a chunk; where chunks' digests are equal but not their bytes, the
extension finds no common byte, and a single chunk is shorter than a span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, rolling

#: Bytes that a gear hash covers, one for each of its bits.
GEAR = 16
#: Places of which one is a cut, and the least bytes of a chunk.
REACH, LEAST_CHUNK = 56, 40
#: A passage of so many bytes has a chunk whose cuts depend on nothing outside of it.
SURE_BYTES = GEAR - 3 + 3 * REACH + LEAST_CHUNK
#: Spans of fewer bytes or words stay: common phrases, stock lines, what an edited copy shares between two edits.
#: A passage of over 50 words still has so many where its ends fall short.
LEAST_BYTES, LEAST_WORDS = 160, 40
#: Spans of so many bytes go whatever their words are, as in scripts without spaces.
MANY_BYTES = 480
#: Bytes beyond a run's left and right end that are compared with the earlier document's: so far away is the end of a passage.
AROUND = (GEAR + REACH, 2 * REACH + LEAST_CHUNK)
#: Places hashed at once.
SEGMENT = 1 << 20
LEFT, RIGHT = 0, 1
CHUNKS = "digest bigint, doc_id bigint, key bigint, start bigint, size int"

_GEAR = (rolling.mixed(np.arange(256, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of gear[b] << distance over the last GEAR bytes, modulo 2 ** 16, by doubling."""
    h = _GEAR[data]
    n = 1
    while n < GEAR:
        h[n:] = h[n:] + (h[:-n] << np.uint16(n))
        n *= 2
    return h


def _sliding(best: np.ufunc, values: np.ndarray) -> np.ndarray:
    """The least or greatest of each REACH successive values: by doubling, and two overlapping halves."""
    n = 1
    while 2 * n <= REACH:
        values = best(values[:-n], values[n:])
        n *= 2
    return best(values[: -(REACH - n)], values[REACH - n :]) if n < REACH else values


def cuts(data: np.ndarray) -> np.ndarray:
    """Where a text's chunks may begin and end: after each byte whose gear hash is the least of REACH successive ones."""
    n = len(data) - GEAR + 1  # places with a whole gear hash
    found = [np.zeros(0, np.int64)]
    for at in range(0, n if n >= REACH else 0, SEGMENT):
        low, high = max(0, at - REACH + 1), min(n, at + SEGMENT + REACH - 1)
        if high - low < REACH:
            low = high - REACH
        h = gear_hashes(data[low : high + GEAR - 1])[GEAR - 1 :]
        chosen = np.nonzero(h == _sliding(np.maximum, np.pad(_sliding(np.minimum, h), REACH - 1)))[0] + low
        found.append(chosen[(chosen >= at) & (chosen < at + SEGMENT)])
    return np.concatenate(found) + GEAR


def chunks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, start and end of each chunk; equal chunks that overlap, as in a repeated word, are one."""
    data = np.frombuffer(text, np.uint8)
    at = cuts(data)
    stop = np.searchsorted(at, at + LEAST_CHUNK)
    a, b = at[stop < len(at)], at[stop[stop < len(at)]]
    found = np.zeros(len(a), np.uint64)
    for low in range(0, len(a), SEGMENT // REACH):
        high = min(len(a), low + SEGMENT // REACH)
        base = a[low]
        found[low:high] = rolling.part_hashes(rolling.prefix_sums(data[base : b[high - 1]]), a[low:high] - base, b[low:high] - base)
    new = np.ones(len(a), bool)
    new[1:] = (found[1:] != found[:-1]) | (a[1:] > b[:-1])
    last = np.append(new[1:], True)[: len(a)]
    return found[new], a[new], b[last]


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: list[tuple] = []
        rows = 0
        for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("whole"), strict=True):
            found, a, b = chunks(text.as_py())
            if len(a):
                held.append((doc_id, key, found, a, (b - a).astype(np.int32)))
                rows += len(a)
            if rows >= 1 << 16:
                yield _chunk_batch(held)
                held, rows = [], 0
        if held:
            yield _chunk_batch(held)


def _chunk_batch(held: list[tuple]) -> pa.RecordBatch:
    doc_ids, keys, found, starts, sizes = zip(*held, strict=True)
    of = np.repeat(np.arange(len(held)), [len(a) for a in starts])
    columns = [
        pa.array(np.concatenate(found).view(np.int64)),
        pa.array(doc_ids, pa.int64()).take(pa.array(of)),
        pa.array(np.array(keys, np.int64)[of]),
        pa.array(np.concatenate(starts)),
        pa.array(np.concatenate(sizes)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["digest", "doc_id", "key", "start", "size"])


def _numbered(places: DataFrame) -> DataFrame:
    """Adds span, the number of the run of touching or overlapping places within a document."""
    in_order = Window.partitionBy("doc").orderBy("start", "end")
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before >= F.col("start"), 0).otherwise(1)
    return places.withColumn("begins", begins).withColumn("span", F.sum("begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))


def word_starts(data: np.ndarray) -> np.ndarray:
    """Whether a word, a run of other bytes than white space, begins at each byte but the first, which only tells."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    return space[:-1] & ~space[1:]


def words_in(data: bytes, start: int, end: int) -> int:
    """Words that begin within data[start:end]."""
    if start >= end:
        return 0
    first = start == 0 and data[0] not in b" \t\n\v\f\r"
    return int(word_starts(np.frombuffer(data, np.uint8)[max(0, start - 1) : end]).sum()) + first


def _around_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each place asked for: LEAST_CHUNK of the run, and those beyond it."""
    for batch in batches:
        rows = []
        for doc_id, key, data, asked in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("whole"), batch.column("asked").to_pylist(), strict=True):
            data = data.as_py()
            words = last = 0
            for place in sorted(asked, key=lambda place: place["at"]):
                side, at = place["side"], place["at"]
                words, last = words + words_in(data, last, at), at
                # one byte more than is compared, which tells whether a word begins
                before, after = (AROUND[LEFT] + 1, LEAST_CHUNK) if side == LEFT else (LEAST_CHUNK, AROUND[RIGHT])
                rows.append(({"doc_id": doc_id, "key": key}, side, at, words, data[max(0, at - before) : at], data[at : at + after]))
        kinds = [pa.struct([("doc_id", pa.int64()), ("key", pa.int64())]), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for i in range(0, len(rows), 1 << 13):
            columns = [pa.array(c, k) for c, k in zip(zip(*rows[i : i + (1 << 13)], strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "side", "at", "words", "before", "after"])


def _same_bytes(one: bytes, other: bytes) -> int:
    """How many bytes both begin with."""
    n = min(len(one), len(other))
    if one[:n] == other[:n]:
        return n
    return next(i for i in range(n) if one[i] != other[i])


def _more_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How far each end's bytes go on like the earlier document's, and the words that begin there; nothing where the
    chunks only share a digest."""
    for batch in batches:
        more, words = [], []
        for side, before, after, f_before, f_after in zip(*(batch.column(c).to_pylist() for c in ("side", "before", "after", "f_before", "f_after")), strict=True):
            n = w = 0
            if side == LEFT and after == f_after:
                n = min(AROUND[LEFT], _same_bytes(before[::-1], f_before[::-1]))
                w = words_in(before, len(before) - n, len(before))
            elif side == RIGHT and before == f_before:
                n = _same_bytes(after, f_after)
                w = words_in(before + after, len(before), len(before) + n)
            more.append(n)
            words.append(w)
        kept = ["doc", "span", "side", "at", "words"]
        columns = [*[batch.column(c) for c in kept], pa.array(more, pa.int32()), pa.array(words, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, [*kept, "more", "more_words"])


def _rows(docs: DataFrame, text: str) -> DataFrame:
    whole = common.text_or_empty(text)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(whole).alias("key"), whole.cast("binary").alias("whole"))


def _written(spark: SparkSession, name: str, rows: DataFrame) -> tuple[DataFrame, str]:
    """Chunks written to the shared folder, and where. A column of hashes takes its own size, the others little."""
    path = common.scratch(spark, name)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(CHUNKS).parquet(path), path


def repeated_spans(docs: DataFrame, text: str = "text", least_bytes: int = LEAST_BYTES, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, start, end, first_doc_id, text_key: bytes of texts (UTF-8) that an earlier document has too.

    first_doc_id is the earliest document with a part of the span. Documents are in the order of doc_id, null
    before all, and then of text_key, a hash of the text. Rows that share doc_id and text are one document; rows
    that share only the doc_id, as those with a null one do, are several. A passage repeated within one document
    alone stays. A span has least_bytes and least_words, or MANY_BYTES. Every passage of SURE_BYTES has a chunk,
    and nearly every one of least_bytes. A run is extended against
    the earliest document with its first and last chunk; an end falls short only where a still earlier document,
    or an earlier place of that document, has that chunk but goes on differently. Null and short texts have no
    spans. Empty table: empty result. Other columns aren't read.

    Chunks are cut once and written. A digest in a third of all documents costs one row for each place: counts
    and earliest documents are combined before they are shuffled, and are cut, so that Spark splits the joins'
    hot keys. A window holds one document's chunks.
    """
    common.require(docs, doc_id="bigint", **{text: "string"})
    spark = docs.sparkSession
    rows = _rows(docs, text)
    every, chunks_path = _written(spark, "chunks", common.in_python(rows, _chunk_batches, CHUNKS))
    repeated = common.cut(every.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    common.release(spark)
    shared, shared_path = _written(spark, "shared-chunks", every.join(repeated, "digest", "left_semi"))
    common.remove(spark, chunks_path)
    common.release(spark)
    places = shared.select("digest", F.struct("doc_id", "key").alias("doc"), "start", "size")
    earliest = places.groupBy("digest").agg(F.min(F.struct("doc", "start", "size")).alias("f"), F.max("doc").alias("last")).where("f.doc < last")
    earliest = common.cut(earliest.select("digest", F.col("f.doc").alias("first"), F.col("f.start").alias("f_start"), F.expr("f.start + f.size").alias("f_end")))
    later = places.join(earliest, "digest").where("doc > first")
    later = later.select("doc", "start", (F.col("start") + F.col("size")).alias("end"), "first", "f_start", "f_end")
    runs = _numbered(later).groupBy("doc", "span").agg(
        F.min("first").alias("first"),
        F.min(F.struct(F.col("start").alias("at"), "first", F.col("f_start").alias("f_at"))).alias("left"),
        F.max(F.struct(F.col("end").alias("at"), "first", F.col("f_end").alias("f_at"))).alias("right"),
    )
    runs = common.cut(runs)
    common.remove(spark, shared_path)
    common.release(spark)
    return _long_spans(_extended(runs, rows), least_bytes, least_words)


def _extended(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc, start, end, first: each run up to where its bytes and the earlier document's differ."""
    side = lambda n, c: runs.select("doc", "span", F.lit(n).alias("side"), f"{c}.at", F.col(f"{c}.first").alias("f_doc"), f"{c}.f_at")
    ends = side(LEFT, "left").unionByName(side(RIGHT, "right"))
    asked = ends.select("doc", "side", "at").unionByName(ends.select(F.col("f_doc").alias("doc"), "side", F.col("f_at").alias("at")))
    asked = asked.groupBy("doc").agg(F.collect_set(F.struct("side", "at")).alias("asked"))
    asked = rows.join(asked, F.struct("doc_id", "key") == F.col("doc")).select("doc_id", "key", "whole", "asked")
    around = common.in_python(asked, _around_batches, "doc struct<doc_id:bigint,key:bigint>, side int, at bigint, words bigint, before binary, after binary")
    around = common.cut(around.dropDuplicates(["doc", "side", "at"]))
    theirs = around.select(*[F.col(c).alias(n) for c, n in (("doc", "f_doc"), ("side", "side"), ("at", "f_at"), ("before", "f_before"), ("after", "f_after"))])
    both = ends.join(around, ["doc", "side", "at"]).join(theirs, ["f_doc", "side", "f_at"])
    more = common.in_python(
        both.select("doc", "span", "side", "at", "words", "before", "after", "f_before", "f_after"),
        _more_batches,
        "doc struct<doc_id:bigint,key:bigint>, span bigint, side int, at bigint, words bigint, more int, more_words int",
    )
    of = lambda n, c: F.max(F.when(F.col("side") == n, c))
    grown = more.groupBy("doc", "span").agg(
        of(LEFT, F.col("at") - F.col("more")).alias("start"),
        of(RIGHT, F.col("at") + F.col("more")).alias("end"),
        of(LEFT, F.col("words") - F.col("more_words")).alias("words_before"),
        of(RIGHT, F.col("words") + F.col("more_words")).alias("words_after"),
    )
    return grown.join(runs.select("doc", "span", "first"), ["doc", "span"]).drop("span")


def _long_spans(grown: DataFrame, least_bytes: int, least_words: int) -> DataFrame:
    """Extended runs of one document that now touch or overlap become one span."""
    spans = _numbered(grown).groupBy("doc", "span").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("first").alias("first"),
        (F.max("words_after") - F.min("words_before")).alias("words"),
    )
    size = F.col("end") - F.col("start")
    long = spans.where((size >= MANY_BYTES) | (size >= least_bytes) & (F.col("words") >= least_words))
    return long.select("doc.doc_id", "start", "end", F.col("first.doc_id").alias("first_doc_id"), F.col("doc.key").alias("text_key"))


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for data, spans in zip(batch.column("whole"), batch.column("spans").to_pylist(), strict=True):
            data = data.as_py()
            kept, last = [], 0
            for span in sorted(spans or (), key=lambda s: s["start"]):
                start, end = max(span["start"], last), span["end"]
                while start < end and data[start] & 0xC0 == 0x80:  # not within a character
                    start += 1
                while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
                    end -= 1
                kept.append(data[last:start])
                last = max(last, end)
            texts.append((b"".join(kept) + data[last:]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "kept_text"])


def cut_spans(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, kept_text: the texts without the spans of `repeated_spans`, whole characters only.

    A span is cut from the rows with its doc_id and text alone; other texts under the same doc_id stay.
    """
    each = spans.groupBy(F.col("doc_id").alias("s_id"), "text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = _rows(docs, text).join(each, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("key") == F.col("text_key")), "left")
    return common.in_python(joined.select("doc_id", "whole", "spans"), _cut_batches, "doc_id bigint, kept_text string")
