"""Near-duplicates by SimHash fingerprints, compared exactly in tiles.

A tile holds the distinct fingerprints whose parts have the same population counts. Two fingerprints within the
radius have counts that differ by the radius at most in sum, so each tile meets only the tiles around it and all
other pairs of tiles are never formed. Within a pair, rows are sorted by the counts of finer parts and cut into
small tiles, and small tiles whose ranges of counts lie apart by more than the radius are skipped. The others are
compared with numpy exclusive-or and bit counts. A pair of tiles gives the edges of a spanning forest, not all links.

`simhash_groups` has one fingerprint of word shingles and a small radius (2): nearly equal texts. `near_groups` is
for edited copies: an edit changes one word but several shingles, so its fingerprint is of the single words, of
which an edited copy shares most, with a radius of 7. Unrelated texts that share common words are told apart by a
second fingerprint, of three-word shingles, within 14 bits; it is compared only where the first ones are linked.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, local_labels

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Bits in which the fingerprints of words and, with them, of shingles may differ in an edited copy.
WORD_RADIUS, SHINGLE_RADIUS = 7, 14
#: Parts of a fingerprint for fewer distinct ones and for more: more parts give smaller tiles with more neighbours.
FEW_PARTS, MANY_PARTS, MANY = 4, 8, 20_000_000
#: Parts for the radius of edited copies, where more parts have too many neighbours.
WIDE_PARTS = 1
#: Fingerprints of one tile that one task holds; larger tiles are split into blocks.
BLOCK = 1 << 16
#: Fingerprints of other blocks that one task compares with its block; more are split over several tasks.
GUESTS = 64 * BLOCK
MOST_TASKS = 100_000
#: Rows and columns of one comparison.
COMPARED = 1024
#: Bytes of a text that are split into words at a time.
TEXT_BLOCK = 1 << 22

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a few megabytes at a time, cut at white space."""
    start = 0
    while start < len(text):
        end = start + TEXT_BLOCK
        found = _SPACE.search(text, end) if end < len(text) else None
        end = found.start() if found else len(text)
        yield text[start:end].lower().split()
        start = end


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined shingles of a text's ASCII-lower-cased words, repeats included."""
    from xxhash import xxh64_intdigest

    held: list[bytes] = []
    any_yet = False
    for words in _word_blocks(text):
        words = held + words
        if len(words) >= shingle:
            any_yet = True
            joined = b" ".join(words)
            ends = list(itertools.accumulate(len(w) + 1 for w in words))
            starts = [0, *ends[:-shingle]]
            hashes = [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
            yield np.array(hashes, dtype=np.uint64)
            words = words[len(words) - shingle + 1 :]
        held = words
    if not any_yet and held:
        yield np.array([xxh64_intdigest(b" ".join(held), SEED)], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if set in over half the hashes; a text without words has 0."""
    counts, total = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        for i in range(0, len(hashes), 1 << 14):
            part = hashes[i : i + (1 << 14)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int32)
        total += len(hashes)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def _majority(hashes: np.ndarray, weights: np.ndarray) -> int:
    """A bit is 1 if set in hashes of over half the weight."""
    counts, total = np.zeros(64, dtype=np.int64), int(weights.sum())
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += weights[i : i + (1 << 14)] @ bits
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def word_fingerprint(text: bytes) -> int:
    """Of the different words, each with the number of binary digits of its count as the weight."""
    from xxhash import xxh64_intdigest

    counts: Counter[bytes] = Counter()
    for words in _word_blocks(text):
        counts.update(words)
    hashes = np.fromiter((xxh64_intdigest(w, SEED) for w in counts), np.uint64, len(counts))
    return _majority(hashes, np.fromiter((n.bit_length() for n in counts.values()), np.int64, len(counts)))


def _fingerprint_batches(names: list[str], prints: list[Callable[[bytes], int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, tuple[int, ...]] = {}
            out = []
            for text in batch.column("whole"):
                text = text.as_py()
                if (fps := known.get(seen := common.mark(text))) is None:
                    fps = known[seen] = tuple(f(text) for f in prints)
                out.append(fps)
            columns = [pa.array(np.array(c, dtype=np.uint64).view(np.int64), pa.int64()) for c in zip(*out, strict=True)]
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns], ["doc_id", "key", *names])

    return run


def fingerprints(docs: DataFrame, text: str = "text", words: bool = False) -> DataFrame:
    """doc_id, key, fp of every row, as signed 64-bit numbers; null text is empty.

    With `words` fp is that of the words, and `other` that of the shingles.
    """
    whole = common.text_or_empty(text)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.row_key(text).alias("key"), whole.cast("binary").alias("whole"))
    names, prints = (["fp", "other"], [word_fingerprint, fingerprint]) if words else (["fp"], [fingerprint])
    return common.in_python(rows, _fingerprint_batches(names, prints), "doc_id bigint, key bigint, " + ", ".join(f"{n} bigint" for n in names))


def _tile(fp: Column, parts: int) -> Column:
    """The population counts of the parts, as the digits of one number."""
    bits = 64 // parts
    held = [F.shiftrightunsigned(fp, bits * p).bitwiseAND((1 << bits) - 1) for p in range(parts)] if parts > 1 else [fp]
    counts = [F.bit_count(h).cast("bigint") for h in held]
    number = counts[0]
    for c in counts[1:]:
        number = number * (bits + 1) + c
    return number


def _half_neighbours(radius: int, parts: int) -> list[tuple[int, ...]]:
    """One of each pair of opposite steps between tiles whose counts differ by 1 to radius in sum."""

    def steps(left: int, dimensions: int) -> Iterator[tuple[int, ...]]:
        if not dimensions:
            yield ()
            return
        for first in range(-left, left + 1):
            for rest in steps(left - abs(first), dimensions - 1):
                yield (first, *rest)

    return [s for s in steps(radius, parts) if any(s) and next(x for x in s if x) > 0]


def _visited(tile: Column, radius: int, parts: int) -> Column:
    """The other tiles in which a tile's fingerprints are compared."""
    bits = 64 // parts
    side = bits + 1
    weights = [side**p for p in reversed(range(parts))]
    digits = [F.floor(tile / w).cast("int") % side for w in weights]
    near = []
    for step in _half_neighbours(radius, parts):
        inside = F.lit(True)
        for d, s in zip(digits, step, strict=True):
            if s:
                inside = inside & (d + s).between(0, bits)
        near.append(F.when(inside, tile + sum(s * w for s, w in zip(step, weights, strict=True))))
    return F.filter(F.array(*near), lambda t: t.isNotNull())


def _levels(parts: int) -> list[int]:
    """Numbers of finer parts by whose counts a tile is sorted."""
    return [2 * parts, 4 * parts] if parts == 1 else [2 * parts]


class _Sorted:
    """Fingerprints in the order of the counts of fine parts, cut into small tiles with their ranges of counts."""

    def __init__(self, fps: np.ndarray, others: np.ndarray | None, parts: int):
        self.ranges: list[tuple[np.ndarray, np.ndarray]] = []
        if len(fps) > COMPARED:
            levels = []
            for n in _levels(parts):
                bits = 64 // n
                levels.append([np.bitwise_count(fps >> np.uint64(bits * p) & np.uint64((1 << bits) - 1)) for p in range(n)])
            order = np.lexsort([c for counts in levels[::-1] for c in counts])
            fps, others = fps[order], None if others is None else others[order]
            starts = np.arange(0, len(fps), COMPARED)
            for counts in levels:
                ordered = [c[order] for c in counts]
                low = np.stack([np.minimum.reduceat(c, starts) for c in ordered], axis=1).astype(np.int16)
                high = np.stack([np.maximum.reduceat(c, starts) for c in ordered], axis=1).astype(np.int16)
                self.ranges.append((low, high))
        self.fps, self.others = fps, others

    def near(self, other: _Sorted, i: int, radius: int) -> np.ndarray:
        """Small tiles of the other that may have links with the i-th."""
        n = -(-len(other.fps) // COMPARED)
        near = np.ones(n, bool)
        for (low, high), (o_low, o_high) in zip(self.ranges, other.ranges, strict=False):
            near &= np.maximum(np.maximum(o_low - high[i], low[i] - o_high), 0).sum(axis=1) <= radius
        return np.nonzero(near)[0]


def _links(home: _Sorted, guests: _Sorted, radius: int, other_radius: int) -> list[np.ndarray]:
    """Both ends of a forest's edges between home and guests (which may be home): fingerprints, then the other ones."""
    xor, counts = np.empty(COMPARED * COMPARED, np.uint64), np.empty(COMPARED * COMPARED, np.uint8)
    found: list[list[np.ndarray]] = []
    for i in range(-(-len(home.fps) // COMPARED)):
        a = home.fps[i * COMPARED : (i + 1) * COMPARED]
        for j in home.near(guests, i, radius).tolist():
            if guests is home and j < i:
                continue
            b = guests.fps[j * COMPARED : (j + 1) * COMPARED]
            n = len(a) * len(b)
            np.bitwise_xor(a[:, None], b[None, :], out=xor[:n].reshape(len(a), len(b)))
            np.bitwise_count(xor[:n], out=counts[:n])
            x, y = np.divmod(np.flatnonzero(counts[:n] <= radius), len(b))
            both = [np.concatenate([a, b])]
            if home.others is not None and guests.others is not None:
                c, d = home.others[i * COMPARED : (i + 1) * COMPARED], guests.others[j * COMPARED : (j + 1) * COMPARED]
                linked = np.bitwise_count(c[x] ^ d[y]) <= other_radius
                x, y = x[linked], y[linked]
                both.append(np.concatenate([c, d]))
            if len(x):
                label = local_labels(len(a) + len(b), x, y + len(a))
                ends = [e for v in both for e in (v, v[label])]
                apart = np.any([ends[k] != ends[k + 1] for k in range(0, len(ends), 2)], axis=0)
                found.append([e[apart] for e in ends])
    return [np.concatenate(e) for e in zip(*found, strict=True)]


def _compare(radius: int, other_radius: int, parts: int, columns: list[str]):
    names = [f"{c}_{end}" for c in columns for end in "uv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile, block, share, and residents before guests. Held: a block's residents and one batch."""
        now, residents, home = None, [], None

        def sorted_(held: list[list[np.ndarray]]) -> _Sorted:
            fps, *others = [np.concatenate([np.zeros(0, np.uint64), *c]) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.uint64)] * len(columns)
            return _Sorted(fps, others[0] if others else None, parts)

        def edges(guests: _Sorted | None = None) -> Iterator[pa.RecordBatch]:
            """Links among the residents, once they are all there and in the first share, or of guests with them."""
            nonlocal home
            if home is None:
                home = sorted_(residents)
                if now is not None and now[2] == 0:
                    yield from sent(_links(home, home, radius, other_radius))
            if guests is not None:
                yield from sent(_links(home, guests, radius, other_radius))

        def sent(ends: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if ends and len(ends[0]):
                yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)) for e in ends], names)

        for batch in batches:
            place = [batch.column(c).to_numpy() for c in ("tile", "block", "share", "guest")]
            values = [batch.column(c).to_numpy().view(np.uint64) for c in columns]
            change = np.nonzero(np.any([np.diff(c) != 0 for c in place], axis=0))[0] + 1
            for a, b in itertools.pairwise([0, *change.tolist(), len(values[0])]):
                if a == b:
                    continue
                if (at := tuple(int(c[a]) for c in place[:3])) != now:
                    yield from edges()
                    now, residents, home = at, [], None
                if place[3][a]:
                    yield from edges(sorted_([[v[a:b] for v in values]]))
                else:
                    residents.append([v[a:b] for v in values])
        yield from edges()

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, parts: int | None = None, other_radius: int = 64) -> DataFrame:
    """Edges fp_u, fp_v that connect the distinct fingerprints (column fp) just as all pairs within the radius do.

    With a column `other` rows are distinct pairs of fingerprints, linked if those differ by other_radius at most
    too; edges have other_u and other_v as well. A tile's block of residents meets its guests in shares of bounded
    size. The work grows with the square of the number of fingerprints, times the share of pairs of small tiles
    that aren't skipped.
    """
    columns = [c for c in ("fp", "other") if c in fps.columns]
    parts = parts or (FEW_PARTS if fps.count() < MANY else MANY_PARTS)
    tiled = fps.select(*columns, _tile(F.col("fp"), parts).cast("int").alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    seen = sizes.select("n", F.explode(_visited(F.col("tile"), radius, parts)).alias("tile")).groupBy("tile").agg(F.sum("n").alias("away"))
    met = F.col("n") + F.coalesce("away", F.lit(0))
    sizes = sizes.join(seen, "tile", "left").select(
        F.col("tile").alias("t"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(met / GUESTS).cast("int")).alias("shares"),
        met.alias("met"),
    )
    sizes = common.cut(sizes)
    # So many tasks, since rows cost far more to compare than their bytes tell.
    tasks = max(1, math.ceil((sizes.agg(F.sum(F.col("met") * F.col("blocks"))).first()[0] or 0) / BLOCK))
    sizes = common.broadcast_if_small(sizes.drop("met"))
    hashed = F.xxhash64(*columns)
    dealt = ["tile", "block", "share", "guest", *columns]
    share = lambda n: F.pmod(F.shiftright(hashed, 20), n).cast("int")
    # At home: in its own block a resident of all shares, in the blocks before that a guest. Elsewhere a guest in all blocks.
    home = tiled.join(sizes, F.col("tile") == F.col("t")).withColumn("own", F.pmod(hashed, F.col("blocks")).cast("int"))
    guest = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda b: F.struct(b.alias("block"), share(F.col("shares")).alias("share"), F.lit(1).alias("guest")))
    resident = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda s: F.struct(F.col("own").alias("block"), s.cast("int").alias("share"), F.lit(0).alias("guest")))
    placed = F.when(F.col("own") > 0, F.concat(guest, resident)).otherwise(resident)
    home = home.select("tile", F.inline(placed), *columns).select(dealt)
    away = tiled.select(*columns, F.explode(_visited(F.col("tile"), radius, parts)).alias("tile")).join(sizes, F.col("tile") == F.col("t"))
    away = away.select("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), share(F.col("shares")).alias("share"), F.lit(1).alias("guest"), *columns)
    fine = [_tile(F.col("fp"), n) for n in _levels(parts)]  # batches of guests then have narrow ranges of counts
    dealt = home.union(away).repartition(min(tasks, MOST_TASKS), "tile", "block", "share").sortWithinPartitions("tile", "block", "share", "guest", *fine)
    schema = ", ".join(f"{c}_{end} bigint" for c in columns for end in "uv")
    return common.in_python(dealt, _compare(radius, other_radius, parts, columns), schema)


def simhash_groups(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, key, fp, component_id, first.

    component_id is the smallest doc_id that links of fingerprints within the radius reach; nulls only where
    a component has no other. first marks one document of each component: the smallest doc_id, then key.
    Equal fingerprints are one node, so copies in any number make no pairs. Texts without words have
    fingerprint zero, linked like any other. Empty table: empty result. Other columns aren't read.
    """
    common.require(docs, doc_id="bigint", **{text: "string"})
    rows = common.cut(fingerprints(docs, text))
    nodes = common.cut(rows.groupBy("fp").agg(_least().alias("least")))
    edges = fingerprint_links(nodes, radius).select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v"))
    return _grouped(rows, nodes.withColumn("node", F.col("fp")), edges, ["fp"])


def near_groups(docs: DataFrame, text: str = "text", radius: int = WORD_RADIUS, shingle_radius: int = SHINGLE_RADIUS) -> DataFrame:
    """One row per document: doc_id, key, fp, other, component_id, first, as of simhash_groups.

    Documents are linked if their fingerprints of words differ in `radius` bits at most and their fingerprints of
    shingles in `shingle_radius`. Texts without words have zeros.
    """
    common.require(docs, doc_id="bigint", **{text: "string"})
    rows = common.cut(fingerprints(docs, text, words=True))
    nodes = rows.groupBy("fp", "other").agg(_least().alias("least"))
    nodes = common.cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    edges = common.cut(fingerprint_links(nodes.select("fp", "other"), radius, WIDE_PARTS, shingle_radius))
    end = lambda e: nodes.select(F.col("fp").alias(f"fp_{e}"), F.col("other").alias(f"other_{e}"), F.col("node").alias(e))
    edges = edges.join(end("u"), ["fp_u", "other_u"]).join(end("v"), ["fp_v", "other_v"]).select("u", "v")
    return _grouped(rows, nodes, edges, ["fp", "other"])


def _least() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key"))


def _grouped(rows: DataFrame, nodes: DataFrame, edges: DataFrame, names: list[str]) -> DataFrame:
    roots = components(edges).withColumnRenamed("node", "r_node")
    rooted = nodes.join(roots, F.col("node") == F.col("r_node"), "left")
    rooted = common.cut(rooted.select(*names, F.coalesce("root", "node").alias("root"), "least"))
    # Cut, so that the side of the nodes is a plain shuffle, in which Spark can split a large component.
    least = common.cut(rooted.groupBy("root").agg(F.min("least").alias("least")))
    of = rooted.select(*[F.col(n).alias(f"n_{n}") for n in names], "root").join(least, "root")
    same = functools.reduce(lambda a, b: a & b, [F.col(n) == F.col(f"n_{n}") for n in names])
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key"))
    return rows.join(of, same).select("doc_id", "key", *names, F.col("least.doc_id").alias("component_id"), first.alias("first"))


def drop_near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of one document of each of near_groups' components; rows that repeat doc_id and text are one document."""
    decided = near_groups(docs, text).select("doc_id", "key", F.col("first").alias("kept"))
    return common.keep_rows(docs, common.cut(decided), common.row_key(text))
