"""Best-fit packing of token sequences by exact complements.

How pieces combine depends on their lengths alone, and there are at most `capacity` lengths, so a plan is
made from the histogram of lengths, whatever the number of documents. The plan takes the lengths from the
longest down and looks up in an index of sums which single available length fills the gap exactly, else which
pair, else which triple; a combination is used as often as the counts allow. Where none fills the gap, the longest
length that fits it is added, as best fit does, and the rest of the gap is looked up again. Then rounds of repair
take the sequences that aren't full and some that are apart and fill them anew, while that needs no more sequences.
Pieces then find their place by their rank among the pieces of the same length.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY, END_ID = 1024, 2
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Rounds of repair, and combinations that one takes apart at most.
ROUNDS, APART = 100, 120
#: Pieces that one task numbers.
PIECES_PER_BUCKET = 50_000
#: Texts with a longer run without change between space and other characters go to the tokenizer itself.
LONG_RUN = 500

_loaded: dict = {}


def _tokenizer(path: str | None = None):
    """Texts to ids. The same vocabulary is loaded by two libraries, of which the faster takes plain texts."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path(TOKENIZER)
    if path not in _loaded:
        whole = Tokenizer.from_file(path)
        fast = None
        if path == public_tokenizers.path(TOKENIZER):
            with open(public_tokenizers.path(RANKS), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        specials = [t.content for t in whole.get_added_tokens_decoder().values()]
        odd = re.compile("|".join([*map(re.escape, specials), rf"\S{{{LONG_RUN}}}", rf"\s{{{LONG_RUN}}}"]))
        _loaded[path] = (whole, fast, odd)
    return _loaded[path]


def token_ids(text: str, path: str | None = None) -> list[int]:
    """The ids of a whole text and then END_ID.

    Special tokens in the text and very long runs are left to the tokenizer, whose work on a run doesn't
    grow with its square.
    """
    whole, fast, odd = _tokenizer(path)
    if fast is None or odd.search(text):
        return [*whole.encode(text, add_special_tokens=False).ids, END_ID]
    ids = fast.encode_ordinary(text)
    ids.append(END_ID)
    return ids


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only a first piece may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _piece_batches(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, list[tuple[int, int, int, int]]] = {}
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                if (found := known.get(seen := common.mark(text.encode()))) is None:
                    ids = np.array(token_ids(text, path), dtype="<u4")
                    found = [(i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut_points(len(ids), capacity))]
                    known[seen] = found
                rows += [(doc_id, *x) for x in found]
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; a null text is empty and has one piece of one id."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_or_empty(text).alias("text"))
    return common.in_python(rows, _piece_batches(path, capacity), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


Combination = tuple[tuple[int, ...], int]  # lengths of one sequence, and how many sequences have them


class SumIndex:
    """The available lengths with their counts: by the sum that they have alone, in pairs and in triples.

    Counts only fall, so a pair that was used up is dropped from its sum's list for good.
    """

    def __init__(self, left: np.ndarray):
        self.left = left.tolist()
        self.lengths = [k for k in range(len(self.left) - 1, 0, -1) if self.left[k]]
        self._pairs: dict[int, list[int]] = {}

    def spare(self, length: int, taken: Sequence[int]) -> bool:
        return 0 < length < len(self.left) and self.left[length] > taken.count(length)

    def longest(self, most: int, taken: Sequence[int]) -> int | None:
        return next((k for k in self.lengths if k <= most and self.spare(k, taken)), None)

    def single(self, total: int, taken: Sequence[int]) -> tuple[int, ...] | None:
        return (total,) if self.spare(total, taken) else None

    def pair(self, total: int, taken: Sequence[int], order: int = 1, most: int | None = None) -> tuple[int, ...] | None:
        """Two lengths of this sum, the longer first; order 1 prefers the longest, -1 the most equal."""
        if total not in self._pairs:
            self._pairs[total] = [a for a in self.lengths if total > a >= total - a and self.left[total - a]]
        held = self._pairs[total]
        if any(not self.left[a] or not self.left[total - a] for a in held):
            held[:] = [a for a in held if self.left[a] and self.left[total - a]]
        for a in held[::order]:
            if (most is None or a <= most) and self.spare(a, taken) and self.spare(total - a, (*taken, a)):
                return a, total - a
        return None

    def triple(self, total: int, taken: Sequence[int], order: int = 1) -> tuple[int, ...] | None:
        for a in self.lengths:
            if a < total - 1 and 3 * a >= total and self.spare(a, taken) and (two := self.pair(total - a, (*taken, a), order, a)):
                return (a, *two)
        return None

    def use(self, lengths: Sequence[int], times: int) -> None:
        for k in lengths:
            self.left[k] -= times
        self.lengths = [k for k in self.lengths if self.left[k]]


def filled(left: np.ndarray, most_partners: int = 3, choose: random.Random | None = None) -> list[Combination]:
    """Combinations that hold every piece of a histogram; `choose` varies them."""
    index, capacity, found = SumIndex(left), len(left) - 1, []
    while index.lengths:
        lengths = [index.lengths[0]]
        while gap := capacity - sum(lengths):
            order = choose.choice((1, -1)) if choose else 1
            exact = index.single(gap, lengths) if most_partners else None
            if not exact and most_partners > 1:
                exact = index.pair(gap, lengths, order)
            if not exact and most_partners > 2:
                exact = index.triple(gap, lengths, order)
            if exact:
                lengths += exact
                break
            if (fits := index.longest(gap, lengths)) is None:
                break
            if choose and choose.random() < 0.3:
                fits = index.longest(choose.randint(1, fits), lengths) or fits
            lengths.append(fits)
        times = min(index.left[k] // n for k, n in Counter(lengths).items())
        if choose and 1 < times <= APART:
            times = choose.randint(1, times)
        index.use(lengths, times)
        found.append((tuple(lengths), times))
    return found


def _count(combinations: Iterable[Combination]) -> int:
    return sum(times for _, times in combinations)


def repaired(combinations: list[Combination], capacity: int, bound: int, seed: int = 0) -> list[Combination]:
    """Fills sequences that aren't full, and some others, anew; never more sequences, and no fewer than the bound."""
    choose = random.Random(seed)
    for _ in range(ROUNDS):
        if _count(combinations) <= bound:
            break
        sums = [sum(lengths) for lengths, _ in combinations]
        part = [i for i, n in enumerate(sums) if n < capacity]
        part = set(part if len(part) <= APART else choose.sample(part, APART))
        whole = [i for i, n in enumerate(sums) if n == capacity and len(combinations[i][0]) > 1]
        part |= set(choose.sample(whole, min(len(whole), choose.randint(1, APART))))
        left = np.zeros(capacity + 1, np.int64)
        for i in part:
            for k in combinations[i][0]:
                left[k] += combinations[i][1]
        anew = filled(left, choose=choose)
        if _count(anew) <= _count(combinations[i] for i in part):
            combinations = [c for i, c in enumerate(combinations) if i not in part] + anew
    return combinations


class Plan:
    """For each length, which of its pieces by rank go to which sequence and offset."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, most_partners: int = 3):
        left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"length {length}")
            left[length] = n
        #: No plan has fewer sequences: by the tokens, and by the pieces of which no two fit one sequence.
        self.bound = max(-(-sum(k * n for k, n in counts.items()) // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
        self.capacity, self.sequences = capacity, 0
        self.used = np.zeros(capacity + 1, dtype=np.int64)
        #: By length: (first rank, first sequence, offset); each holds until the next one's first rank.
        self.places: dict[int, list[tuple[int, int, int]]] = {}
        for lengths, times in repaired(filled(left, most_partners), capacity, self.bound):
            offset = 0
            for length in lengths:
                self.places.setdefault(length, []).append((int(self.used[length]), self.sequences, offset))
                self.used[length] += times
                offset += length
            self.sequences += times

    def arrays(self) -> dict[int, np.ndarray]:
        return {length: np.array(sorted(rows), dtype=np.int64).T for length, rows in self.places.items()}


def _placer(places: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.nonzero(length == n)[0]
                first, base, where = places[n]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = base[k] + rank[at] - first[k], where[k]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and END_ID; null text counts as empty. Repeated rows and null doc_ids are
    documents like others; equal pieces of equal doc_id are interchangeable. Sequences are numbered from 0.
    Empty table: empty result. Other columns aren't read. The driver gets one count for each length.
    """
    common.require(docs, doc_id="bigint", **{text: "string"})
    cutup = common.cut(pieces(docs, text, path, capacity))
    counts = {r["length"]: r["n"] for r in cutup.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(counts, capacity)
    at = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece", "ids_crc32"))
    keyed = cutup.withColumn("at", at)
    digits = common.bucket_digits(sum(counts.values()), PIECES_PER_BUCKET)
    ranked = common.gapless_rank(keyed, ["length"], [F.col("doc_id"), F.col("piece")], "at", digits, "rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("bigint").alias("rank"))
    return common.in_python(ranked, _placer(plan.arrays()), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
