"""Secret scans: patterns of assignments, access keys and hexadecimal keys, and windows of high Shannon entropy.

Candidates for entropy are long runs of key characters. A window slides over a candidate; its character
counts, and with them its entropy, are updated by the character that enters and the one that leaves. What is
high depends on the character class, of the candidate and of each of its parts between signs, so that sig= or
sk- before a key doesn't change the key's class. An allow-list suppresses what is known not to be a secret.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
LEAST_ASSIGNED = 12
#: A run of the class is matched whole, so that the least length may be part of the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

WINDOW = 20
#: Bits a character that a window of a class must reach; log2(20) = 4.32 is the most.
THRESHOLDS = {"hex": 3.2, "one case": 3.4, "alphanumeric": 3.75, "base64": 3.85}
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
_HEX_CLASS = re.compile(r"[0-9a-fA-F]+")
_ONE_CASE_CLASS = re.compile(r"[a-z0-9]+|[A-Z0-9]+")
_ALPHANUMERIC_CLASS = re.compile(r"[A-Za-z0-9]+")
_PART = re.compile(rf"[A-Za-z0-9]{{{WINDOW},}}")

#: Never secrets, matched against the whole candidate or part: UUIDs, plain numbers and dates, words joined by signs,
#: paths of words, and rules of one or two signs. No repeated group can begin
#: with what may end the one before, so that a match takes linear time.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9+/_=-]+",
    r"[A-Za-z+/_=-]*[0-9]{0,4}",
    r"(?:[A-Za-z]+[0-9]{0,4}[+/_=-]+)+(?:[A-Za-z]+[0-9]{0,4})?",
)
#: Not secrets: the parts between signs that one of them lies in. The rest of a candidate is scanned.
ALLOWED_WORDS = (
    "example", "EXAMPLE", "placeholder", "abcdefghij", "ABCDEFGHIJ", "0123456789abcdef", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
)
#: Letters of both cases aren't words if more than one in so many of their runs of one case is a single small letter
#: or several capitals.
IRREGULAR = 4
_LETTERS = re.compile(rf"[A-Za-z]{{{WINDOW},}}")
_RUNS = re.compile(r"[a-z]+|[A-Z]+")
_SEGMENT = re.compile(r"[A-Za-z0-9]+")

_N_LOG = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


class Scanner:
    def __init__(self, allowed: tuple[str, ...] = ALLOWED, words: tuple[str, ...] = ALLOWED_WORDS, thresholds: dict[str, float] = THRESHOLDS):
        self.allowed = [re.compile(p) for p in allowed]
        self.words, self.thresholds = words, thresholds

    def suppressed(self, candidate: str) -> bool:
        return any(p.fullmatch(candidate) for p in self.allowed) and not any(mixed_letters(x) for x in _LETTERS.findall(candidate))

    def open_parts(self, candidate: str) -> Iterator[tuple[int, int]]:
        """What is left of a candidate without the parts between signs that hold an allowed word."""
        words = sorted((m.start(), m.end()) for w in self.words if w in candidate for m in re.finditer(re.escape(w), candidate))
        start = at = 0
        if words:
            furthest = list(itertools.accumulate((b for _, b in words), max))
            for m in _SEGMENT.finditer(candidate):
                while at < len(words) and words[at][0] < m.end():
                    at += 1
                if at and furthest[at - 1] > m.start():
                    yield start, m.start()
                    start = m.end()
        yield start, len(candidate)

    def high_parts(self, candidate: str) -> Iterator[tuple[int, int]]:
        """Joined windows whose entropy reaches the class's threshold."""
        if _HEX_CLASS.fullmatch(candidate):
            kind = "hex"
        elif _ONE_CASE_CLASS.fullmatch(candidate):
            kind = "one case"
        else:
            kind = "alphanumeric" if _ALPHANUMERIC_CLASS.fullmatch(candidate) else "base64"
        # entropy = log2(WINDOW) - sum(n log2 n) / WINDOW
        most = (math.log2(WINDOW) - self.thresholds[kind]) * WINDOW + 1e-9
        counts: dict[str, int] = {}
        total, start, end = 0.0, -1, -1
        for i, c in enumerate(candidate):
            if i >= WINDOW:
                gone = candidate[i - WINDOW]
                n = counts[gone]
                counts[gone] = n - 1
                total += _N_LOG[n - 1] - _N_LOG[n]
            n = counts.get(c, 0)
            counts[c] = n + 1
            total += _N_LOG[n + 1] - _N_LOG[n]
            if i >= WINDOW - 1 and total <= most:
                first = i - WINDOW + 1
                if first > end:
                    if end > 0:
                        yield start, end
                    start = first
                end = i + 1
        if end > 0:
            yield start, end

    def base(self, text: str) -> list[Span]:
        found = [Span("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
        found += [Span("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
        found += [Span("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
        return ordered(found)

    def entropy(self, text: str) -> list[Span]:
        found = []
        for m in _CANDIDATE.finditer(text):
            for at, end in self.open_parts(m[0]):
                whole = m[0][at:end]
                parts = [(0, whole), *((p.start(), p[0]) for p in _PART.finditer(whole) if p[0] != whole)]
                high = [(i + a, i + b) for i, part in parts if len(part) >= WINDOW and not self.suppressed(part) for a, b in self.high_parts(part)]
                found += [Span("entropy", m.start() + at + a, m.start() + at + b) for a, b in joined(high)]
        return found


def mixed_letters(letters: str) -> bool:
    """Letters whose case changes as in a key and not as in words: a word's capital is one, and small letters follow."""
    runs = _RUNS.findall(letters)
    return len(runs) > 2 and IRREGULAR * sum((len(r) == 1) == r.islower() for r in runs) > len(runs)


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch become one."""
    whole: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if whole and a <= whole[-1][1]:
            whole[-1] = (whole[-1][0], max(b, whole[-1][1]))
        else:
            whole.append((a, b))
    return whole


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def _scan_batches(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                base = scanner.base(text)
                spans = ordered(base + scanner.entropy(text))
                sha = hashlib.sha256(",".join(map(str, base)).encode()).hexdigest()
                rows.append((*(sum(s.kind == k for s in base) for k in KINDS[:3]), sha, ",".join(map(str, spans)), len(spans) - len(base)))
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return run


def scan_secrets(docs: DataFrame, text: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Spans are kind:start:end in code points, the end exclusive, by start and kind. Null text is empty and has
    none. Null doc_ids and repeated rows are scanned like others. Empty table: empty result. Other columns
    aren't read.
    """
    common.require(docs, doc_id="bigint", **{text: "string"})
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_or_empty(text).alias("text"))
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_entropy bigint"
    return common.in_python(rows, _scan_batches(scanner or Scanner()), schema)
