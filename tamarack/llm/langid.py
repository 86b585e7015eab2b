"""Language identification: averaged hashed subword embeddings under a linear softmax, trained in numpy.

A text's subwords are the two, three and four byte pieces of its lower-cased words, word ends marked. Each is
hashed to a row of an embedding table; the mean of the rows goes through a linear layer and a softmax. Both
layers are trained by stochastic gradient descent.

A softmax over the learned languages alone is sure of any text. It therefore has one class more, OTHER, which is
trained on texts of no language: a document's subword counts, of which a part has been moved to other buckets. A
prediction is rejected if the languages' share of the softmax is low. How low is calibrated on part of the sample:
between what the rightly classified documents have and what such texts have.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, DIMENSIONS = 4096, 16
#: The classifier is fitted on about this many labelled documents, in equal parts for each language; never on more than twice as many.
SAMPLE = 4096
FOLDS, CALIBRATION_PART = 5, 5
STEPS, BATCH, RATE = 4000, 32, 1.0
#: The table learns so much faster: a mean's gradient is spread over many rows.
TABLE_RATE = 20
#: Share of rightly classified calibration documents that the rejection may cost, and of texts of no language that may pass.
REJECTED_SHARE, PASSING_SHARE = 0.001, 0.01
#: Texts of no language among a batch's documents, and the greatest part of their counts that stays where it was.
OTHERS, MOST_KEPT = 8, 0.5
#: The log odds of the least score lie so far below the least of the documents' where texts of no language allow it.
MARGIN = 0.5
UNKNOWN = "und"
#: Bytes of text whose subwords are hashed at a time.
TEXT_BLOCK = 1 << 19

#: Bytes that aren't letters become spaces; bytes of two or more byte characters count as letters.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _block_counts(block: bytes, starts: int) -> np.ndarray:
    """Counts of the subwords that begin among the first `starts` bytes."""
    b = np.frombuffer(block, dtype=np.uint8).astype(np.uint32)
    space = b == 32
    counts = np.zeros(BUCKETS, dtype=np.int64)
    code = b.copy()
    for n in (2, 3, 4):
        if len(b) < n:
            break
        code = (code[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
        whole = ~(space[: len(code)] & space[n - 1 :])
        for k in range(1, n - 1):
            whole &= ~space[k : k + len(code)]
        whole[starts:] = False
        mixed = (code[whole] * np.uint32(0x9E3779B1)) ^ np.uint32(n)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        counts += np.bincount(mixed >> np.uint32(20), minlength=BUCKETS)
    return counts


def subword_counts(text: str) -> np.ndarray:
    """How often each bucket is hit by the whole text's subwords."""
    prepared = b" " + text.lower().encode("utf-8").translate(_LETTERS) + b" "
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for start in range(0, len(prepared), TEXT_BLOCK):
        counts += _block_counts(prepared[start : start + TEXT_BLOCK + 3], TEXT_BLOCK)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def shares(counts: np.ndarray) -> np.ndarray:
    """Rows of counts as parts of one."""
    x = counts.astype(np.float32)
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    return x


def foreign(x: np.ndarray, kept: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Shares of texts of no language: of each row's buckets a random part stays, and the others change places.

    OTHERS rows change places alike.
    """
    moved = np.where(random.random(x.shape, dtype=np.float32) < kept[:, None], np.float32(0), x)
    out = x - moved
    for i in range(0, len(x), OTHERS):
        out[i : i + OTHERS] += moved[i : i + OTHERS, random.permutation(x.shape[1])]
    return out


@dataclass
class Model:
    """weights and bias have a column for each language and a last one for OTHER."""

    languages: list[str]
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.table) @ self.weights + self.bias

    def chances(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.logits(x).astype(np.float64) / self.temperature)

    def scores(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chances of the languages for rows of counts, and their sum, by which a prediction is rejected."""
        p = self.chances(shares(counts))[:, : len(self.languages)]
        return p, p.sum(axis=1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def step(model: Model, x: np.ndarray, y: np.ndarray, rate: float) -> None:
    """One step down the gradient of the mean cross entropy of rows of shares with their classes."""
    h = x @ model.table
    p = softmax(h @ model.weights + model.bias)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = p @ model.weights.T
    model.weights -= rate * (h.T @ p)
    model.bias -= rate * p.sum(axis=0)
    model.table -= (rate * TABLE_RATE) * (x.T @ back)


def train(counts: np.ndarray, labels: Sequence[str], seed: int = 0) -> Model:
    """Fits a model on rows of counts; every CALIBRATION_PART-th row is kept to calibrate it."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], dtype=np.int64)
    k, random = len(languages), np.random.default_rng(seed)
    table = random.normal(0, 0.5, (BUCKETS, DIMENSIONS)).astype(np.float32)
    model = Model(languages, table, np.zeros((DIMENSIONS, k + 1), np.float32), np.zeros(k + 1, np.float32))
    if not k:
        return model
    rest = np.arange(len(y)) % CALIBRATION_PART == 0
    if len(y) < 4 * CALIBRATION_PART:
        rest[:] = False
    x = shares(counts)
    fit = np.nonzero(~rest)[0]
    epochs = -(-STEPS * BATCH // len(fit))
    for epoch in range(epochs):
        order = random.permutation(fit)
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            none = foreign(x[rows[:OTHERS]], random.uniform(0, MOST_KEPT, len(rows[:OTHERS])), random)
            step(model, np.concatenate([x[rows], none]), np.concatenate([y[rows], np.full(len(none), k)]), RATE * (1 - epoch / epochs))
    if rest.any():
        calibrate(model, x[rest], y[rest], random)
    return model


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, random: np.random.Generator) -> None:
    """Sets the temperature by the least cross entropy, and the least score by documents and by texts of no language."""
    k = len(model.languages)
    none = foreign(x, np.zeros(len(x)), random)
    both, classes = np.concatenate([x, none]), np.concatenate([y, np.full(len(none), k)])
    z = model.logits(both).astype(np.float64)

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(z / t)[np.arange(len(classes)), classes], 1e-300)).mean())

    model.temperature = min((2.0 ** (e / 4) for e in range(-12, 13)), key=loss)
    odds = log_odds(softmax(z / model.temperature)[:, :k].sum(axis=1))
    own, others = odds[: len(x)], odds[len(x) :]
    right = own[z[: len(x), :k].argmax(axis=1) == y]
    if len(right):
        known, passing = np.quantile(right, REJECTED_SHARE), np.quantile(others, 1 - PASSING_SHARE)
        # Halfway where the two lie apart; else what the documents need.
        least = (known + passing) / 2 if passing < known - 2 * MARGIN else known - MARGIN
        model.least_score = float(1 / (1 + np.exp(-least)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.log(p / (1 - p))


def held_out() -> Column:
    """Documents whose crc32(doc_id as text) mod 5 is 0 are never learned from; a null doc_id counts as empty."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(batch.column("text")):
            counts = subword_counts(text.as_py())
            used = np.nonzero(counts)[0]
            at = pa.array([used.astype("<u2").tobytes()], pa.binary())
            n = pa.array([counts[used].astype("<i4").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, 1), batch.column("draw").slice(i, 1), at, n], ["lang", "draw", "at", "n"])


def sampled(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, list[str]]:
    """Subword counts and languages of the sample, in a fixed order.

    Each language has the same quota; a document is drawn if its hash lies under quota over the language's
    number of documents. All documents count for that number, and no task gathers a language.
    """
    labelled = docs.where(~held_out() & F.col("lang").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    if not sizes:
        return np.zeros((0, BUCKETS), np.int64), []
    quota = max(1.0, sample / len(sizes))
    chances = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, quota / r["n"]))])
    draw = common.hash_unit(F.lit("sample"), F.col("doc_id"))
    drawn = labelled.select("lang", draw.alias("draw"), common.text_or_empty(text).alias("text")).where(F.col("draw") < chances[F.col("lang")])
    rows = common.in_python(drawn, _count_batches, "lang string, draw double, at binary, n binary").limit(2 * sample).collect()
    rows.sort(key=lambda r: (r["draw"], r["lang"], r["at"], r["n"]))
    counts = np.zeros((len(rows), BUCKETS), np.int32)
    labels = [r["lang"] for r in rows]
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<i4")
        rows[i] = None
    return counts, labels


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    counts, labels = sampled(docs, text, sample)
    return train(counts, labels)


def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            langs: list[str] = []
            scores: list[float] = []
            rejected: list[bool] = []
            for i in range(0, len(texts), 64):
                part = texts.slice(i, 64).to_pylist()
                known = [has_letter(t) and bool(model.languages) for t in part]
                counts = np.zeros((len(part), BUCKETS), np.float32)
                for row, (t, k) in enumerate(zip(part, known, strict=True)):
                    if k:
                        counts[row] = subword_counts(t)
                if not model.languages:
                    s, known_share = np.zeros((len(part), 1)), np.zeros(len(part))
                else:
                    s, known_share = model.scores(counts)
                best = s.argmax(axis=1)
                langs += [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                scores += [float(x[b]) if k else 0.0 for x, b, k in zip(s, best, known, strict=True)]
                rejected += [not k or share < model.least_score for k, share in zip(known, known_share.tolist(), strict=True)]
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                [*kept, "lang_pred", "score", "rejected"],
            )

    return run


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, key for every row, from the whole text alone.

    A null text or one without a letter is `und` with score 0. With no labelled document all are. A rejected
    prediction still names its language; `und` is always rejected. Repeated rows each get a row.
    """
    common.require(docs, doc_id="bigint", **{text: "string"})
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.xxhash64(common.text_or_empty(text)).alias("key"), common.text_or_empty(text).alias("text")
    )
    return common.in_python(rows, _predictor(model), "doc_id bigint, held_out boolean, key bigint, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """All columns of the documents whose language isn't rejected."""
    decided = identify(docs, fit(docs, text, sample), text)
    gone = common.cut(decided.where("rejected").select("doc_id", "key").distinct())
    return common.without(docs, gone, F.xxhash64(common.text_or_empty(text)))
