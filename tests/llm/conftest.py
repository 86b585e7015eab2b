from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use themselves.
CLASHING = "key string, row string, fp string, digest string, keep_id string, shard int, slot string, copy string, position string, rank string, __b string, __n int, m_id string, at string, d_id string"

WORDS = "the of and river stone quiet morning walked under seven lamps because nothing else remained there while distant bells rang across empty fields".split()


def prose(seed: int, n: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def document(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, len(text) if text is not None else None)


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text, lang, source) rows."""

    def make(rows, extra=False):
        rows = [document(*r) for r in rows]
        if not extra:
            return spark.createDataFrame(rows, DOCUMENTS)
        added = ("k", "r", "f", "d", "x", 3, "s", "c", "p", "q", "b", 4, "m", "a", "i")
        return spark.createDataFrame([(*r, *added) for r in rows], f"{DOCUMENTS}, {CLASHING}")

    return make


LONG = prose(99, 200_000)  # over a megabyte

#: Null and empty texts, no words, null doc_ids, repeated rows, ties, very long texts, nulls in all columns.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, prose(4)),
    (4, prose(4)),
    (None, prose(5)),
    (None, None, None, None),
    (6, prose(4).upper()),
    (7, LONG, "de", "s1"),
    (8, "ein Wort", None, "s1"),
    (9, "ÀÉ \U0001f600 ﬁ́", "fr", None),
    (-10, "a" * 5000, "es", "s2"),
]


@pytest.fixture
def odd(docs):
    return docs(ODD, extra=True)


@pytest.fixture
def none(docs):
    return docs([])
