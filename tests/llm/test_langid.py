import random
import zlib

import numpy as np
import pytest

from tamarack.llm import common, langid

from .conftest import ODD



@pytest.fixture(autouse=True)
def fewer_steps(monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 1000)


SYLLABLES = {"en": "the th ing and er of", "de": "sch ung der ein ich ß", "fr": "eau que le é oi ent"}


def text(lang, seed, n=40):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def labelled(n=300):
    return [(i, text(lang := list(SYLLABLES)[i % 3], i), lang, "s") for i in range(n)]


def test_counts_do_not_depend_on_blocks(monkeypatch):
    sample = (text("de", 1, 400) + " Ünï 123 ") * 3
    whole = langid.subword_counts(sample)
    monkeypatch.setattr(langid, "TEXT_BLOCK", 17)
    assert (langid.subword_counts(sample) == whole).all() and whole.sum() > 3 * len(sample) // 2
    assert langid.subword_counts("").sum() == 0 and langid.subword_counts("12 -").sum() == 0


def naive_counts(text):
    """Each two, three and four byte piece of each word with a space at its ends, not both, hashed one by one."""
    counts = np.zeros(langid.BUCKETS, np.int64)
    raw = "".join(chr(c) if 97 <= c <= 122 or c >= 128 else " " for c in text.lower().encode())
    for word in filter(None, raw.split(" ")):
        held = b" " + bytes(ord(c) for c in word) + b" "
        for n in (2, 3, 4):
            for i in range(len(held) - n + 1):
                if held[i] == held[i + n - 1] == 32:
                    continue
                code = int.from_bytes(held[i : i + n], "big")
                mixed = (code * 0x9E3779B1 & 0xFFFFFFFF) ^ n
                mixed = ((mixed ^ mixed >> 15) * 0x85EBCA6B) & 0xFFFFFFFF
                counts[mixed >> 20] += 1
    return counts


@pytest.mark.parametrize("sample", ["", "a", "ab c", "Ünï çà 123 x-y", "日本語 text", text("de", 3), text("fr", 4, 300)])
def test_counts_are_those_of_the_definition(sample):
    assert (langid.subword_counts(sample) == naive_counts(sample)).all()


def test_a_step_goes_down_the_gradient(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(langid, "TABLE_RATE", 1)
    x, y = rng.random((5, 7)), np.array([0, 1, 2, 1, 2])
    model = langid.Model(["a", "b"], rng.normal(size=(7, 4)), rng.normal(size=(4, 3)), rng.normal(size=3))

    def loss():
        return -np.log(langid.softmax(model.logits(x))[np.arange(5), y]).mean()

    slopes = {}
    for name in ("table", "weights", "bias"):
        values = getattr(model, name)
        slopes[name] = np.zeros_like(values)
        for at in np.ndindex(values.shape):
            kept = values[at]
            values[at] = kept + 1e-6
            up = loss()
            values[at] = kept - 1e-6
            slopes[name][at] = (up - loss()) / 2e-6
            values[at] = kept
    before = {n: getattr(model, n).copy() for n in slopes}
    langid.step(model, x, y, 0.1)
    for name, slope in slopes.items():
        assert np.allclose(before[name] - getattr(model, name), 0.1 * slope, atol=1e-7), name


def gibberish(seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxyzaeiou", k=rng.randrange(2, 9))) for _ in range(n))


@pytest.mark.parametrize("n", [150, 600])
def test_rejection_fires_on_texts_of_no_language(docs, n):
    rows = labelled(n)
    model = langid.fit(docs(rows))
    others = [(5000 + i, gibberish(i)) for i in range(200)] + [(6000 + i, "".join(reversed(text("de", i))).replace("e", "q").replace("n", "x")) for i in range(100)]
    fresh = [(7000 + i, text(list(SYLLABLES)[i % 3], 9000 + i)) for i in range(300)]
    found = {r.doc_id: r.rejected for r in langid.identify(docs(others + fresh), model).collect()}
    assert np.mean([found[i] for i, _ in fresh]) <= 0.01
    assert np.mean([found[i] for i, _ in others[:200]]) >= 0.95 and np.mean([found[i] for i, _ in others[200:]]) >= 0.9
    assert model.least_score > 0.1


def test_held_out_accuracy(docs):
    rows = labelled()
    found = langid.identify(docs(rows), langid.fit(docs(rows))).collect()
    truth = {i: lang for i, _, lang, _ in rows}
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0} and len(found) == len(rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_held_out_labels_change_nothing(docs):
    rows = labelled(120)
    changed = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, s) for i, t, lang, s in rows]
    a, b = langid.fit(docs(rows)), langid.fit(docs(changed))
    assert a.languages == b.languages and (a.table == b.table).all()


def test_odd_rows(docs, odd):
    model = langid.fit(docs(labelled()))
    found = langid.identify(odd, model).collect()
    assert len(found) == len(ODD)
    for r in found:
        letters = {i: any(c.isalpha() for c in t or "") for i, t, *_ in ODD if i is not None}
        if r.doc_id in letters and not letters[r.doc_id]:
            assert (r.lang_pred, r.score, r.rejected) == (langid.UNKNOWN, 0.0, True)
        elif r.doc_id is not None:
            assert r.lang_pred in model.languages and r.score > 0
    assert [r.held_out for r in found if r.doc_id is None] == [True, True]


def test_no_labels_one_label_and_none(docs, none):
    assert {r.lang_pred for r in langid.identify(docs(labelled(9)), langid.fit(none)).collect()} == {langid.UNKNOWN}
    assert langid.identify(none, langid.fit(none)).collect() == []
    assert langid.keep_identified(none).collect() == []
    one = docs([(i, t, "en" if i % 2 else None, s) for i, t, _, s in labelled(9)])
    assert {r.lang_pred for r in langid.identify(one, langid.fit(one)).collect()} == {"en"}


def test_filter_keeps_clean_rows_and_columns(docs):
    rows = labelled(200) + [(900, "12345 --- 678"), (901, None), (5, text("en", 5))]
    df = docs(rows, extra=True)
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 900 not in ids and 901 not in ids and len(ids) >= 198


def test_the_sample_is_bounded_and_even(docs):
    rows = [(i, text("en", i, 5), "en") for i in range(400)] + [(1000 + i, text("fr", i, 5), "fr") for i in range(40)]
    counts, labels = langid.sampled(docs(rows), sample=60)
    assert len(labels) <= 120 and 10 < labels.count("fr") < 50 and counts.shape == (len(labels), langid.BUCKETS)


def test_all_of_a_real_table_but_its_hard_cases(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 4000)
    df = common.documents(spark, "/root/testdata/sf0.001")
    truth = {r.doc_id: r.lang for r in df.collect()}
    found = langid.identify(df, langid.fit(df)).collect()
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in found if r.held_out]) > 0.95
