import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tamarack.llm import substring_dedup as D
from tamarack.llm.queries import QUERIES

from .conftest import ODD, prose


def naive_chunks(text):
    """Start and end of each chunk by the definition, one byte and one window at a time."""
    h, hashes = 0, []
    for b in text:
        h = ((h << 1) + int(D._GEAR[b])) & 0xFFFF
        hashes.append(h)
    at = set()
    for i in range(D.GEAR - 1, len(text) - D.REACH + 1):
        window = hashes[i : i + D.REACH]
        at |= {i + k + 1 for k, x in enumerate(window) if x == min(window)}
    found = []
    for a in sorted(at):
        if later := [b for b in at if b >= a + D.LEAST_CHUNK]:
            found.append((a, min(later)))
    whole = []
    for a, b in found:
        if whole and text[whole[-1][2] : whole[-1][1]] == text[a:b] and a <= whole[-1][1]:
            whole[-1] = (whole[-1][0], b, a)
        else:
            whole.append((a, b, a))
    return [(a, b, text[last:b]) for a, b, last in whole]


def long_enough(whole, a, b):
    words = sum(not whole[i : i + 1].isspace() and (i == 0 or whole[i - 1 : i].isspace()) for i in range(a, b))
    return b - a >= D.MANY_BYTES or b - a >= D.LEAST_BYTES and words >= D.LEAST_WORDS


def brute(rows):
    """Spans by the definition, from the bytes of each chunk."""
    texts = {}
    for doc_id, text in rows:
        whole = (text or "").encode()
        key = xxh64_intdigest(whole, 42)
        texts[doc_id is not None, doc_id or 0, key - 2**64 if key >= 2**63 else key] = whole
    places = {}
    for doc, whole in texts.items():
        for a, b, held in naive_chunks(whole):
            places.setdefault(held, []).append((doc, a, b))
    marked = {}
    for held in places.values():
        first, fa, fb = min(held)
        for doc, a, b in held:
            if doc > first:
                marked.setdefault(doc, []).append((a, b, first, fa, fb))
    found = []
    for doc, mine in marked.items():
        runs = []
        for x in sorted(mine):
            if runs and x[0] <= max(y[1] for y in runs[-1]):
                runs[-1].append(x)
            else:
                runs.append([x])
        spans = []
        for run in runs:
            a, first, fa = min((x[0], x[2], x[3]) for x in run)
            n, mine, theirs = 0, texts[doc], texts[first]
            while n < min(a, fa, D.AROUND[0]) and mine[a - n - 1] == theirs[fa - n - 1]:
                n += 1
            b, last, fb = max((x[1], x[2], x[4]) for x in run)
            m, theirs = 0, texts[last]
            while m < min(len(mine) - b, len(theirs) - fb, D.AROUND[1]) and mine[b + m] == theirs[fb + m]:
                m += 1
            spans.append((a - n, b + m, min(x[2] for x in run)))
        joined = []
        for a, b, first in sorted(spans):
            if joined and a <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]), min(first, joined[-1][2]))
            else:
                joined.append((a, b, first))
        found += [(doc[1] if doc[0] else None, a, b, f[1] if f[0] else None, doc[2]) for a, b, f in joined if long_enough(texts[doc], a, b)]
    return sorted(found, key=repr)


def got(df):
    return sorted((tuple(r) for r in D.repeated_spans(df).collect()), key=repr)


def test_cuts_follow_the_content():
    rng = random.Random(1)
    text = bytes(rng.randrange(32, 127) for _ in range(5000))
    at = set(D.cuts(np.frombuffer(text, np.uint8)).tolist())
    for place in (0, 100, 2500):
        moved = D.cuts(np.frombuffer(text[:place] + b"inserted" + text[place:], np.uint8)).tolist()
        assert {e for e in at if e > place + D.GEAR + D.REACH} <= {e - 8 for e in moved}
        assert {e for e in at if e < place - D.REACH} <= set(moved)
    assert not len(D.cuts(np.frombuffer(b"", np.uint8))) and not len(D.cuts(np.frombuffer(b"ab" * 35, np.uint8)))


@pytest.mark.parametrize("segment", [1 << 20, 100])
def test_chunks_are_those_of_the_definition(monkeypatch, segment):
    monkeypatch.setattr(D, "SEGMENT", segment)
    rng = random.Random(5)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 15, 70, 71, 72, 130, 900)]
    texts += [b"ab" * 150 + b"c" * 100 + bytes(rng.randrange(256) for _ in range(300)), "the and of ".encode() * 60, prose(3, 200).encode()]
    for text in texts:
        found, a, b = D.chunks(text)
        expected = naive_chunks(text)
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(x, y) for x, y, _ in expected]
        digests = dict(zip(found.tolist(), (t for *_, t in expected), strict=True))
        assert all(digests[d] == t for d, (*_, t) in zip(found.tolist(), expected, strict=True)) and len(set(digests.values())) == len(digests)


def test_a_sure_passage_always_has_a_chunk():
    rng = random.Random(7)
    for _ in range(300):
        passage = bytes(rng.randrange(97, 105) for _ in range(D.SURE_BYTES))
        whole = [bytes(rng.randrange(97, 105) for _ in range(200)) + passage + bytes(rng.randrange(97, 105) for _ in range(200)) for _ in range(2)]
        assert set(D.chunks(whole[0])[0].tolist()) & set(D.chunks(whole[1])[0].tolist())


def passage(seed=500, n=51):
    return prose(seed, n)


def test_planted_passages(docs):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        text = prose(1000 + i, 150)
        if i % 6 == 0:
            cut = rng.randrange(len(text))
            text = text[:cut] + " " + passage(500 + i // 12) + " " + text[cut:]
        rows.append((i, text))
    spans = got(docs(rows).repartition(4))
    assert spans == brute(rows)
    assert {s[0] for s in spans} == {i for i in range(0, 120, 6) if i % 12}
    texts = dict(rows)
    for doc_id, a, b, first, _ in spans:
        part = texts[doc_id].encode()[a:b]
        assert part in texts[first].encode() and passage(500 + first // 12).encode() in part


def test_a_passage_in_a_third_of_all_documents(docs):
    rows = [(i, prose(i, 30) + (" " + passage() + " " if i % 3 == 0 else " ") + prose(5000 + i, 30)) for i in range(240)]
    spans = got(docs(rows).repartition(6))
    assert spans == brute(rows) and len(spans) == 79 and {s[3] for s in spans} == {0}


def test_a_repeated_word(docs):
    """Each of its letters' places has the same gear hash as the next one, so that cuts and chunks repeat."""
    rows = [(1, "the " * 60), (2, "the " * 55), (3, prose(3, 40) + " " + "the " * 150), (4, "and " * 51)]
    spans = got(docs(rows))
    assert spans == brute(rows) and {s[0] for s in spans} == {2, 3}


def test_odd_rows(odd, docs):
    rows = [(r[0], r[1]) for r in ODD if r[0] != 7]
    assert [x for x in got(odd) if x[0] != 7] == brute(rows)
    twice = [(1, passage(1, 300)), (1, passage(1, 300)), (None, passage(2, 300)), (2, passage(2, 300)), (3, "é" * 400), (4, "é" * 300)]
    assert got(docs(twice)) == brute(twice)


def test_rows_that_share_an_id_but_not_their_text(docs):
    rows = [(1, prose(1, 20) + passage()), (2, prose(2, 20) + passage()), (2, prose(3, 80)), (2, prose(3, 80)), (None, prose(4, 90)), (None, prose(4, 90)), (None, prose(4, 90) + "x"), (None, None)]
    spans = got(docs(rows))
    assert spans == brute(rows) and sorted({s[0] for s in spans}, key=repr) == [2, None]
    expected = []
    for doc_id, text in rows:
        whole = (text or "").encode()
        key = np.uint64(xxh64_intdigest(whole, 42)).astype(np.int64)
        gone = {i for d, a, b, _, k in spans if (d, k) == (doc_id, key) for i in range(a, b)}
        expected.append((doc_id, bytes(c for i, c in enumerate(whole) if i not in gone).decode()))
    kept = [tuple(r) for r in D.cut_spans(docs(rows), D.repeated_spans(docs(rows))).collect()]
    assert sorted(kept, key=repr) == sorted(expected, key=repr) and kept.count((2, prose(3, 80))) == 2


def test_repeats_within_one_document_stay(docs):
    assert got(docs([(1, passage() + " x " + passage()), (2, prose(3, 80))])) == []


def test_empty(none):
    assert got(none) == [] == D.cut_spans(none, D.repeated_spans(none)).collect()


def test_cutting(docs):
    both = "É" + passage(7, 80)
    df = docs([(1, prose(1, 20) + both), (2, prose(2, 20) + both + prose(9, 20)), (3, None)], extra=True)
    kept = {r.doc_id: r.kept_text for r in D.cut_spans(df, D.repeated_spans(df)).collect()}
    assert kept[1] == prose(1, 20) + both and kept[3] == ""
    assert kept[2].startswith(prose(2, 20)) and kept[2].endswith(prose(9, 20)) and len(kept[2]) < len(prose(2, 20) + prose(9, 20)) + 130


SHORT = "the of and to in is it you that he was for on are with as his they be at one have this from or had by hot but some".split()


def test_the_query_finds_short_passages_with_their_true_ends(docs, tmp_path):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(SHORT) for _ in range(n))
    planted, rows = {}, []
    while len(planted) < 150:
        passage, i = words(51), 2 * len(planted)
        if len(passage) < D.LEAST_BYTES:
            continue
        before = [words(20) + x for x in "éx"]
        rows += [(i, before[0] + passage + "Y" + words(20)), (i + 1, before[1] + passage + "Z" + words(20))]
        planted[i + 1] = (len(before[1].encode()), len((before[1] + passage).encode()), i)
    docs(rows).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op2_substring_dedup"](docs([]).sparkSession, str(tmp_path)).collect()
    assert {r.doc_id: (r.start, r.end, r.first_doc_id) for r in found} == planted
