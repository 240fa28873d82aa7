"""Substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile("[^\x20\x09-\x0d]+")
LAST = (1 << 63) - 1


def brute(rows, window):
    words = [(LAST if i is None else i, SPACE.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, LAST + 1), i)
    out = []
    for (i, w), (raw, _) in zip(words, rows):
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((raw, len(w), len(gone), " ".join(kept)))
    return out


def digests(rows, window):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    return sorted(((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute(rows, window)), key=key), key


def docs_of(spark, rows, extra=False):
    more = ", doc string, spans int, t1 long, name string, n_words long" if extra else ""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *(("x", 1, 2, "y", 3) if extra else ())) for i, t in rows], SCHEMA + more)


def shared_passages(rng, n, vocabulary, passages):
    """Texts of random words with passages, whole or in part, at random places."""
    rows = []
    for i in rng.sample(range(10 * n), n):
        words = []
        while len(words) < 40 or rng.random() < 0.7:
            words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
            p = rng.choice(passages)
            a = rng.randrange(len(p)) if rng.random() < 0.5 else 0
            words += p[a : a + rng.randint(1, len(p))] if rng.random() < 0.5 else p
        rows.append((i, rng.choice([" ", "  ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize("window, gram, vocabulary", [(50, 12, 5000), (6, 3, 12), (5, 5, 3), (4, 1, 4)])
def test_repeats_equal_brute_force(spark, window, gram, vocabulary):
    from tilewave.llm.substring_dedup import repeat_digests

    rng = random.Random(window)
    vocabulary = [f"w{k}" for k in range(vocabulary)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(window - 2, 3 * window))] for _ in range(6)]
    rows = shared_passages(rng, 90, vocabulary, passages)
    rows += [(LAST - 5 + k, rows[k][1]) for k in range(4)]  # copies of whole texts
    rows += [(-3, rows[7][1] + " tail"), (rows[9][0], rows[8][1]), rows[10], rows[10], (None, rows[11][1]), (None, rows[12][1] + " more")]
    rows += [(70_000, None), (70_001, ""), (70_002, " \n"), (70_003, "same " * 300), (70_004, "same " * 200), (70_005, "ä ö " * 90 + "end")]
    want, key = digests(rows, window)
    assert sum(g > 0 for _, _, g, _ in want) > 20
    docs = docs_of(spark, rows, extra=True)
    got = sorted((tuple(r) for r in repeat_digests(docs, window, gram=gram, shard_words=900).collect()), key=key)
    assert got == want
    # every name with more than two segments is searched by its windows
    got = sorted((tuple(r) for r in repeat_digests(docs, window, gram=gram, hot_segments=2).collect()), key=key)
    assert got == want


def test_drop_repeats_keeps_columns_and_other_texts(spark):
    from tilewave.llm.substring_dedup import drop_repeats

    rng = random.Random(2)
    passage = " ".join(f"p{rng.randrange(900)}" for _ in range(60))
    rows = [(5, f"five  first {passage} five last"), (2, passage + "\nrest of two"), (9, "nine   is left\nalone"), (None, None), (7, passage), (7, passage), (8, passage + "\nrest of two")]
    docs = docs_of(spark, rows, extra=True)
    out = drop_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None) == [(2, rows[1][1]), (5, "five first five last"), (7, ""), (7, ""), (8, ""), (9, rows[2][1])]
    assert drop_repeats(docs.limit(0)).count() == 0


def test_fm_index_statistics_equal_brute_force():
    from tilewave.llm.fm_index import FMIndex

    rng = random.Random(6)
    for _ in range(40):
        pieces = [[rng.randint(1, rng.choice([2, 9])) for _ in range(rng.randint(1, 25))] for _ in range(rng.randint(1, 14))]
        owners = np.array([rng.randrange(5) for _ in pieces])
        index = FMIndex(np.concatenate(pieces), np.array([len(p) for p in pieces]), owners)
        got, begin = index.statistics()
        for k, p in enumerate(pieces):
            others = [q for j, q in enumerate(pieces) if owners[j] < owners[k]]
            for i in range(len(p)):
                most = max((size for size in range(1, len(p) - i + 1) if any(q[x : x + size] == p[i : i + size] for q in others for x in range(len(q) - size + 1))), default=0)
                assert got[begin[k] + i] == most


def test_wavelet_rank_equals_counting():
    from tilewave.llm.fm_index import WaveletMatrix

    rng = np.random.default_rng(1)
    for most in (1, 2, 7, 300):
        values = rng.integers(0, most + 1, 700)
        own = WaveletMatrix(values, most)
        value, place = rng.integers(0, most + 1, 400), rng.integers(0, 701, 400)
        assert own.rank(value, place).tolist() == [int((values[:p] == v).sum()) for v, p in zip(value, place)]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    from tilewave.llm import substring_dedup as s

    rng = random.Random(8)
    raw = np.frombuffer(" ".join("x" * rng.randint(1, 40) + str(rng.randrange(50)) for _ in range(400)).encode(), np.uint8)
    whole = s.word_hashes(raw)[2]
    monkeypatch.setattr(s, "PIECE", 30)
    assert (s.word_hashes(raw)[2] == whole).all()
    assert len(set(whole.tolist())) == len(set(raw.tobytes().split()))
