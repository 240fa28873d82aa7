"""Periodic runs and source divergence against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile("[^\x20\x09-\x0d]+")


def brute_runs(words, min_words=6, min_powers=4):
    """Each maximal stretch of each period; one whose smallest period is shorter has been found under that."""
    found = {}
    n = len(words)
    for q in range(1, n // min_powers + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            found.setdefault((i, j - i + q), q)
            i = j
    def smallest(w):
        return next(p for p in range(1, len(w) + 1) if all(w[k] == w[k + p] for k in range(len(w) - p)))
    return sorted((s, size, q) for (s, size), q in found.items() if size >= max(min_words, min_powers * q) and smallest(words[s : s + size]) == q)


def brute_digest(doc, text):
    words = SPACE.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *row, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def periodic_text(rng):
    words = []
    while len(words) < 120:
        if rng.random() < 0.6:
            root = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            words += (root * 8)[: rng.randint(1, 8 * len(root))]
        words += [rng.choice("abcd") for _ in range(rng.randint(0, 5))]
    return " ".join(words)


def test_text_runs_equal_brute_force():
    from tilewave.llm.periodic import text_runs

    rng = random.Random(3)
    for k in range(300):
        text = periodic_text(rng) if k % 3 else " ".join(rng.choice("ab") for _ in range(rng.randint(0, 70)))
        assert text_runs(text) == brute_runs(text.split()), text
        assert text_runs(text, 3, 3) == brute_runs(text.split(), 3, 3), text


def test_run_digests_equal_brute_force(spark):
    from tilewave.llm.periodic import run_digests

    rng = random.Random(4)
    rows = [(i, periodic_text(rng) if i % 2 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 90)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "x " * 3000), (504, "    " * 4), (None, "a b " * 9), (1, rows[1][1]), (1, "other text of one id")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 7, 7, 7) for i, t in rows], SCHEMA + ", start long, length long, period long")
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in run_digests(docs, plant=True).collect()), key=key)
    assert got == sorted((brute_digest(i, t) for i, t in rows), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 3
    assert run_digests(docs.limit(0)).count() == 0


def test_collapse_runs_keeps_other_texts(spark):
    from tilewave.llm.periodic import collapse_runs

    docs = spark.createDataFrame([(1, "no  run\nhere", "en", "s", 0), (2, "go on and on and on and on and on and stop", "en", "s", 0), (3, None, "en", "s", 0)], SCHEMA)
    assert [r.text for r in collapse_runs(docs).orderBy("doc_id").collect()] == ["no  run\nhere", "go on and stop", None]


def test_memory_of_a_repeated_word():
    import tracemalloc

    from tilewave.llm.periodic import analysed

    text = b"word " * 200_000
    tracemalloc.start()
    assert analysed([1], [text], False, 6, 4)[3] == [200_000]
    assert tracemalloc.get_traced_memory()[1] < 200 * 200_000


# ---- divergence ---------------------------------------------------------------------------------------------


def brute_divergence(rows, min_docs=30, top=50):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", [w.translate(low) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= min_docs}
        sources = {d[1] for d in own}
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in sources}
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(counts[s]) for s in sources}, share(whole)
        for s in sources:
            pair = [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in sources if x != s]
            term = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def tagged():
    rng = random.Random(9)
    vocabulary = [rng.choice(["alpha", "Beta", "gamma", "ÄÖ", "äö", "z z", "𝔘x"]) + chr(97 + k % 26) * (1 + k // 26) for k in range(80)]
    rows = []
    for k in range(700):
        source = rng.choice(["s1", "s1", "s1", "s1", "s2", "s3", None])
        words = rng.choices(vocabulary, weights=[1 + (j * (1 + len(str(source)))) % 17 for j in range(80)], k=rng.randint(0, 30))
        rows.append((rng.choice(["en", "en", "de", None]), source, rng.choice([" ", "-", "1"]).join(words)))
    rows += [("lonely", "only", "one document"), ("en", "silent", None), ("en", "silent", "12 34"), ("two", "a", ""), ("two", "b", "rare")] + rows[:50]
    return rows


def test_divergence_equals_brute_force(spark, tagged):
    from tilewave.llm.divergence import source_divergence

    docs = spark.createDataFrame([(k, t, lang, s, 0, "x", 1, 2) for k, (lang, s, t) in enumerate(tagged)], SCHEMA + ", term string, df long, rank int")
    want = brute_divergence(tagged)
    assert {p for _, _, p, *_ in want} == {"pair", "term"} and any(r[0] == "two" and r[4] == 0 for r in want)
    assert sorted(tuple(r) for r in source_divergence(docs).collect()) == want
    # spills after each few documents change nothing
    assert sorted(tuple(r) for r in source_divergence(docs.repartition(3), max_cells=40).collect()) == want
    assert sorted(tuple(r) for r in source_divergence(docs, min_docs=60, top=3).collect()) == brute_divergence(tagged, 60, 3)
    assert source_divergence(docs.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts():
    import numpy as np

    from tilewave.llm.divergence import shares

    rng = random.Random(1)
    totals = [rng.randrange(10**14, 9 * 10**15) for _ in range(200)]
    counts = [rng.randrange(0, t - 5) for t in totals]
    assert shares(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * (c + 5) // t for c, t in zip(counts, totals)]
