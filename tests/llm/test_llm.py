import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from compare import connection, rows_of, sql_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], SCHEMA)


WORDS = "the quick brown fox jumps over a lazy dog while seven green birds sing loud songs near old stone bridges under pale winter moons".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(200)) for _ in range(n))


@pytest.fixture(scope="module")
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties, clashing column names."""
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "x" * 50_000), (5, prose(rng, 400)), (5, prose(random.Random(7), 60)), (6, "same line here\nsame line here"), (7, "same line here"), (None, "no id at all, " + prose(rng, 60)), (8, "1 " * 4_000)]
    rows += [rows[4]]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, 0, "v") for i, t in rows], SCHEMA + ", size long, slot int, shard string")


# ---- line dedup ---------------------------------------------------------------------------------------------


def line_brute(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    first = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), i), i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and first[key(x)] < i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_equals_brute_force(spark):
    from tilewave.llm.line_dedup import dedup_lines

    rng = random.Random(5)
    pool = [prose(rng, 3) for _ in range(30)] + ["short", "", "  ÄÖ Line With Case ", "  äö line with case"]
    texts = [None, ""] + ["\n".join(rng.choice(pool).swapcase() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(0, 8))) for _ in range(120)]
    ids = rng.sample(range(1000), len(texts))
    got = {r.doc_id: (r["__tw_n_lines"], r["__tw_n_dropped"], r.text or "") for r in dedup_lines(docs_of(spark, texts, ids)).collect()}
    assert got == line_brute(list(zip(ids, texts)))


def test_line_runs_compact_and_forget_nothing(spark):
    from tilewave.llm.line_dedup import LineRuns, hashed_lines

    runs = LineRuns(spark, fanout=2)
    for k in range(5):
        runs.absorb(hashed_lines(docs_of(spark, [f"a line of batch {k}", "a line in all of them"], [2 * k, 2 * k + 1]), 10))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert Counter(r["first"] for r in runs.firsts().collect()) == Counter([0, 1, 2, 4, 6, 8])


def test_line_dedup_edge_cases(spark, edge_docs):
    from tilewave.llm.line_dedup import dedup_lines

    out = dedup_lines(edge_docs)
    assert out.count() == edge_docs.count()
    assert set(edge_docs.columns) <= set(out.columns)
    assert out.where("doc_id = 7").first().text == ""
    assert dedup_lines(edge_docs.limit(0)).count() == 0


def test_line_dedup_of_different_texts_under_one_id(spark):
    from tilewave.llm.line_dedup import dedup_lines

    rows = [(1, "a line of one"), (2, "a line of one\nkept by the first"), (2, "kept by the second\na line of one"), (None, "kept without id\na line of one"), (None, "a line of one\nanother without id")]
    out = dedup_lines(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text, r["__tw_n_dropped"]) for r in out) == [(0, "another without id", 1), (0, "kept without id", 1), (1, "a line of one", 0), (2, "kept by the first", 1), (2, "kept by the second", 1)]


# ---- secrets ------------------------------------------------------------------------------------------------


def test_secret_scan_finds_keys_and_not_words(spark):
    from tilewave.llm.secret_scan import scan_secrets

    rng = random.Random(2)
    texts, want = [], set()
    for i in range(80):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        if i % 2:
            texts.append(f'{prose(rng, 20)} token = "{key}" {prose(rng, 5)}')
            want.add((i, hashlib.sha256(key.encode()).hexdigest()))
        else:
            texts.append(prose(rng, 20) + " " + "".join(rng.choice(["ment", "tion", "ing", "ver"]) for _ in range(8)) + " https://example.org/" + "a/b" * 10)
    got = {(r.doc_id, r.sha256) for r in scan_secrets(docs_of(spark, texts)).collect()}
    assert got == want


def test_secret_scan_candidates_equal_brute_force(spark):
    from tilewave.llm.secret_scan import candidates

    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab1", "X", "/", "-9", "key=", " ", '"', "é", "zzzzzzzz", "\n", "0" * 9]) for _ in range(rng.randint(0, 40))) for _ in range(150)] + [None, "", "x" * 50_000]
    want = []
    for i, t in enumerate(texts):
        for m in re.finditer("[A-Za-z0-9+/_=-]+", t or ""):
            if len(m[0]) >= 20 or len(m[0]) >= 8 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
                want.append((i, m.start(), m.end(), m[0]))
    assert sorted((r.doc_id, r.start, r.stop, r.found) for r in candidates(docs_of(spark, texts)).collect()) == want


def test_secret_scan_judges_what_formats_leave_open(spark):
    """Keys of no known format, learnt from how those of known ones move and what stands beside them."""
    from tilewave.llm.secret_scan import scan_secrets

    rng = random.Random(4)
    texts, want = [], set()
    for i in range(200):
        n = 40 if i % 4 else 28
        key = "".join(rng.choice("0123456789abcdef") for _ in range(n))
        if i % 2 == 0:
            texts.append(f'{prose(rng, 20)} secret = "{key}" {prose(rng, 5)}')
            want.add(i)
        else:
            texts.append(prose(rng, 20) + " https://example.org/" + "/".join(rng.choice(WORDS) for _ in range(8)) + f"/page{rng.randrange(10**6)} " + "".join(rng.choice(WORDS) for _ in range(6)))
    got = {r.doc_id for r in scan_secrets(docs_of(spark, texts)).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_secret_scan_leaves_harmless_values_alone(spark):
    """UUIDs, link and commit hashes, builds, orders and product names in texts of their own; and keys of shapes that no format knows."""
    import uuid

    from tilewave.llm.secret_scan import scan_secrets

    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    harmless = [lambda: f"session {uuid.UUID(int=rng.getrandbits(128), version=4)} closed", lambda: f"https://files.example.net/{hexes(32)}/photo", lambda: f"reverts commit {hexes(40)} today", lambda: f"order {rng.choice(WORDS)}-{digits(6)} shipped", lambda: f"build {digits(8)}-rc{digits(1)}", lambda: f"the {rng.choice(WORDS)}{digits(4)}{rng.choice(WORDS)} model"]
    secrets = [lambda: f"password={mixed(13)}", lambda: f'token = "{mixed(30)}"', lambda: f"api_key: {hexes(36)}", lambda: f"AKIA{mixed(16).upper()}"]
    texts, want = [], set()
    for i in range(400):
        bad = i % 5 == 0
        texts.append(f"{prose(rng, 15)} {rng.choice(secrets if bad else harmless)()} {prose(rng, 8)}")
        want |= {i} if bad else set()
    rows = scan_secrets(docs_of(spark, texts)).collect()
    got = {r.doc_id for r in rows}
    # held-out recall and precision, by document
    assert len(got & want) >= 0.95 * len(want)
    assert len(got - want) <= 0.03 * (len(texts) - len(want))
    uuids = {i for i, t in enumerate(texts) if " session " in t and " closed " in t}
    assert len(uuids) > 30 and not got & uuids


def test_secret_scan_edge_cases(spark, edge_docs):
    from tilewave.llm.secret_scan import scan_secrets

    assert scan_secrets(edge_docs).count() == 0
    assert scan_secrets(edge_docs.limit(0)).count() == 0


# ---- quality ------------------------------------------------------------------------------------------------


def longest_brute(w):
    out = []
    for i in range(len(w)):
        best = 0
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_suffix_array_repeats_equal_brute_force():
    from tilewave.llm.quality import longest_repeats

    rng = random.Random(3)
    for _ in range(150):
        texts = [[rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 4))]
        flat = np.array([ord(w) for t in texts for w in t], np.int64)
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        assert longest_repeats(flat, text, len(texts)).tolist() == [x for t in texts for x in longest_brute(t)]


def test_suffix_array_of_large_batches(monkeypatch):
    """Lanes of a few places, repeats that lie across them, and texts of one word."""
    from tilewave.llm import quality

    rng = random.Random(31)
    texts = [[1] * 700, [2, 3] * 300, [rng.randrange(400) for _ in range(500)] * 2, [rng.randrange(3) for _ in range(400)], [5]]
    flat, text = np.concatenate([np.array(t) for t in texts]), np.repeat(np.arange(5), [len(t) for t in texts])
    whole = quality.longest_repeats(flat, text, 5).tolist()
    assert whole[:700] == [699, *(700 - k for k in range(1, 700))]
    for lanes in (1, 3, 37):
        monkeypatch.setattr(quality, "LANES", lanes)
        assert quality.longest_repeats(flat, text, 5).tolist() == whole


def test_quality_memory_of_a_repeated_word():
    import tracemalloc

    from tilewave.llm.quality import measured

    text = b"word " * 400_000
    tracemalloc.start()
    out = measured([1], [text], 6, 0.4, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (out[1][0], out[9][0]) == (400_000, 399_999)
    assert peak < 50 * len(text)


def quality_brute(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count, hit = Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            hit |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def test_quality_base_equals_brute_force(spark, edge_docs):
    from tilewave.llm.quality import quality_rules

    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 120)) + rng.choice(["", "\n#a|b\n#a|b\né\x85ü", " word" * 40]) for _ in range(60)] + ["a b c d e f g h " * 20]
    df = docs_of(spark, texts, range(100, 100 + len(texts)))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(df).collect()}
    assert got == {i: quality_brute(t) for i, t in zip(range(100, 1000), texts)}
    assert quality_rules(edge_docs).count() == edge_docs.count()
    assert quality_rules(edge_docs.limit(0)).count() == 0


def test_quality_verdict(spark):
    from tilewave.llm.quality import drop_rejects, quality_rules

    rng = random.Random(6)
    clean, part = prose(rng, 300), prose(rng, 80)
    texts = [clean, part + " " + prose(rng, 20) + " " + part + " " + prose(rng, 20), " ".join([prose(rng, 230)] * 1 + [prose(rng, 500)])]
    assert [r.kept for r in quality_rules(docs_of(spark, texts)).orderBy("doc_id").collect()] == [True, False, True]
    assert {r.doc_id for r in drop_rejects(docs_of(spark, texts)).collect()} == {0, 2}


# ---- toxicity -----------------------------------------------------------------------------------------------


def test_grammar_weighs_context():
    from tilewave.llm import toxicity as t

    g = t.GRAMMAR
    plain = g.clause([t.INSULT], [2.0])
    assert g.clause([t.TARGET, t.INSULT], [0, 2.0]) > plain > g.clause([t.REPORT, t.INSULT], [0, 2.0]) > 0
    assert g.clause([t.NEGATION, t.INSULT], [0, 2.0]) < plain
    assert g.clause([t.NEGATION] + [t.OTHER] * 5 + [t.INSULT], [0] * 6 + [2.0]) == plain
    assert g.clause([t.TARGET, t.OTHER, t.NEGATION], [0, 0, 0]) == 0


def test_toxicity_learns_and_holds_out(spark):
    from tilewave.llm.toxicity import toxicity_scores

    rng = random.Random(8)
    texts, toxic = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = prose(rng, 40).split()
        if bad:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["zargblat", "zargbloo", "zargbler"])
        texts.append(" ".join(words))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity_scores(docs_of(spark, texts + [None, ""]), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id < 600]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_toxicity_without_labels_and_rows(spark, edge_docs):
    from tilewave.llm.toxicity import toxicity_scores

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity_scores(edge_docs, none).count() == edge_docs.count()
    assert toxicity_scores(edge_docs.limit(0), none).count() == 0


# ---- decontamination ----------------------------------------------------------------------------------------


def edit_distance_within(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, x in enumerate(t):
            new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_banded_alignment_equals_full():
    from tilewave.llm.decontam import aligned

    rng = random.Random(9)
    for _ in range(150):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 25)))
        assert aligned(p, np.frombuffer(t, np.uint8), len(p))[0] == edit_distance_within(p, t)


def test_decontamination_equals_brute_force(spark):
    from tilewave.llm.decontam import drop_leaks, find_leaks, folded

    rng = random.Random(10)
    items = [prose(rng, rng.randint(8, 14)) for _ in range(8)]
    texts = []
    for i in range(60):
        item = items[i % 8]
        if i % 3 == 0:
            w = list(item)
            for _ in range(rng.randint(0, len(w) // 7)):
                w[rng.randrange(len(w))] = rng.choice("xyz")
            item = "".join(w)
        elif i % 3 == 1:
            item = " ".join(item.split()[:5])
        texts.append(prose(rng, 12) + " " + item + " " + prose(rng, 12))
    texts += [None, "", items[0].upper()]
    bench = spark.createDataFrame(list(enumerate(items)) + [(99, None), (98, ""), (97, "tiny")], "item_id long, text string")
    items = dict(enumerate(items)) | {97: "tiny"}
    want = {(i, k) for i, t in enumerate(texts) for k, p in items.items() if edit_distance_within(folded(p.encode()), folded((t or "").encode())) <= int(len(p.encode()) * 0.1)}
    df = docs_of(spark, texts)
    for block in (8 << 20, 200):
        rows = find_leaks(df, bench, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want
    assert all(r.edits <= r.budget for r in rows)
    assert {r.doc_id for r in drop_leaks(df, bench).collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert find_leaks(df, bench.limit(0)).count() == 0 and find_leaks(df.limit(0), bench).count() == 0


def test_decontamination_of_short_items_equals_brute_force(spark):
    """Items of 1 to 60 bytes in several blocks."""
    from tilewave.llm.decontam import drop_leaks, find_leaks, folded

    rng = random.Random(24)
    letters = "abcdefghijklmnop"
    items = ["".join(rng.choice(letters) for _ in range(n)) for n in range(1, 61)]
    texts = [None, "", "é", "--"]
    for _ in range(60):
        item = list(rng.choice(items[2:]))
        for _ in range(rng.randint(0, len(item) // 8)):
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice([["x"], [], [item[at], "x"]])
        texts.append("".join(rng.choice("qrstuvw ") for _ in range(rng.randint(0, 40))) + "".join(item) + "".join(rng.choice("qrstuvw ") for _ in range(rng.randint(0, 40))))
    texts += ["".join(rng.choice(letters) for _ in range(30)) for _ in range(20)]
    bench = spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, ""), (92, " .,!")], "item_id long, text string")
    want = {(i, k) for i, t in enumerate(texts) for k, p in enumerate(items) if edit_distance_within(p.encode(), folded((t or "").encode())) <= int(len(p) * 0.1)}
    df = docs_of(spark, texts)
    for block in (8 << 20, 700):
        assert {(r.doc_id, r.item_id) for r in find_leaks(df, bench, block_bytes=block).collect()} == want
        assert {r.doc_id for r in drop_leaks(df, bench, block_bytes=block).collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_decontamination_edge_cases(spark, edge_docs):
    from tilewave.llm.decontam import drop_leaks, find_leaks

    bench = spark.createDataFrame([(1, "same line here"), (1, "same line here"), (None, "x"), (2, "x" * 60)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in find_leaks(edge_docs, bench).collect())
    assert set(got) == {(4, 2), (6, 1), (7, 1)}
    kept = drop_leaks(edge_docs, bench)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 3
    assert drop_leaks(edge_docs.limit(0), bench).count() == 0


# ---- personal data ------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def pii_brute(t):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii_base_equals_brute_force(spark, edge_docs):
    from tilewave.llm.pii import pii_digest

    rng = random.Random(11)
    parts = ["1", "4111 1111 1111 1111", "+1 (984) 555-5227", "a@b.c", "_d@e.f", "é", "😀", " ", "-", ".", "192.168.0.1", "1.2.3.4.5", "256.1.1.1", "+", "0", "@", "12", ",", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(500)] + [None, "", "9" * 3000, "1." * 300]
    rows = {r.doc_id: r for r in pii_digest(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert rows[i].base_sha256 == hashlib.sha256(pii_brute(t).encode()).hexdigest(), t
        assert set(filter(None, pii_brute(t).split(","))) <= set(rows[i].spans.split(","))
    assert pii_digest(edge_docs).count() == edge_docs.count()
    assert pii_digest(edge_docs.limit(0)).count() == 0


def test_pii_time_grows_with_the_matches(spark):
    import time

    from tilewave.llm.pii import pii_digest

    def seconds(n):
        text = " ".join(f"mail a{i}@example.org 212-555-{i % 9000 + 1000}" for i in range(n))
        began = time.perf_counter()
        assert pii_digest(docs_of(spark, [text])).first().n_email == n
        return time.perf_counter() - began

    seconds(500)
    few = seconds(2_000)
    assert seconds(20_000) < 3 * 10 * few


def test_pii_places_and_context_in_long_rows_of_matches(spark):
    from pyspark.sql import functions as F

    from tilewave.llm.pii import spans_of

    rng = random.Random(12)
    texts = ["".join(rng.choice(["a@b.c", "ä ", "x" * rng.randint(0, 50), " ", "😀", "d@e.f,"]) for _ in range(rng.choice([3, 40, 900]))) for _ in range(40)]
    pattern = "[a-z]@[a-z]\\.[a-z]"
    df = docs_of(spark, texts).select("doc_id", "text", spans_of(F.col("text"), "email", pattern, F.lit(True)).alias("s"))
    for r in df.collect():
        want = [(m.start(), m.end(), m[0], r.text[: m.start()][-32:], r.text[m.end() :][:1]) for m in re.finditer(pattern, r.text)]
        assert [(s.start, s.stop, s.text, s.before, s.after) for s in r.s] == want


def test_pii_clears_what_base_spans_overlap(spark):
    from pyspark.sql import functions as F

    from tilewave.llm.pii import SPAN, clear_of

    rng = random.Random(13)
    rows = []
    for i in range(60):
        span = lambda: (lambda a: (a, 0, a + rng.randint(1, 12), "email", "", "", ""))(rng.randrange(600))
        rows.append((i, [span() for _ in range(rng.choice([0, 5, 300]))], [span() for _ in range(rng.choice([0, 4, 20]))]))
    got = {r.i: sorted(r.c) for r in spark.createDataFrame(rows, f"i int, l {SPAN}, b {SPAN}").select("i", clear_of(F.col("l"), F.col("b")).alias("c")).collect()}
    for i, loose, base in rows:
        assert got[i] == sorted(x for x in loose if not any(b[0] < x[2] and b[2] > x[0] for b in base))


def test_pii_adds_spans_in_context(spark):
    from tilewave.llm.pii import pii_digest

    texts = ["call me by phone (212) 555-1234 today", "write to mail jane [at] host [dot] com please"] * 30
    spans = [r.spans for r in pii_digest(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert spans[0] == "phone:17:31" and spans[1].startswith("email:14:")


# ---- tokens -------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, edge_docs):
    import public_tokenizers as P
    import tiktoken

    from tilewave.llm.bpe import BpeMonoid, bpe_digests, bpe_tokens, read_ranks

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(12)
    monoid = BpeMonoid(ranks, leaf_bytes=8)
    for _ in range(800):
        alphabet = rng.choice(["ab", "ath er", "0123", "aé ü", "#*&$%", "\n\t ", "thequickbrownfox", " "])
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))).encode()
        assert monoid.encode(s) == library._encode_single_piece(s)
        assert monoid.decode(monoid.encode(s)) == s
    texts = [r.text for r in edge_docs.collect()] + ["<|endoftext|> x's we'll  \n\n  😀 日本語"]
    df = docs_of(spark, texts)
    for r in bpe_digests(df, path, P.PATTERN).collect():
        t = texts[r.doc_id] or ""
        ids = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert all(r.token_ids == library.encode_ordinary(texts[r.doc_id] or "") and r.decoded == (texts[r.doc_id] or "") for r in bpe_tokens(df, path, P.PATTERN).collect())


# ---- sharding -----------------------------------------------------------------------------------------------


def test_shards_are_even_whole_and_gapless(spark, edge_docs):
    from tilewave.llm.sharding import kd_shards

    rng = random.Random(13)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(900)] + ["a copy of this"] * 30
    rows = kd_shards(docs_of(spark, texts), shards=8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    sizes, slots, homes = Counter(), {}, {}
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert set(sizes) == set(range(8)) and max(sizes.values()) <= 1.03 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    hot = Counter(r.shard for r in kd_shards(docs_of(spark, ["one text"] * 400), shards=8).collect())
    assert max(hot.values()) - min(hot.values()) <= 4
    odd = kd_shards(edge_docs, shards=3).collect()
    assert len(odd) == edge_docs.count()
    assert kd_shards(edge_docs.limit(0)).count() == 0
    assert len({r.shard for r in kd_shards(docs_of(spark, texts), target_bytes=sum(sizes.values()) // 5 + 1).collect()}) == 5


# ---- near-duplicates ----------------------------------------------------------------------------------------


def shingles(t):
    w = tuple((t or "").encode().lower().split())
    return Counter(w[i : i + 5] for i in range(len(w) - 4)) if len(w) >= 5 else Counter([w])


def test_darts_estimate_weighted_similarity():
    from tilewave.llm.minhash import elements, signatures

    rng = random.Random(14)
    for _ in range(5):
        a = prose(rng, 150).split() + ["ater"] * 60
        b = a[:]
        for _ in range(rng.randint(1, 12)):
            b[rng.randrange(len(b))] = "other"
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        owner, code, _ = elements([" ".join(a).encode(), " ".join(b).encode()])
        sig = signatures(owner, code, 2, 1200)
        assert abs((sig[0] == sig[1]).mean() - sum((x & y).values()) / sum((x | y).values())) < 0.07


def test_near_classes_equal_brute_force(spark):
    from tilewave.llm.minhash import near_classes

    rng = random.Random(15)
    texts = [None, "", "a b", "A  b", "three short words"]
    for _ in range(12):
        base = prose(rng, rng.randint(40, 120)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            w = base[:]
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edited" + str(rng.randrange(99))
            texts.append(" ".join(w))
    rng.shuffle(texts)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    grams = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if sum((grams[i] & grams[j]).values()) >= 0.8 * sum((grams[i] | grams[j]).values()):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in near_classes(docs_of(spark, texts)).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_near_classes_of_a_hot_family(spark):
    from tilewave.llm.minhash import near_classes

    rng = random.Random(16)
    base = prose(rng, 200).split()
    texts = []
    for i in range(150):
        w = base[:]
        w[i % 200] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [prose(rng, 50) for _ in range(50)]
    got = {r.doc_id: r.class_id for r in near_classes(docs_of(spark, texts)).collect()}
    assert all(got[i] == 0 for i in range(150)) and all(got[i] == i for i in range(150, 200))


def test_near_classes_of_many_families_in_large_buckets(spark):
    """Texts of the same 24 passages less four: alike only inside pairs, which neither end of a bucket shows."""
    from tilewave.llm.minhash import near_classes

    rng = random.Random(17)
    passages = [prose(rng, 40) for _ in range(24)]
    gone: list[frozenset] = []
    for _ in range(4000):
        a = frozenset(rng.sample(range(24), 4))
        b = (a - {rng.choice(sorted(a))}) | {rng.choice(sorted(set(range(24)) - a))}
        if all(len(x & g) <= 1 for x in (a, b) for g in gone):
            gone += [a, b]
    texts = [" ".join(p for k, p in enumerate(passages) if k not in g) for g in gone]
    grams = [shingles(t) for t in texts]
    alike = [(i, j) for j in range(len(texts)) for i in range(j) if sum((grams[i] & grams[j]).values()) >= 0.8 * sum((grams[i] | grams[j]).values())]
    assert len(texts) > 20 and alike == [(i, i + 1) for i in range(0, len(texts), 2)]
    got = {r.doc_id: r.class_id for r in near_classes(docs_of(spark, texts), bands=8, rows=1, small_bucket=4).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(texts))}


def brute_classes(texts, similarity=0.8):
    grams, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sum((grams[i] & grams[j]).values()) >= similarity * sum((grams[i] | grams[j]).values()):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(texts))}


def hot_families(rng, n):
    """Copies of a text with edits around a similarity of 0.8, copies of copies, and texts around a common passage."""
    base, passage = prose(rng, 150).split(), prose(rng, 120)
    texts = []

    def edited(w, k):
        w = w[:]
        for _ in range(k):
            at, new = rng.randrange(len(w)), [f"new{rng.randrange(10**6)}"]
            w[at : at + 1] = rng.choice([new, [], new + [w[at]]])
        return w

    for _ in range(n):
        copy = edited(base, rng.randint(1, 8))
        texts.append(" ".join(copy))
        if rng.random() < 0.15:
            texts.append(" ".join(edited(copy, rng.randint(1, 4))))
    for _ in range(n // 2):
        own = passage + " " + prose(rng, rng.randint(10, 50))
        texts.append(own)
        if rng.random() < 0.2:
            texts.append(" ".join(edited(own.split(), rng.randint(1, 4))))
    rng.shuffle(texts)
    return texts


def test_near_classes_of_hot_families_equal_brute_force(spark, monkeypatch):
    """Bands of one row put nearly all in common buckets, so that only the search inside them decides."""
    from tilewave.llm import families
    from tilewave.llm.minhash import near_classes

    monkeypatch.setattr(families, "PART", 500)
    texts = hot_families(random.Random(18), 140)
    want = brute_classes(texts)
    assert 30 < len(set(want.values())) < len(texts) - 60
    got = {r.doc_id: r.class_id for r in near_classes(docs_of(spark, texts), bands=24, rows=1, small_bucket=1).collect()}
    assert got == want


def test_near_classes_of_repeated_ids(spark):
    from tilewave.llm.minhash import near_classes

    a, b, c = (prose(random.Random(k), 60) for k in (21, 22, 23))
    rows = [(2, a), (5, a), (5, b), (7, b), (8, c), (8, c), (None, a)]
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in near_classes(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)).collect())
    assert got == [(0, 0), (2, 2), (5, 2), (5, 2), (7, 2), (8, 8), (8, 8)]


def test_near_classes_edge_cases(spark, edge_docs):
    from tilewave.llm.minhash import near_classes

    rows = near_classes(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all((r.doc_id is None) == (r.class_id is None) for r in rows)
    assert near_classes(edge_docs.limit(0)).count() == 0


# ---- urls ---------------------------------------------------------------------------------------------------


def test_url_rules_and_reputation(spark):
    from tilewave.llm.queries import URL_RULES
    from tilewave.llm.url_filter import filter_urls

    urls = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x", "http://a.example.org/en/2", "http://b.com/fr/x", "http://b.com/de/", "http://notorg/x", "ftp", None, "", "http://x.org", "http://myexample.org/es/1"]
    rows = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES).orderBy("page_id").collect()
    assert [r.rule for r in rows] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, "org/"]
    assert [r.verdict for r in rows[:5]] == ["block", "block", "allow", "allow", "block"]
    assert (rows[1].host, rows[1].path, rows[6].host, rows[9].path) == ("example.org", "/en/12", "", "")
    labelled = spark.createDataFrame([(f"http://bad.net/{i}", 1) for i in range(40)] + [(f"http://good.net/{i}", 0) for i in range(40)], "url string, bad int")
    pages = spark.createDataFrame([(1, "http://bad.net/new"), (2, "http://good.net/new"), (3, "http://new.net/")], "page_id long, url string")
    assert [r.verdict for r in filter_urls(pages, (), labelled).orderBy("page_id").collect()] == ["block", "allow", "allow"]
    assert filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_posterior_bound_equals_the_beta_distribution(spark):
    import math

    from pyspark.sql import functions as F

    from tilewave.llm.url_filter import chance_under

    cases = [(a, b, r) for a in (1, 2, 5, 30, 400) for b in (1, 3, 20, 300) for r in (0.3, 0.5)]
    for r in (0.3, 0.5):
        df = spark.createDataFrame([(float(a), float(b)) for a, b, x in cases if x == r], "a double, b double")
        for row in df.select("a", "b", chance_under(F.col("a"), F.col("b"), r).alias("p")).collect():
            n = int(row.a + row.b) - 1
            want = sum(math.comb(n, j) * r**j * (1 - r) ** (n - j) for j in range(int(row.a), n + 1))
            assert abs(row.p - want) < 0.01, row


def test_url_reputation_without_labels(spark):
    from tilewave.llm.queries import URL_RULES
    from tilewave.llm.url_filter import filter_urls

    urls = [f"http://casino-win.a.net/{i}" for i in range(30)] + [f"http://news.b.net/{i}" for i in range(60)] + ["http://news.b.net/slots", "http://casino-win.a.net/", "http://never.seen.io/"]
    got = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES).collect()}
    assert all(got[i] == ("block" if "casino" in u else "allow") for i, u in enumerate(urls))


def test_url_edge_cases(spark):
    from tilewave.llm.queries import URL_RULES
    from tilewave.llm.url_filter import filter_urls

    rows = [(1, "http://a.com/fr/x", "h", 1, "p"), (1, "http://a.com/fr/x", "h", 1, "p"), (None, "http://a.com/fr/x", None, None, None), (2, None, "h", 2, "p"), (3, "http://" + "a" * 100_000 + ".com/de/" + "b" * 100_000, "h", 3, "p"), (4, "://", "h", 0, "p"), (5, "a://b://c", "h", 0, "p")]
    out = filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, bad int, path string"), URL_RULES).collect()
    assert sorted((r.page_id or 0, r.host[:3], r.path[:4], r.verdict) for r in out) == [(0, "a.c", "/fr/", "allow"), (1, "a.c", "/fr/", "allow"), (1, "a.c", "/fr/", "allow"), (2, "", "", "allow"), (3, "aaa", "/de/", "block"), (4, "", "", "allow"), (5, "b:", "//c", "allow")]


# ---- queries and pipeline -----------------------------------------------------------------------------------


def test_queries_with_sql_equal_it(spark, sf_dir):
    from tilewave.llm.queries import QUERIES, SQL

    con = connection(sf_dir)
    for name, sql in SQL.items():
        assert rows_of(QUERIES[name](spark, sf_dir)) == sql_rows(con, sql), name


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(17)
    items = [prose(rng, 12) for _ in range(3)]
    base = [prose(rng, 80) for _ in range(12)]
    texts = base + [base[0], base[1] + " one more word", prose(rng, 30) + " " + items[1] + " " + prose(rng, 40), "word " * 90, prose(rng, 10), None]
    at = str(tmp_path)
    docs_of(spark, texts).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    one = corpus_pipeline.quality_stage(spark, docs, at)
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    assert kept == set(range(15))
    two = corpus_pipeline.line_dedup_stage(spark, one, at)
    assert two.columns == docs.columns and {r.doc_id for r in two.where("text = ''").collect()} == {12}
    three = corpus_pipeline.near_dedup_stage(spark, two, at)
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == set(range(13)) | {14}
    four = corpus_pipeline.decontamination_stage(spark, three, at)
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} == set(range(13))
    assert {r.doc_id for r in corpus_pipeline.run(spark, at).collect()} == set(range(13))
