"""Periodic runs inside a text, from a dictionary of basic factors.

A basic factor is a stretch of 2^k words; two places have the same name on level k if their stretches are equal. Level k + 1
names pairs of names of level k. On each level, every place is linked to the successor occurrence of its factor in its text.
A period p is proposed on the level of the smallest length l = 2^k >= p, by successors at a distance over l / 2 (twice the
length of the level before) and at most l: neighbouring places with the same distance p are an arithmetic progression of
occurrences, and the stretch that they span is a run. It can't be extended, and p is its smallest period: a factor holds a
whole period, so that a place of the run whose successor is nearer than p would give the run a period that divides p, and
then all of its places would have nearer successors. Runs of one period come from one level, so that none is found twice.

A run counts if its length is at least `min_words` and at least `min_powers` periods. Names are kept of two levels at a time,
and only of places whose factor the text repeats: a text of n words takes some 100 bytes a word, whatever its repetition.

Edge cases: a null or empty text has no words and no runs. A null doc_id plants no period. Texts are read whole, in slices
of about 4 MB; one longer text is a slice of its own. Repeated rows give repeated results, an empty table an empty one.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewave.llm.quality import covered, slices

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def named(order: np.ndarray, new: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, distances to the successor) of all places: -1 and 0 where a factor occurs once. order: places by factor, then place;
    new: where a factor begins in it."""
    names, far = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    if len(order):
        begin = np.flatnonzero(new)
        length = np.diff(np.r_[begin, len(order)])
        several = np.repeat(length > 1, length)
        names[order[several]] = np.repeat(begin, length)[several]
        same = np.flatnonzero(~new[1:])
        far[order[same]] = order[same + 1] - order[same]
    return names, far


def periodic_runs(words: np.ndarray, text: np.ndarray, min_words: int, min_powers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of texts laid one after another. words: ids; text: the text of each word, rising."""
    if min_powers < 3:
        raise ValueError("a run of under three periods may be too short for two factors that hold a period each")
    n = len(words)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if n:
        sizes = np.bincount(text)
        stop = np.cumsum(sizes)[text]  # where each word's text ends
        key = text.astype(np.int64) * (int(words.max()) + 1) + words
        order = np.argsort(key, kind="stable")
        key = key[order]
        names, far = named(order, np.r_[True, key[1:] != key[:-1]], n)
        length = 1
        while True:
            at = np.flatnonzero((2 * far > length) & (far <= length))
            if len(at):
                d = far[at]
                new = np.r_[True, (at[1:] != at[:-1] + 1) | (d[1:] != d[:-1])]
                first = np.flatnonzero(new)
                last = np.r_[first[1:], len(at)] - 1
                found.append((at[first], at[last] - at[first] + d[first] + length, d[first].astype(np.int64)))
            if min_powers * (length + 1) > int(sizes.max()):
                break
            # a run of a longer period has at least min_powers * (length + 1) words
            here = np.flatnonzero((names >= 0) & (np.arange(n) + 2 * length <= stop) & (sizes[text] >= min_powers * (length + 1)))
            here = here[names[here + length] >= 0]
            if not len(here):
                break
            pair = names[here].astype(np.int64) * n + names[here + length]
            by = np.argsort(pair, kind="stable")
            pair = pair[by]
            names, far = named(here[by], np.r_[True, pair[1:] != pair[:-1]], n)
            length *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, size, period = (np.concatenate(x) for x in zip(*found))
    long = size >= np.maximum(min_words, min_powers * period)
    start, size, period = start[long], size[long], period[long]
    by = np.lexsort((period, start))
    return start[by], size[by], period[by]


def planted(words: list[bytes], doc: int | None) -> list[bytes]:
    """The words of a document; for one id in ten, by its checksum, a tail that repeats with a period."""
    h, n = zlib.crc32(b"%d" % doc) if doc is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def analysed(ids: list, texts: list[bytes], plant: bool, min_words: int, min_powers: int) -> list[list]:
    split = [t.split() for t in texts]  # bytes split at ASCII white space only
    if plant:
        split = [planted(w, i) for w, i in zip(split, ids)]
    sizes = np.array([len(w) for w in split], np.int64)
    base = np.r_[0, np.cumsum(sizes)]
    flat = [w for ws in split for w in ws]
    text = np.repeat(np.arange(len(split)), sizes)
    words = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64) if flat else np.zeros(0, np.int64)
    start, length, period = periodic_runs(words, text, min_words, min_powers)
    drop = covered(start + period, length - period, len(flat))
    cuts = np.searchsorted(start, base)
    out: list[list] = [[] for _ in range(8)]
    for k, own in enumerate(split):
        s, e, p = (x[cuts[k] : cuts[k + 1]].tolist() for x in (start, length, period))
        s = [x - int(base[k]) for x in s]
        best = min(range(len(s)), key=lambda i: (-e[i], s[i], p[i])) if s else None
        gone = drop[base[k] : base[k + 1]]
        kept = [w for w, g in zip(own, gone.tolist()) if not g] if gone.any() else own
        runs = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s, e, p))
        row = [None] * 4 if best is None else [s[best], e[best], p[best], 1000 * e[best] // p[best]]
        for column, value in zip(out, [ids[k], len(s), *row, hashlib.sha256(runs.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()]):
            column.append(value)
    return out


def run_digests(docs: DataFrame, plant: bool = False, min_words: int = 6, min_powers: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, its number of runs, its longest run (start, length, period, exponent_milli), the digest of all runs and that of
    the text with each run cut to its first period. plant: repeat the tails of one document in ten first, as planted() says."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column(1)):
                cols = analysed(batch.column(0).slice(begin, len(texts)).to_pylist(), texts, plant, min_words, min_powers)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(run, SCHEMA)


def text_runs(text: str | None, min_words: int = 6, min_powers: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text, in words."""
    words = (text or "").encode().split()
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64) if words else np.zeros(0, np.int64)
    return list(zip(*(x.tolist() for x in periodic_runs(ids, np.zeros(len(words), np.int64), min_words, min_powers))))


def collapse_runs(docs: DataFrame, min_words: int = 6, min_powers: int = 4, text_col: str = "text") -> DataFrame:
    """docs with each run of a text cut to its first period; texts without runs stay as they are, others are joined by one space."""
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(column).to_pylist():
                if spans := text_runs(text, min_words, min_powers):
                    words = text.encode().split()
                    start, length, period = map(np.array, zip(*spans))
                    gone = covered(start + period, length - period, len(words))
                    text = b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode()
                out.append(text)
            yield batch.set_column(column, batch.schema.field(column), pa.array(out, batch.schema.field(column).type))

    return docs.mapInArrow(run, docs.schema)
