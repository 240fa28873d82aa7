"""Quality rules: repetition inside a text, from a suffix array over its words.

The words of a batch of texts are ranked together by prefix doubling, where only suffixes that aren't
yet alone in their group are ranked further, and one level is kept at a time. The common prefix of neighbours in the
suffix array, found in the order of the text, where it shrinks by one word a place at most, bounds the LCP intervals; the larger of a suffix's two is the longest repeat that begins there. Repeats of at
least `min_repeat` words are the maximal repeated substrings; the union of their spans over the text's
words is the covered fraction. A text is kept if it meets the base rules, its covered fraction is at
most `max_covered` and its longest repeat has at most `max_longest` words.

Words are runs of characters other than ASCII white space. Suffixes end where their text ends: each
text's end has a rank of its own, so that no repeat spans two texts.

Edge cases: a null or empty text has no words and fails the base rules. Texts are read whole, in slices
of about SLICE bytes; one longer text is a slice of its own. Repeated rows give repeated results, an
empty table an empty one. Extra columns are ignored. A text takes some 40 bytes of memory a byte, whatever its repetition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 4 << 20
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def longest_repeats(words: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """For each word: the words of the longest repeat that begins there, inside its text.

    words: ids of all words, texts one after another; text: the text of each word, rising from 0.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    # one more position for each text's end, which is unlike all others
    at = np.arange(n) + text
    size = n + n_texts
    rank = np.empty(size, np.int64)
    ends = np.setdiff1d(np.arange(size), at, assume_unique=True)
    # ends are below words: rank k of the k-th end; words of the same id in different texts differ
    key = text.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
    group = np.repeat(first, np.diff(np.r_[first, n]))
    rank[ends] = np.arange(n_texts)
    rank[at[order]] = group + n_texts
    sa = at[order]  # suffixes by rank, the ends left out
    symbols = rank.copy()
    step = 1
    multi = np.diff(np.r_[first, n]) > 1
    open_ = np.repeat(multi, np.diff(np.r_[first, n]))  # slots of sa whose group isn't single
    while open_.any():
        slots = np.flatnonzero(open_)
        who = sa[slots]
        head, tail = rank[who], rank[who + step]
        by = np.lexsort((tail, head))
        who, head, tail = who[by], head[by], tail[by]
        sa[slots] = who
        new = np.r_[True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])]
        begin = np.flatnonzero(new)
        length = np.diff(np.r_[begin, len(who)])
        rank[who] = np.repeat(slots[begin], length) + n_texts
        open_[slots] = np.repeat(length > 1, length)
        step *= 2
    lcp = common_prefixes(symbols, sa)
    best = np.zeros(size, np.int64)
    best[sa] = np.maximum(np.r_[0, lcp], np.r_[lcp, 0])
    return best[at]


LANES = 1024


def common_prefixes(symbols: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """How many symbols each two neighbours of the suffix array have in common. Symbols must differ somewhere before either suffix ends.

    A place's common prefix with its neighbour is at least that of the place before, less one. Stretches of places go side by side; only
    the first place of each is compared from its beginning.
    """
    size = len(symbols)
    before = np.full(size, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(size, np.int64)
    lanes = max(1, min(LANES, size // 64))
    edges = np.arange(lanes + 1) * size // lanes
    at, stop = edges[:-1].copy(), edges[1:]
    have = np.zeros(lanes, np.int64)
    for k in range(lanes):
        p, q, step = int(at[k]), int(before[at[k]]), 64
        while q >= 0:
            a, b = symbols[p + have[k] : p + have[k] + step], symbols[q + have[k] : q + have[k] + step]
            n = min(len(a), len(b))
            unlike = np.flatnonzero(a[:n] != b[:n])
            have[k] += unlike[0] if len(unlike) else n
            if len(unlike):
                break
            step = min(2 * step, 1 << 16)
    live = np.flatnonzero(at < stop)
    at, stop, have = at[live], stop[live], have[live]
    while len(at):
        q = before[at]
        same = (q >= 0) & (symbols[at + have] == symbols[q + have])
        have[same] += 1
        done = ~same
        ended = at[done]
        out[ended] = np.where(before[ended] >= 0, have[done], 0)
        at[done] += 1
        have[done] = np.maximum(have[done] - 1, 0)
        if (at >= stop).any():
            live = np.flatnonzero(at < stop)
            at, stop, have = at[live], stop[live], have[live]
    return out[sa[1:]]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Of n words, those in the union of the spans, as booleans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def repetition(texts: list[bytes], min_repeat: int) -> tuple[np.ndarray, ...]:
    """Per text: words, words in repeated 3-word windows, words in repeats of min_repeat, longest repeat."""
    split = [t.split() for t in texts]  # bytes split at ASCII white space only
    n_words = np.array([len(w) for w in split], np.int64)
    flat = [w for ws in split for w in ws]
    text = np.repeat(np.arange(len(texts)), n_words)
    ids = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64) if flat else np.zeros(0, np.int64)
    best = longest_repeats(ids, text, len(texts))
    out = []
    for least, window in ((3, 3), (min_repeat, None)):
        starts = np.flatnonzero(best >= least)
        spans = np.full(len(starts), window) if window else best[starts]
        out.append(np.bincount(text[covered(starts, spans, len(flat))], minlength=len(texts)))
    longest = np.zeros(len(texts), np.int64)
    if flat:
        np.maximum.at(longest, text, best)
    return n_words, out[0], out[1], longest


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measured(ids: list, texts: list[bytes], min_repeat: int, max_covered: float, max_longest: int) -> list[np.ndarray | list]:
    n_words, repeated, spans, longest = repetition(texts, min_repeat)
    word_chars, symbols = [], []
    # code points of words: bytes that begin one, white space left out
    for t in texts:
        raw = np.frombuffer(t, np.uint8)
        begins = np.count_nonzero((raw & 0xC0) != 0x80)
        word_chars.append(begins - sum(t.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
        symbols.append(sum(t.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))))
    failed = (n_words < 50) | (100 * repeated > 50 * n_words)
    kept = ~failed & (spans <= max_covered * n_words) & (longest <= max_longest)
    return [ids, n_words, word_chars, symbols, [dup_lines(t) for t in texts], repeated, failed, kept, spans, longest]


def slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) of about SLICE bytes."""
    begin, part, total = 0, [], 0
    for k, x in enumerate(texts):
        text = x.as_py() or b""
        if part and total + len(text) > SLICE:
            yield begin, part
            begin, part, total = k, [], 0
        part.append(text)
        total += len(text)
    if part:
        yield begin, part


def quality_rules(docs: DataFrame, min_repeat: int = 6, max_covered: float = 0.4, max_longest: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, covered_words, longest_repeat.

    min_repeat: words from which a repeat counts as a span; max_covered: share of words in such spans;
    max_longest: words of the longest repeat.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [{"long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column(1)):
                cols = measured(batch.column(0).slice(begin, len(texts)).to_pylist(), texts, min_repeat, max_covered, max_longest)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(run, SCHEMA)


def drop_rejects(docs: DataFrame, min_repeat: int = 6, max_covered: float = 0.4, max_longest: int = 200, text_col: str = "text") -> DataFrame:
    """docs less the rows whose text isn't kept; no row is dealt out, and all columns pass through."""
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[bool] = []
            for begin, texts in slices(batch.column(column).cast(pa.binary())):
                kept += measured([], texts, min_repeat, max_covered, max_longest)[7].tolist()
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
