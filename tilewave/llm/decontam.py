"""Benchmark decontamination by q-gram lemma filtering.

An item of m bytes matches a region of a text if its edit distance to it is at most k, a share of m.
By the q-gram lemma such a region has at least m - q + 1 - k*q of the item's q-grams, on diagonals (place in
the text less place in the item) within k of where the region begins. Shared q-grams are counted in
overlapping diagonal bands: each band is twice as wide as those diagonals spread, and begins half a band
after the one before, so that one band holds them all. Bands that reach the bound are retained and
verified by banded alignment, free at both ends of the region.

Texts and items are compared as UTF-8 bytes, A-Z lower-cased, ASCII punctuation and white space as spaces.
q is 8, or what still lets the lemma ask for a shared q-gram if an item is short: its bytes over its edits and one.
The items' q-gram index is broadcast in blocks of at most `block_bytes` of item text, each block
against all texts and one at a time, so that its size is bounded however large the benchmark; n blocks are n scans.

Edge cases: null and empty texts match nothing; items without a letter, a digit or a non-ASCII character, and null items, likewise.
Items of any other length are looked for, one of under 1 / edit_share bytes only as it stands: `min_bytes` leaves those out that
are too short to tell a leak from chance. Repeated rows give repeated results. Several
matches of an item in a text are one row, the best. An empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewave.llm.common import OWN, stored

Q = 8
SLICE = 2 << 20
_FOLD = bytes(32 if b < 128 and not chr(b).isalnum() else (b + 32 if 65 <= b <= 90 else b) for b in range(256))
SCHEMA = "doc_id long, item_id long, start long, stop long, edits long, budget long"


def folded(text: bytes) -> bytes:
    return text.translate(_FOLD)


def grams(raw: np.ndarray, q: int) -> np.ndarray:
    """The code of the q bytes from each place on; raw has q bytes at least, and q is 8 at most."""
    out = np.zeros(len(raw) - q + 1, np.uint64)
    for k in range(q):
        out |= raw[k : k + len(out)].astype(np.uint64) << np.uint64(8 * k)
    return out


class ItemIndex:
    """The q-grams of items of one q."""

    BITS, TABLE, HITS = 22, 1 << 22, 1 << 22
    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, items: list[tuple[int, bytes]], q: int, edit_share: float):
        self.items, self.q = items, q
        m = np.array([len(f) for _, f in items], np.int64)
        self.budget = (m * edit_share).astype(np.int64)
        self.bound = m - q + 1 - self.budget * q
        self.stride = 2 * self.budget + 1
        #: Of what a match takes up with its bands, at most.
        self.reach = int((m + 4 * self.stride).max())
        codes = [grams(np.frombuffer(f, np.uint8), q) for _, f in items]
        flat = np.concatenate(codes)
        order = np.argsort(flat, kind="stable")
        self.item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])[order]
        self.place = np.concatenate([np.arange(len(c)) for c in codes])[order]
        self.codes, first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.first = first
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self._slot(self.codes)] = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * self.MIX) >> np.uint64(64 - self.BITS)

    def regions(self, raw: np.ndarray) -> list[tuple[int, int]]:
        """(item, first place) of the bands of a folded text that reach the bound."""
        if len(raw) < self.q:
            return []
        codes = grams(raw, self.q)
        at = np.flatnonzero(self.seen[self._slot(codes)])
        which = np.searchsorted(self.codes, codes[at])
        which[which == len(self.codes)] = 0
        real = self.codes[which] == codes[at]
        at, which = at[real], which[real]
        n = self.count[which]
        total = int(n.sum())
        if not total:
            return []
        if total > self.HITS and len(raw) > 4 * self.reach:
            # the same few q-grams over and over: in halves that both hold what lies across the middle
            half = len(raw) // 2
            return sorted({*self.regions(raw[: half + self.reach]), *((i, place + half) for i, place in self.regions(raw[half:]))})
        slot = np.repeat(self.first[which] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(total)
        item, place = self.item[slot], self.place[slot]
        band = (np.repeat(at, n) - place + len(raw)) // self.stride[item]  # shifted so as to be positive
        span = 2 * len(raw) + 2
        key = item * span + band
        # counts by key modulo a table's size are never too small: most hits fall out before the sort
        votes = np.bincount(key & (self.TABLE - 1), minlength=self.TABLE)
        here = votes[key & (self.TABLE - 1)]
        most = here + np.maximum(votes[(key + 1) & (self.TABLE - 1)], votes[(key - 1) & (self.TABLE - 1)])
        keep = most >= self.bound[item]
        key, place = key[keep], place[keep]
        keys = self._reaching(key, span)
        if not len(keys):
            return []
        # an item's q-gram counts once in a band, however often the text repeats it
        near = np.isin(key, np.r_[keys, keys + 1])
        key, place = np.r_[key[near], key[near] - 1], np.r_[place[near], place[near]]
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        keys, votes = np.unique(key[np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1])]], return_counts=True)
        keys = keys[votes >= self.bound[keys // span]]
        return [(int(k // span), int((k % span) * self.stride[k // span] - len(raw))) for k in keys]

    def _reaching(self, key: np.ndarray, span: int) -> np.ndarray:
        """The bands, each two strides wide, with enough hits; places that repeat still count each time."""
        if not len(key):
            return key
        key, votes = np.unique(key, return_counts=True)
        after = np.searchsorted(key, key + 1)
        after[after == len(key)] = 0
        both = votes + np.where(key[after] == key + 1, votes[after], 0)
        bound = self.bound[key // span]
        return np.union1d(key[both >= bound], key[votes >= bound] - 1)

    def matches(self, flat: bytes) -> dict[int, tuple[int, int, int, int]]:
        """item id -> (edits, start, stop, budget) of the best match of each item in a folded text, places in bytes."""
        best: dict[int, tuple[int, int, int]] = {}
        raw = np.frombuffer(flat, np.uint8)
        for i, begin in self.regions(raw):
            k, item = int(self.budget[i]), self.items[i][1]
            low, high = max(0, begin - k), min(len(flat), begin + 2 * int(self.stride[i]) + len(item) + k)
            if (exact := flat.find(item, low, high)) >= 0:
                best[i] = min(best.get(i, (1, 0, 0)), (0, exact, exact + len(item)))
                continue
            if not k or i in best and not best[i][0]:
                continue
            edits, stop = aligned(item, raw[low:high], k)
            if edits <= k and (i not in best or (edits, low + stop) < best[i][::2]):
                back, length = aligned(item[::-1], raw[low : low + stop][::-1], k)
                best[i] = (edits, low + stop - length, low + stop)
        return {self.items[i][0]: (*found, int(self.budget[i])) for i, found in best.items()}


class BlockIndex:
    """The items of a block, by the q that their size asks for."""

    def __init__(self, items: list[tuple[int, bytes]], edit_share: float, min_bytes: int):
        by: dict[int, list[tuple[int, bytes]]] = {}
        for i, text in items:
            f = folded(text)
            if len(f) >= min_bytes and f.strip():
                by.setdefault(min(Q, len(f) // (int(len(f) * edit_share) + 1)), []).append((i, f))
        self.parts = [ItemIndex(own, q, edit_share) for q, own in sorted(by.items())]

    def matches(self, text: bytes) -> list[tuple[int, int, int, int, int]]:
        """(item id, start, stop, edits, budget), places in bytes."""
        flat, best = folded(text), {}
        for part in self.parts:
            best |= part.matches(flat)
        return [(i, start, stop, edits, budget) for i, (edits, start, stop, budget) in sorted(best.items())]


def aligned(item: bytes, region: np.ndarray, k: int) -> tuple[int, int]:
    """(edits, stop) of the best place of item in region; the band is all diagonals on which the item can begin, and k more."""
    m, n = len(item), len(region)
    low, high = -k, max(n - m, 0) + k  # diagonals: place in region less place in item
    width = high - low + 1
    big = m + n + 1
    step = np.arange(width)
    padded = np.full(m + n + 2 * width + 2, -1, np.int16)
    shift = width + 1
    padded[shift : shift + n] = region
    diagonal = low + step
    row = np.where((diagonal >= 0) & (diagonal <= n), 0, big)
    for i in range(1, m + 1):
        j = diagonal + i  # region bytes used
        taken = padded[shift + low + i - 1 : shift + low + i - 1 + width]
        base = np.minimum(row + (taken != item[i - 1]), np.r_[row[1:], big] + 1)
        base = np.where((j >= 0) & (j <= n), base, big)
        row = np.minimum.accumulate(base - step) + step
        row = np.where((j >= 0) & (j <= n), row, big)
    at = int(np.argmin(row))
    return int(row[at]), low + at + m


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's items, in blocks of at most block_bytes (one longer item is a block)."""
    block: list[tuple[int, bytes]] = []
    total = 0
    rows = benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).where(f"{text_col} is not null and {id_col} is not null")
    for i, text in rows.toLocalIterator():
        if block and total + len(text) > block_bytes:
            yield block
            block, total = [], 0
        block.append((i, bytes(text)))
        total += len(text)
    if block:
        yield block


def _characters(text: bytes, place: int) -> int:
    return len(text[:place].decode("utf-8", "ignore"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.1, min_bytes: int = 1, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, start, stop (code points), edits, budget."""
    if not 0 <= edit_share < 0.5:
        raise ValueError("edit_share must be under one half")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    parts: list[DataFrame] = []
    held = None
    for block in item_blocks(benchmark, "item_id", "text", block_bytes):
        if held is not None:
            # one index at a time: what the block before has found is written, and its broadcast goes
            parts[-1] = stored(parts[-1], "leaks")
            held.destroy()
        held = shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = BlockIndex(shipped.value, edit_share, min_bytes)
            for batch in batches:
                rows = []
                for doc, text, found in scanned(index, batch.column(0), batch.column(1)):
                    rows += [(doc, i, _characters(text, s), _characters(text, e), d, k) for i, s, e, d, k in found]
                cols = list(zip(*rows)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        parts.append(own.mapInArrow(run, SCHEMA))
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], SCHEMA)


def scanned(index: BlockIndex, ids: pa.Array, texts: pa.Array) -> Iterator[tuple]:
    """(id, text, matches) of the texts that have any. Short texts are searched together: a slice at a time."""
    n, begin = len(texts), 0
    while begin < n:
        end, parts, starts, total = begin, [], [], 0
        while end < n and (end == begin or total < SLICE):
            data = texts[end].as_py() or b""
            starts.append(total)
            parts.append(data)
            total += len(data) + 1
            end += 1
        joined = np.frombuffer(b"\x00".join(parts).translate(_FOLD), np.uint8)
        edges = np.array(starts)
        hit = set()
        for own in index.parts:
            for i, place in own.regions(joined):
                # the region's band can reach into the texts beside the one that it lies in
                low = np.searchsorted(edges, place, "right") - 1
                high = np.searchsorted(edges, place + 2 * int(own.stride[i]) + len(own.items[i][1]), "right") - 1
                hit.update(range(max(0, int(low)), int(high) + 1))
        for k in sorted(hit):
            if found := index.matches(parts[k]):
                yield ids[begin + k].as_py(), parts[k], found
        begin = end


def drop_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.1, min_bytes: int = 1, block_bytes: int = 8 << 20, text_col: str = "text") -> DataFrame:
    """docs less the rows whose text holds an item. All columns pass through. With one block no row is dealt out; with several, the
    leaking texts of all blocks are gathered by their hashes first."""
    blocks = item_blocks(benchmark, "item_id", "text", block_bytes)
    block, more = next(blocks, None), next(blocks, None)
    if block is None:
        return docs
    if more is not None:
        own = docs.withColumn(f"{OWN}text", F.xxhash64(F.coalesce(text_col, F.lit(""))))
        leaks = find_leaks(own, benchmark, edit_share, min_bytes, block_bytes, f"{OWN}text", text_col)
        return own.join(leaks.select(F.col("doc_id").alias(f"{OWN}text")).distinct(), f"{OWN}text", "left_anti").select(*docs.columns)
    shipped = docs.sparkSession.sparkContext.broadcast(block)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = BlockIndex(shipped.value, edit_share, min_bytes)
        for batch in batches:
            texts = batch.column(column).cast(pa.binary())
            leaked = {k for k, _, _ in scanned(index, pa.array(range(batch.num_rows), pa.int64()), texts)}
            yield batch.filter(pa.array([k not in leaked for k in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
