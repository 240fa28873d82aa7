"""Substring dedup: passages of `window` words that an earlier document holds, by FM-indexes over shards.

Which texts can share a passage is found first, in small rows. Each window is named after the least hash of the `gram`-word grams in
it; neighbouring windows of one name are a run. Equal windows have equal names, and a name stands for some twenty windows. Names of
one text only can't be shared. Copies of whole texts need no search: the first of them stands for all.

The runs of shared names are cut out of their texts as segments. Segments of equal text are one, owned by the smallest doc_id. The
rest is dealt to shards by name, some `shard_words` words each. A shard builds a compressed FM-index of its segments, streams them
through it, and takes matching statistics by backward search: a window is repeated if it lies in a match of `window` words with a
segment of a smaller owner. Windows that a name holds in more than `hot_segments` different segments (the edges of a passage that a large
part of all documents has) would make one shard grow without bound: theirs are compared by 128-bit hashes in buckets of windows.

A word is removed if a repeated window covers it; windows are judged on the input. Words are runs of characters other than ASCII
white space, unchanged.

Edge cases: a null or empty text has no words. A null doc_id counts as one document after all others. Rows that repeat a doc_id are
one document: they aren't held against each other. Repeated rows have the same result. Texts are read whole. An empty table gives an
empty result. Extra columns, whatever their names, pass through drop_repeats untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewave.llm.common import OWN, Scratch
from tilewave.llm.fm_index import FMIndex
from tilewave.llm.quality import covered, slices

#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1
#: Windows of a run at most; longer ones, of periodic texts, are cut.
RUN = 64
#: Bytes of text whose words are hashed at a time.
PIECE = 1 << 20
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of stretches of a sequence, from one prefix sum: the same for equal stretches wherever they stand."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values) + 1
        weight = np.full(n, base, np.uint64)
        inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        weight[:1] = inverse[:1] = 1
        np.cumprod(weight, out=weight)
        self.inverse = np.cumprod(inverse)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values * weight[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, hash) of the words of bytes."""
    edge = np.diff(np.r_[True, _SPACE[raw], True].astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + PIECE, "right")))
        low = start[i]
        part = Rolling(raw[low : stop[j - 1]].astype(np.uint64) + np.uint64(1), _BYTE)
        out[i:j] = part.of(start[i:j] - low, stop[i:j] - low)
        i = j
    return start, stop, out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def window_runs(hashes: np.ndarray, text: np.ndarray, stop: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, windows) of the runs of texts laid one after another. text, stop: of each word, its text and where that ends."""
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(hashes) - gram + 1)
    least = sliding_least(Rolling(hashes, _WORD).of(place, place + gram), window - gram + 1)
    at = np.flatnonzero(np.arange(len(least)) + window <= stop[: len(least)])
    name, own = least[at], text[at]
    first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (own[1:] != own[:-1])][: len(at)])
    size = np.diff(np.r_[first, len(at)])
    pieces = -(-size // RUN)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, size = np.repeat(at[first], pieces) + RUN * nth, np.minimum(RUN, np.repeat(size, pieces) - RUN * nth)
    return np.repeat(name[first], pieces).view(np.int64), begin, size


RUNS = "doc long, t1 long, t2 long, n_words long, all_sha256 string, names array<long>, starts array<int>, sizes array<int>"


def text_runs(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(doc, t1, t2, text) -> RUNS."""
    for batch in batches:
        for begin, texts in slices(batch.column(3)):
            raw = np.frombuffer(b"\n".join(texts), np.uint8)
            start, _, hashes = word_hashes(raw)
            edges = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
            cut = np.searchsorted(start, edges)
            text = np.repeat(np.arange(len(texts)), np.diff(cut))
            name, first, size = window_runs(hashes, text, cut[1:][text], window, gram)
            offsets = np.searchsorted(first, cut).astype(np.int32)
            first = first - cut[:-1][text[first]] if len(first) else first
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, kind)) for x, kind in ((name, pa.int64()), (first, pa.int32()), (size, pa.int32()))]
            digests = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
            own = batch.slice(begin, len(texts))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(np.diff(cut), pa.int64()), pa.array(digests), *lists], ["doc", "t1", "t2", "n_words", "all_sha256", "names", "starts", "sizes"])


SEGMENTS = "name long, doc long, t1 long, t2 long, start int, size int, seg binary"


def cut_segments(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(doc, t1, t2, text, names, starts, sizes) -> SEGMENTS: the words of each run, joined by one space."""
    names = ["name", "doc", "t1", "t2", "start", "size", "seg"]
    types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for doc, t1, t2, text, own, starts, sizes in zip(*(batch.column(k) if k == 3 else batch.column(k).to_pylist() for k in range(7))):
            words = text.as_py().split()
            for name, start, size in zip(own, starts, sizes):
                for column, value in zip(rows, (name, doc, t1, t2, start, size, b" ".join(words[start : start + size + window - 1]))):
                    column.append(value)
            if len(rows[0]) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)
                rows = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)


def stretches(flags: np.ndarray) -> list[int]:
    """[begin, end, begin, end, ...] of the stretches of true values."""
    return np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8))).tolist()


_FOUND = [("name", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("spans", pa.list_(pa.int32()))]
FOUND = "name long, s1 long, s2 long, spans array<int>"


def found_batch(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * 4, _FOUND)], [n for n, _ in _FOUND])


def search_shard(shard: pa.Table, window: int) -> pa.Table:
    """(name, s1, s2, seg, owner) of a shard -> the windows of each segment that a segment of a smaller owner holds too."""
    split = [s.split(b" ") for s in shard.column("seg").to_pylist()]
    sizes = np.array([len(w) for w in split], np.int64)
    numbers = pd.factorize(np.array([w for ws in split for w in ws], dtype=object))[0].astype(np.int64) + 1
    owners = np.unique(shard.column("owner").to_numpy(), return_inverse=True)[1].astype(np.int32)
    matched, begin = FMIndex(numbers, sizes, owners).statistics()
    keys = [shard.column(c).to_pylist() for c in ("name", "s1", "s2")]
    rows = []
    hit = matched >= window
    counts = np.add.reduceat(hit, begin)
    for k in np.flatnonzero(counts):
        rows.append((*(c[k] for c in keys), stretches(hit[begin[k] : begin[k] + sizes[k]])))
    return found_batch(rows)


PACKED = "bucket int, data binary"
#: 128-bit hash of a window, owner, segment's key, place of the window in it.
_WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("owner", "<i8"), ("name", "<i8"), ("s1", "<i8"), ("s2", "<i8"), ("at", "<i4")])


def pack_windows(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(name, s1, s2, seg, owner) -> the windows by bucket of their hash, packed: a row for each bucket and batch."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 2_000):
            part = batch.slice(begin, 2_000)
            raw = np.frombuffer(b"\n".join(part.column(3).to_pylist()), np.uint8)
            _, _, hashes = word_hashes(raw)
            sizes = np.array([s.as_py().count(b" ") + 1 for s in part.column(3)])
            base = np.cumsum(sizes) - sizes
            windows = sizes - window + 1
            row = np.repeat(np.arange(len(sizes)), windows)
            at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            out = np.zeros(len(row), _WINDOW)
            first = base[row] + at
            out["h1"], out["h2"] = (Rolling(h, b).of(first, first + window) for h, b in ((hashes, _WORD), (mixed(hashes + np.uint64(_BYTE)), _BYTE)))
            for c, k in (("name", 0), ("s1", 1), ("s2", 2), ("owner", 4)):
                out[c] = part.column(k).to_numpy()[row]
            out["at"] = at
            bucket = (out["h1"] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            out, bucket = out[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([x.tobytes() for x in np.split(out, cuts[1:])], pa.binary())], ["bucket", "data"])


def search_windows(bucket: pa.Table) -> pa.Table:
    """Windows of a bucket of hashes -> those that a segment of a smaller owner holds too, by segment."""
    data = np.frombuffer(b"".join(bucket.column("data").to_pylist()), _WINDOW)
    order = np.lexsort((data["owner"], data["h2"], data["h1"]))
    data = data[order]
    new = np.r_[True, (data["h1"][1:] != data["h1"][:-1]) | (data["h2"][1:] != data["h2"][:-1])]
    least = data["owner"][np.flatnonzero(new)][np.cumsum(new) - 1]
    data = data[least < data["owner"]]
    key = ["name", "s1", "s2"]
    data = data[np.lexsort((data["at"], *(data[c] for c in key)))]
    cuts = np.flatnonzero(np.r_[True, np.any([data[c][1:] != data[c][:-1] for c in key], axis=0)][: len(data)])
    rows = []
    for part in np.split(data, cuts[1:]) if len(data) else []:
        flags = np.zeros(int(part["at"][-1]) + 1, bool)
        flags[part["at"]] = True
        rows.append((*(int(part[c][0]) for c in key), stretches(flags)))
    return found_batch(rows)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """doc, and 128 bits of the text: rows of one doc_id are told apart by their texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


KEY = ["doc", "t1", "t2"]


class RepeatSearch:
    """The tables of one search. runs: a row of RUNS for each row of the input; held: the texts with shared names; spans: (doc, t1, t2,
    spans) the words that each text loses, as begin and end; owners: (t1, t2, owner) of each text, its smallest doc."""

    def __init__(self, docs: DataFrame, window: int = 50, gram: int = 12, shard_words: int = 250_000, hot_segments: int = 4096, id_col: str = "doc_id", text_col: str = "text"):
        if not 0 < gram <= window:
            raise ValueError("gram must be from 1 to window")
        self.scratch, self.window = Scratch(), window
        spark = docs.sparkSession
        own = docs.select(*keyed(docs, id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
        runs = self.runs = self.scratch(own.mapInArrow(lambda b: text_runs(b, window, gram), RUNS), "window-runs")
        self.owners = self.scratch(runs.groupBy("t1", "t2").agg(F.min("doc").alias("owner")), "text-owners")
        each = runs.select(*KEY, F.explode(F.arrays_zip("names", "starts", "sizes")).alias("x")).select(*KEY, F.col("x.names").alias("name"), F.col("x.starts").alias("start"), F.col("x.sizes").alias("size"))
        shared = each.groupBy("name").agg(F.min("t1").alias("a"), F.max("t1").alias("b")).where("a != b").select("name")
        picked = each.join(shared.hint("merge"), "name").groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", "size", "name"))).alias("x"))
        # a later copy of a whole text loses it all anyway
        picked = picked.join(self.owners, ["t1", "t2"]).where("doc = owner").select(*KEY, F.col("x.name").alias("names"), F.col("x.start").alias("starts"), F.col("x.size").alias("sizes"))
        picked = self.scratch(picked, "shared-runs")
        self.held = self.scratch(own.join(picked, KEY).dropDuplicates(KEY), "texts-with-shared-runs")
        segments = self.scratch(self.held.mapInArrow(lambda b: cut_segments(b, window), SEGMENTS), "segments")
        digest = [F.xxhash64("seg").alias("s1"), F.xxhash64(F.lit(1), "seg").alias("s2")]
        distinct = self.scratch(segments.groupBy("name", "seg").agg(F.min("doc").alias("owner")).select("name", *digest, "seg", "owner"), "different-segments")
        several = distinct.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
        total = distinct.agg(F.sum(F.octet_length("seg"))).first()[0] or 0
        shards, buckets = 1 + total // (7 * shard_words), 1 + total // (64 << 10)
        search = distinct.join(several, "name")
        cold = search.where(F.col("n") <= hot_segments).select(F.pmod(F.xxhash64(F.lit(2), "name"), F.lit(shards)).alias("shard"), "name", "s1", "s2", "seg", "owner")
        found = cold.groupBy("shard").applyInArrow(lambda t: search_shard(t, window), FOUND)
        hot = search.where(F.col("n") > hot_segments).select("name", "s1", "s2", "seg", "owner")
        packed = hot.mapInArrow(lambda b: pack_windows(b, window, buckets), PACKED)
        found = found.unionAll(packed.groupBy("bucket").applyInArrow(search_windows, FOUND))
        found = found.groupBy("name", "s1", "s2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        judged = self.scratch(distinct.select("name", "s1", "s2", "owner").join(found, ["name", "s1", "s2"], "left"), "judged-segments")
        # a segment of a smaller owner is repeated as a whole, one's own where it was found
        placed = segments.select("name", *KEY, "start", "size", *digest).join(judged, ["name", "s1", "s2"])
        whole = F.array(F.lit(0), F.col("size"))
        local = F.when(F.col("doc") > F.col("owner"), whole).otherwise(F.col("spans"))
        placed = placed.select(*KEY, "start", local.alias("spans")).where("spans is not null")
        shifted = F.transform("spans", lambda x, k: x + F.col("start") + F.when(k % 2 == 1, window - 1).otherwise(0))
        self.spans = self.scratch(placed.groupBy(*KEY).agg(F.flatten(F.collect_list(shifted)).alias("spans")), "repeated-spans")
        self.spark = spark

    def all_spans(self) -> DataFrame:
        """(doc, t1, t2, n_words, spans): what each text loses, later copies of a whole text included; spans null: nothing."""
        own = self.runs.select(*KEY, "n_words").distinct().join(self.spans, KEY, "left").join(self.owners, ["t1", "t2"])
        copy = (F.col("doc") > F.col("owner")) & (F.col("n_words") >= self.window)
        return own.select(*KEY, "n_words", F.when(copy, F.array(F.lit(0), F.col("n_words").cast("int"))).otherwise(F.col("spans")).alias("spans"))


def kept_words(text: bytes, spans: list[int]) -> tuple[list[bytes], int]:
    """(the words that are left, how many go)."""
    words = text.split()
    at = np.array(spans).reshape(-1, 2)
    gone = covered(at[:, 0], at[:, 1] - at[:, 0], len(words))
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def repeat_digests(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the words that are left, joined by one space)."""
    search = RepeatSearch(docs, window, id_col=id_col, text_col=text_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [kept_words(t.as_py(), s.as_py()) for t, s in zip(batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([n for _, n in left], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in left], pa.string())], [*KEY, "n", "sha"])

    parts = search.held.select(*KEY, "text").join(search.spans, KEY).mapInArrow(run, "doc long, t1 long, t2 long, n long, sha string")
    rows = search.runs.select(*KEY, "n_words", "all_sha256").join(search.owners, ["t1", "t2"]).join(parts, KEY, "left")
    copy = (F.col("doc") > F.col("owner")) & (F.col("n_words") >= window)
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n", F.lit(0)))
    sha = F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "all_sha256"))
    out = search.scratch(rows.select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), "n_words", removed.alias("n_removed"), sha.alias("kept_sha256")), "repeats")
    search.scratch.drop(out)
    return out


def drop_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """docs with the repeated words of each text taken out; texts that lose none stay as they are, others are joined by one space."""
    search = RepeatSearch(docs, window, id_col=id_col, text_col=text_col, **options)
    spans = search.scratch(search.all_spans().where("spans is not null").select(*[F.col(c).alias(OWN + c) for c in (*KEY, "spans")]), "all-repeated-spans")
    search.scratch.drop(spans)
    own = docs.withColumns({OWN + c: e for c, e in zip(KEY, keyed(docs, id_col, text_col))}).join(spans, [OWN + c for c in KEY], "left").select(*docs.columns, OWN + "spans")
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).to_pylist()
            for k, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    texts[k] = b" ".join(kept_words(texts[k].encode(), spans)[0]).decode()
            yield batch.set_column(column, batch.schema.field(column), pa.array(texts, batch.schema.field(column).type)).select(range(batch.num_columns - 1))

    return own.mapInArrow(run, docs.schema)


#: The same for DuckDB over the view documents.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT k, doc_id, i, array_to_string(list_slice(words, i, i + 49), ' ') AS passage FROM (SELECT *, unnest(range(1, len(words) - 48)) AS i FROM d)),
f AS (SELECT passage, min(doc_id) AS first FROM g GROUP BY passage),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 50)) AS i FROM g JOIN f USING (passage) WHERE first < doc_id),
w AS (SELECT k, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM w ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""
