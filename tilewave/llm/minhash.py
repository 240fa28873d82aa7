"""Near-duplicate classes by DartMinHash.

A text is the weighted set of its five-word shingles, a shingle's weight being how often it occurs.
Darts fall on the plane of (weight, rank) of each shingle as a Poisson process of rate 1 that hashes
alone decide: the plane is cut into regions (a unit of weight by an interval of ranks), and each
region's hash says how many darts it holds and where. A text takes the darts under its weights up to a
rank that makes k*(ln k + 3) of them likely, throws each at one of k coordinates, and keeps the earliest
of each coordinate; a text with an empty coordinate is thrown for again with twice the rank. Two texts
keep the same dart at a coordinate with a probability equal to their weighted Jaccard similarity.
Bands of the signature are joined; pairs are verified by their exact weighted Jaccard similarity, and
classes are the connected components of what holds.

Equal texts (up to A-Z case and white space) are one node, named by their smallest doc_id. In a band's bucket each
node is first paired with the bucket's most central one, that which meets most others in all its buckets. Buckets that
then still hold several classes are searched in full: those of up to `small_bucket` nodes by pairs across
classes, larger ones by families.cross_links, which finds every link of the bucket without pairing all. So two nodes of a
bucket are of one class, or are known not to be alike. Hot buckets are split by the adaptive skew join.

Edge cases: a text of one to four words has one shingle, all its words; texts without words are equal
to one another. A null text is an empty one. A null doc_id has a null class. Rows that repeat a doc_id are one document:
what any of its texts is alike to is of its class, and all its rows have that class. An empty table gives an empty
table. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewave.llm.common import Scratch
from tilewave.llm.families import anchors_of, cross_links, differences, groups_of

WORDS = 5
SLICE = 3 << 20
#: Bounds of the rank intervals of a unit of weight: small ones first, as long texts take few ranks; 8 wide in the end.
RANKS = [0.0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0, 2.0, 4.0, 8.0]
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def elements(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text, hash) of each unit of weight, by text, and each text's normal form.

    The c-th occurrence of a shingle is an element of its own, of weight 1: so many units of its weight.
    """
    words = [t.lower().split() for t in texts]
    forms = [b" ".join(w) for w in words]
    n = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), forms
    ids, names = pd.factorize(np.array(flat, dtype=object))
    h = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)[ids]
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
    begins = np.flatnonzero((at + WORDS <= n[owner]) | ((n[owner] < WORDS) & (at == 0)))
    code = np.zeros(len(begins), np.uint64)
    last = n[owner[begins]] - at[begins]
    padded = np.r_[h, np.zeros(WORDS, np.uint64)]
    for k in range(WORDS):
        code = mixed(code * _M3 + np.where(k < last, padded[begins + k], np.uint64(0)) + np.uint64(k))
    owner = owner[begins]
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])]
    first = np.flatnonzero(new)
    copy = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
    return owner, mixed(code + copy.astype(np.uint64) * _M3), forms


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    term, total, bounds = math.exp(-mean), 0.0, []
    for i in range(64):
        total += term
        bounds.append(total)
        term *= mean / (i + 1)
    return np.searchsorted(np.array(bounds), u, side="right")


def signatures(owner: np.ndarray, code: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """(n_texts, k) darts, packed as rank and name; texts without elements have empty ones."""
    out = np.full(n_texts * k, _EMPTY, np.uint64)
    weight = np.bincount(owner, minlength=n_texts)
    darts = k * (math.log(k) + 3)
    todo = weight > 0
    while todo.any():
        out.reshape(n_texts, k)[todo] = _EMPTY
        top = np.where(todo, darts / np.maximum(weight, 1), 0.0)
        chosen = todo[owner]
        own, names, limit = owner[chosen], code[chosen], top[owner[chosen]]
        cell, low = 0, 0.0
        while len(own):
            high = RANKS[cell + 1] if cell + 1 < len(RANKS) else low + 8.0
            seed = mixed(names + np.uint64((cell + 1) * int(_M1) & 0xFFFFFFFFFFFFFFFF))
            count = np.minimum(_poisson(uniform(seed), high - low), 63)
            hit = np.flatnonzero(count)
            many = count[hit]
            which = np.repeat(hit, many)
            nth = np.arange(len(which)) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many) if len(hit) else np.zeros(0, np.int64)
            dart = mixed(seed[which] + (nth.astype(np.uint64) + np.uint64(1)) * _M3)
            rank = (low + uniform(mixed(dart + _M2)) * (high - low)).astype(np.float32)
            under = rank < limit[which]
            dart, rank, to = dart[under], rank[under], own[which[under]]
            packed = rank.view(np.uint32).astype(np.uint64) << np.uint64(32) | dart & np.uint64(0xFFFFFFFF)
            np.minimum.at(out, to * k + (mixed(dart + _M1) % np.uint64(k)).astype(np.int64), packed)
            cell, low = cell + 1, high
            more = limit > low
            if not more.all():
                own, names, limit = own[more], names[more], limit[more]
        todo = (out.reshape(n_texts, k) == _EMPTY).any(axis=1) & (weight > 0)
        darts *= 2
    return out.reshape(n_texts, k)


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    begin, n = 0, len(texts)
    while begin < n:
        end, total, part = begin, 0, []
        while end < n and (end == begin or total < SLICE):
            part.append(texts[end].as_py() or b"")
            total += len(part[-1])
            end += 1
        yield begin, part
        begin = end


def text_signatures(docs: DataFrame, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, c1, c2 (hash of the normal form), bands (band hashes)."""
    k = bands * rows
    names = ["doc_id", "c1", "c2", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _slices(batch.column(1)):
                owner, code, forms = elements(texts)
                sig = signatures(owner, code, len(texts), k)
                key = np.zeros((len(texts), bands), np.uint64)
                for r in range(rows):
                    key = mixed(key * _M3 + sig.reshape(len(texts), bands, rows)[:, :, r])
                has = np.bincount(owner, minlength=len(texts)) > 0
                c = [xxhash.xxh3_128_intdigest(f) for f in forms]
                halves = np.array([[x >> 64, x & 0xFFFFFFFFFFFFFFFF] for x in c], np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, len(texts)), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                    pa.array([row if h else [] for row, h in zip(key.view(np.int64), has)], pa.list_(pa.int64())),
                ], names)

    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, c1 long, c2 long, bands array<long>")


def _grams(texts: DataFrame) -> DataFrame:
    """doc, grams: the elements' hashes (4 bytes each), sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in _slices(batch.column(1)):
                owner, code, _ = elements(part)
                small = (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                edge = np.searchsorted(owner, np.arange(len(part) + 1))
                grams = [np.unique(small[a:b]).tobytes() for a, b in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(part)), pa.array(grams, pa.binary())], ["doc", "grams"])

    return texts.mapInArrow(run, "doc long, grams binary")


def linked(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs whose weighted Jaccard similarity is at least `similarity`. a is joined last, as it may be in very many pairs."""
    ga = grams.select(F.col("doc").alias("a"), F.col("grams").alias("ga"))
    gb = grams.select(F.col("doc").alias("b"), F.col("grams").alias("gb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(gb.hint("merge"), "b").join(ga.hint("merge"), "a").select("a", "b", "ga", "gb")
    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """(doc, label): each node of the edges (a, b) and the smallest node of its component. Labels spread and jump."""
    links = keep(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = keep(links.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.col("doc")).alias("label")), "labels")
    while True:
        of_b = labels.select(F.col("doc").alias("b"), F.col("label").alias("near"))
        spread = links.join(of_b, "b").groupBy(F.col("a").alias("doc")).agg(F.min("near").alias("near"))
        mine = labels.join(spread, "doc").select("doc", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        top = labels.select(F.col("doc").alias("label"), F.col("label").alias("jump"))
        new = keep(mine.join(top, "label").select("doc", "old", F.least("label", "jump").alias("label")), "labels")
        if new.where("label < old").isEmpty():
            return new
        labels = new.select("doc", "label")


def merged(labels: DataFrame, edges: DataFrame, keep: Scratch) -> DataFrame:
    """labels after more edges: components of the classes that the edges join, each class being one node."""
    la, lb = labels.select(F.col("doc").alias("a"), F.col("label").alias("la")), labels.select(F.col("doc").alias("b"), F.col("label").alias("lb"))
    across = edges.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a != b")
    across = keep(across, "across")
    if across.isEmpty():
        return labels
    roots = components(across, keep)
    moved = labels.join(roots.select(F.col("doc").alias("label"), F.col("label").alias("root")), "label", "left").select("doc", F.coalesce("root", "label").alias("label"))
    new = roots.join(labels.select("doc"), "doc", "left_anti").select("doc", "label")
    return keep(moved.union(new), "merged")


def _split(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """rows (doc, key, ...) with each doc's label, of the keys that hold several."""
    named = rows.join(labels.select("doc", F.col("label").alias("of")), "doc", "left").select(*rows.columns, F.coalesce("of", "doc").alias("label"))
    several = named.groupBy(key).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select(key)
    return named.join(several, key, "left_semi")


def near_classes(docs: DataFrame, similarity: float = 0.8, bands: int = 26, rows: int = 5, small_bucket: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id: the smallest doc_id of the row's class of near-duplicates. One row per row of docs."""
    keep = Scratch()
    sigs = keep(text_signatures(docs, bands, rows, id_col, text_col), "signatures")
    # equal texts: one node, their smallest doc_id
    same = keep(sigs.groupBy("c1", "c2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    own = sigs.join(same.select("c1", "c2", "node"), ["c1", "c2"], "left").select("doc_id", "bands", F.coalesce("node", "doc_id").alias("node"))
    nodes = keep(own.select("doc_id", "node"), "nodes")
    firsts = own.where("doc_id = node")
    keyed = keep(firsts.select(F.col("doc_id").alias("doc"), F.posexplode("bands").alias("band", "key")).select("doc", F.xxhash64("band", "key").alias("key")), "keyed")
    buckets = keyed.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("size")).where("low < high")
    crowd = keep(keyed.join(buckets.select("key", "size"), "key"), "crowd")
    central = keep(crowd.groupBy("doc").agg(F.sum("size").alias("central")), "central")
    # rank: by how many a node meets, then the smallest
    crowd = keep(crowd.join(central, "doc").select("doc", "key", "size", F.struct("central", (-F.col("doc")).alias("minus")).alias("rank")), "ranked")
    crowd = keep(crowd.join(crowd.groupBy("key").agg(F.max("rank").alias("top")), "key").select("doc", "key", "size", "top"), "topped")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    # the same plan at every size: a list of documents is broadcast at none
    grams = keep(_grams(texts.join(central.select("doc").hint("merge"), "doc", "left_semi")), "grams")
    stars = crowd.select((-F.col("top.minus")).alias("a"), F.col("doc").alias("b")).where("a != b").distinct()
    # the rows of one doc_id are one document
    several = nodes.groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("doc_id")
    repeats = nodes.join(several, "doc_id").where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    edges = keep(linked(stars, grams, similarity).union(repeats), "edges")
    labels = components(edges, keep)
    # buckets whose nodes aren't of one class yet
    rest = keep(_split(crowd, labels, "key"), "rest")
    few = rest.where(F.col("size") <= small_bucket)
    left, right = few.select("key", F.col("doc").alias("a"), F.col("label").alias("la")), few.select("key", F.col("doc").alias("b"), F.col("label").alias("lb"))
    pairs = left.join(right, "key").where("a < b and la != lb").select("a", "b").distinct()
    apart = keep(differences(groups_of(rest.where(F.col("size") > small_bucket)), grams, similarity), "apart")
    anchors = keep(anchors_of(apart), "anchors")
    to_anchor = apart.join(anchors, "grp").where("doc != anchor").select(F.col("anchor").alias("a"), F.col("doc").alias("b"))
    found = keep(linked(pairs.union(to_anchor.distinct()), grams, similarity), "found")
    labels = merged(labels, found, keep)
    if not anchors.isEmpty():
        labels = merged(labels, cross_links(_split(apart, labels, "grp"), anchors), keep)
    keep.drop(nodes, labels)
    out = nodes.join(labels.select(F.col("doc").alias("node"), "label"), "node", "left").select("doc_id", F.coalesce("label", "node").alias("class_id"))
    none = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return out.union(none)
