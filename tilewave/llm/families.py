"""Every link inside large groups of texts that mostly resemble one another, without pairing all.

The texts of a group are compared with a reference set R of elements, the consensus of some of its members. A text x
differs from R by the elements it lacks and those it adds; call these its differences and gap(x) = a|x| + lacks - |R|/2,
with a = s / (1 + s) for a similarity of s. Two texts have a Jaccard similarity of s or more exactly if they share
gap(x) + gap(y) differences or more. Hence:

* If that sum isn't positive, both texts are alike to the member of the smallest gap, the group's anchor. Pairs with
  the anchor find all such links.
* Other links share a difference. With differences ordered by how rare they are, they share one in the prefixes that are left
  when each text leaves out all but the first (its differences - the least overlap + 1). Edited words are rare,
  so few texts meet.

The reference only decides how few: links are found whatever it is, so that a bounded sample of members will do.
Texts of the anchor's class need not meet one another, nor texts of one class. The shared differences are looked up in
parts of a group of about `PART` elements each, so that no task holds a whole group; those who meet there are compared by all
their differences on the spot, and only links come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Members that make the consensus, elements looked up by one task, and meetings held before repeated ones go.
SAMPLE, PART, FOUND = 32, 200_000, 1 << 22
#: For rounding: an overlap this much under the bound is still looked at.
SLACK = 1e-6


def groups_of(buckets: DataFrame) -> DataFrame:
    """(grp, doc): buckets (doc, key, top) that share members are joined to one group, that of their best top, in one round."""
    best = buckets.groupBy("doc").agg(F.max("top").alias("best"))
    hubs = buckets.join(best, "doc").groupBy("key").agg(F.max("best").alias("hub"))
    return buckets.join(hubs, "key").select((-F.col("hub.minus")).alias("grp"), "doc").distinct()


def _consensus(members: DataFrame, grams: DataFrame) -> DataFrame:
    """grp, elems, counts, n: elements that several of n members hold, and how many do."""
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("doc"), "doc"))
    some = members.withColumn("place", place).where(F.col("place") <= SAMPLE).select("grp", "doc")

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        elems, counts = np.unique(np.concatenate([np.frombuffer(g, np.uint32) for g in rows["grams"]]), return_counts=True)
        several = counts > 1
        return pd.DataFrame([(key[0], elems[several].tobytes(), counts[several].astype(np.uint16).tobytes(), len(rows))], columns=["grp", "elems", "counts", "n"])

    return some.join(grams, "doc").groupBy("grp").applyInPandas(merge, "grp long, elems binary, counts binary, n long")


def _differences(x: np.ndarray, elems: np.ndarray, counts: np.ndarray, n: int, share: float) -> tuple[float, np.ndarray]:
    """(gap, differences by rarity). An element's rarity depends on itself alone, so the order is the same for all texts."""
    in_reference = counts * 2 > n
    held = np.isin(elems, x, assume_unique=True)
    lacks = in_reference & ~held
    added = np.setdiff1d(x, elems[in_reference], assume_unique=True)
    at = np.minimum(np.searchsorted(elems, added), max(len(elems) - 1, 0))
    known = elems[at] == added if len(elems) else np.zeros(len(added), bool)
    rarity = np.r_[np.where(known, counts[at], 0) if len(elems) else np.zeros(len(added), np.int64), n - counts[lacks].astype(np.int64)]
    both = np.r_[added, elems[lacks]]
    gap = share * len(x) + int(lacks.sum()) - int(in_reference.sum()) / 2
    return gap, both[np.lexsort((both, rarity))]


def differences(members: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """grp, doc, gap, delta: each member's gap and differences to its group's consensus."""
    share = similarity / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps, deltas = [], []
            for x, elems, counts, n in zip(*batch.columns[2:]):
                x, elems, counts = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(elems.as_buffer(), np.uint32), np.frombuffer(counts.as_buffer(), np.uint16)
                gap, delta = _differences(x, elems, counts, n.as_py(), share)
                gaps.append(gap)
                deltas.append(delta.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gaps, pa.float64()), pa.array(deltas, pa.binary())], ["grp", "doc", "gap", "delta"])

    rows = members.join(grams, "doc").join(_consensus(members, grams).hint("merge"), "grp")
    return rows.select("grp", "doc", "grams", "elems", "counts", "n").mapInArrow(run, "grp long, doc long, gap double, delta binary")


def anchors_of(apart: DataFrame) -> DataFrame:
    """grp, anchor, least: the member of the smallest gap, and that gap."""
    first = F.min(F.struct("gap", "doc"))
    return apart.groupBy("grp").agg(first.alias("x")).select("grp", F.col("x.doc").alias("anchor"), F.col("x.gap").alias("least"))


PARTED = "grp long, part long, doc long, label long, main boolean, elems binary, near long, gap double, delta binary"


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PARTED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.float64(), pa.binary()]
    for batch in batches:
        rows = []
        for grp, doc, label, main, parts, far, near, gap, delta in zip(*(c.to_pylist() for c in batch.columns)):
            elems = np.frombuffer(delta, np.uint32)[: max(far, near)]
            part = elems % np.uint32(parts)
            for p in np.unique(part):
                mine = part == p
                rows.append((grp, int(p), doc, label, main, elems[mine].tobytes(), int(mine[:near].sum()), gap, delta))
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema(list(zip(names, kinds))))


def _meetings(elems: list[np.ndarray], label: np.ndarray, main: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Codes x * n + y of the rows x and y that share an element and must be compared, in order."""
    n, size = len(elems), np.array([len(e) for e in elems], np.int64)
    flat, who = np.concatenate(elems), np.repeat(np.arange(n), size)
    place = np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
    order = np.argsort(flat, kind="stable")
    flat, who, close = flat[order], who[order], (place < near[who])[order]
    edge = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1], True])
    found, held = [np.zeros(0, np.int64)], 0
    for low, high in zip(edge, edge[1:]):
        if high - low < 2:
            continue
        w, c = who[low:high], close[low:high]
        inner, outer = w[main[w]], w[~main[w]]
        # with the anchor's class: all; with one another: by the prefix that their own bound leaves
        found.append((outer[:, None] * n + inner).ravel())
        rest = w[~main[w] & c]
        for k in range(1, len(rest)):
            found.append(rest[k] * n + rest[:k][label[rest[:k]] != label[rest[k]]])
        held += len(outer) * len(inner) + len(rest) ** 2 // 2
        if held > FOUND:
            found, held = [np.unique(np.concatenate(found))], 0
    return np.unique(np.concatenate(found))


def _meeting(rows: pd.DataFrame) -> pd.DataFrame:
    """(a, b) of the rows that share an element and are alike: enough of their differences are the same."""
    n, doc, gap = len(rows), rows["doc"].to_numpy(), rows["gap"].to_numpy()
    codes = _meetings([np.frombuffer(e, np.uint32) for e in rows["elems"]], rows["label"].to_numpy(), rows["main"].to_numpy(bool), rows["near"].to_numpy())
    deltas = [np.frombuffer(d, np.uint32) for d in rows["delta"]]
    size = np.array([len(d) for d in deltas], np.int64)
    begin = np.r_[0, np.cumsum(size)[:-1]]
    names, ids = np.unique(np.concatenate(deltas), return_inverse=True)
    mark, links = np.zeros(len(names), np.int64), []
    first, other = codes // n, codes % n
    for low, high in zip(*(lambda e: (e, e[1:]))(np.flatnonzero(np.r_[True, first[1:] != first[:-1], True]) if len(codes) else [])):
        x = first[low]
        mark[ids[begin[x] : begin[x] + size[x]]] = 1
        for at in range(low, high, 4096):
            y = other[at : min(high, at + 4096)]
            ends = np.cumsum(size[y])
            shared = np.add.reduceat(mark[ids[np.arange(ends[-1]) + np.repeat(begin[y] - np.r_[0, ends[:-1]], size[y])]], np.r_[0, ends[:-1]])
            links += [(int(doc[x]), int(doc[k])) for k in y[shared >= gap[x] + gap[y] - SLACK]]
        mark[ids[begin[x] : begin[x] + size[x]]] = 0
    return pd.DataFrame([(min(p), max(p)) for p in links], columns=["a", "b"])


def cross_links(apart: DataFrame, anchors: DataFrame) -> DataFrame:
    """(a, b): the links across classes of a group, besides those with the anchor.

    apart: differences with labels; a member whose pair with the anchor was found alike must have the anchor's label.
    """
    named = apart.join(anchors.hint("merge"), "grp")
    size = F.octet_length("delta") / 4
    # of each group: the anchor's label, the smallest gap outside its class, and the parts it is looked up in
    tops = named.groupBy("grp").agg(F.max(F.when(F.col("doc") == F.col("anchor"), F.col("label"))).alias("top"))
    named = named.join(tops.hint("merge"), "grp").withColumn("main", F.col("label") == F.col("top"))
    outside = named.groupBy("grp").agg(F.min(F.when(~F.col("main"), F.col("gap"))).alias("outer"), F.ceil(F.sum(size) / PART).cast("int").alias("parts"))
    named = named.join(outside.hint("merge"), "grp")

    def prefix(bound: str) -> Column:
        return F.greatest(F.lit(0.0), size - F.greatest(F.ceil(F.col("gap") + F.col(bound) - SLACK), F.lit(1)) + 1).cast("int")

    near = prefix("outer")
    rows = named.select("grp", "doc", "label", "main", F.greatest("parts", F.lit(1)).alias("parts"), F.when(F.col("main"), near).otherwise(prefix("least")).alias("far"), near.alias("near"), "gap", "delta")
    parted = rows.mapInArrow(_parted, PARTED)
    return parted.groupBy("grp", "part").applyInPandas(_meeting, "a long, b long").distinct()
