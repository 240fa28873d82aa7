"""Sharding by a k-d tree over text metadata.

A node is split along its widest dimension (its range as a share of the whole table's) at the weighted median of
its rows' sizes, until its leaves reach the target bytes. The median is found over all rows by
histograms: each round counts bytes per bucket of the node's range, and goes on inside the bucket that holds the
median, down to single values. Rows of equal text have the same place in every dimension and in the tie-break
(a hash of the text), so they stay together, unless they weigh over `group_share` of a shard: such a group is
split by a hash of doc_id. The driver sees one histogram a round, of at most MOST_BUCKETS rows for all nodes.

Edge cases: a null text has no bytes, and size 1. A null doc_id is placed like any other. Repeated rows
are placed one by one. An empty table gives an empty table. Fewer rows than shards leave shards empty. Extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewave.llm.common import crc32_of, n_partitions, stored

MOST_BUCKETS = 32_768
MOST_SHARDS = 100_000
HALF = (1 << 31) - 1


def metadata(text: Column) -> dict[str, Column]:
    """Dimensions of a text, as integers under 2**31. Equal texts agree in all."""
    size, chars = F.octet_length(text), F.length(text)
    lines = F.length(text) - F.length(F.translate(text, "\n", ""))
    return {"d0": size, "d1": lines, "d2": F.when(size > 0, (size - chars) * 1000 / F.greatest(size, F.lit(1))).otherwise(0)}


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, k0.. (place in each dimension, ties by text hash), tie (hash of doc_id)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    dims = metadata(text)
    tie = F.xxhash64(text).bitwiseAND(F.lit(HALF))
    keys = [(F.shiftleft(F.least(v.cast("long"), F.lit(HALF)), 31) + tie).alias(f"k{i}") for i, v in enumerate(dims.values())]
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), crc32_of(text).alias("text_crc32"), *keys, F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 2).alias("tie"))


class _Search:
    """A node's search for its weighted median: first over the places in a dimension, then over ties."""

    def __init__(self, node: int, leaves: int, dim: int, low: int, high: int, weight: int):
        self.node, self.leaves, self.dim, self.low, self.high = node, leaves, dim, low, high
        self.goal = weight * ((leaves + 1) // 2) / leaves
        self.place: int | None = None  # set while ties of one place are searched
        self.cut: tuple[int, int] | None = None

    def step(self, buckets: int) -> int:
        return max(1, -(-(self.high - self.low + 1) // buckets))

    def narrow(self, weights: dict[int, int], step: int, group_limit: float, exact: float) -> None:
        """weights: bytes by bucket of the present range."""
        done = 0
        for b in sorted(weights):
            if done + weights[b] < self.goal:
                done += weights[b]
                continue
            low = self.low + b * step
            single = step == 1
            if weights[b] <= exact or (single and (self.place is not None or weights[b] <= group_limit)):
                after = done + weights[b] - self.goal < self.goal - done
                self.settle(low + step if after else low)
            elif single:
                self.place, self.low, self.high, self.goal = low, 0, (1 << 62) - 1, self.goal - done
            else:
                self.low, self.high, self.goal = low, min(self.high, low + step - 1), self.goal - done
            return
        self.settle(self.high + 1)

    def settle(self, value: int) -> None:
        self.cut = (value, 0) if self.place is None else (self.place, value)


def assign_shards(rows: DataFrame, shards: int, group_share: float = 0.01, dims: int = 3) -> DataFrame:
    """rows of sized() with shard: 0 to shards - 1, of nearly equal bytes."""
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"shards must be from 1 to {MOST_SHARDS}")
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    target = total / shards
    keys = [f"k{i}" for i in range(dims)]
    placed = rows.withColumn("node", F.lit(1))
    leaves = {1: shards}
    spans: list[float] | None = None
    while any(n > 1 for n in leaves.values()):
        ranges = [f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max)]
        stats = {r.node: r for r in placed.groupBy("node").agg(F.sum("size").alias("weight"), *ranges).collect()}  # a row a node
        if spans is None:
            spans = [max(1, (stats[1][f"max_{k}"] >> 31) - (stats[1][f"min_{k}"] >> 31)) if 1 in stats else 1 for k in keys]
        searches = []
        for node, n in leaves.items():
            if n > 1 and node in stats:
                r = stats[node]
                widths = [((r[f"max_{k}"] >> 31) - (r[f"min_{k}"] >> 31)) / s for k, s in zip(keys, spans)]
                d = widths.index(max(widths))
                searches.append(_Search(node, n, d, r[f"min_k{d}"], r[f"max_k{d}"], r.weight))
        open_ = list(searches)
        while open_:
            wave = open_[: MOST_BUCKETS // 16]
            buckets = min(4096, MOST_BUCKETS // len(wave))
            table = [(s.node, s.dim, s.place, s.low, s.high, s.step(buckets)) for s in wave]
            at = spark.createDataFrame(table, "node int, dim int, place long, low long, high long, step long")
            value = F.element_at(F.array(*keys), F.col("dim") + 1)
            near = placed.join(F.broadcast(at), "node").where(F.col("place").isNull() | (value == F.col("place")))  # a row a node
            near = near.withColumn("v", F.when(F.col("place").isNull(), value).otherwise(F.col("tie"))).where("v between low and high")
            counts = near.groupBy("node", F.expr("(v - low) div step").alias("b")).agg(F.sum("size").alias("w")).collect()
            by: dict[int, dict[int, int]] = {}
            for r in counts:
                by.setdefault(r.node, {})[r.b] = r.w
            for s in wave:
                s.narrow(by.get(s.node, {}), s.step(buckets), group_share * target, target / 1000)
            open_ = [s for s in open_ if s.cut is None]
        cuts = [(s.node, s.dim, *s.cut) for s in searches] or [(0, 0, 0, 0)]
        at = spark.createDataFrame(cuts, "node int, dim int, c1 long, c2 long")
        value = F.element_at(F.array(*keys), F.col("dim") + 1)
        right = (value > F.col("c1")) | ((value == F.col("c1")) & (F.col("tie") >= F.col("c2")))
        # nodes of one leaf go down leftwards, so that all leaves end at the same depth
        placed = placed.join(F.broadcast(at), "node", "left").withColumn("node", (F.col("node") * 2 + F.coalesce(right.cast("int"), F.lit(0))).cast("int")).drop("dim", "c1", "c2")
        leaves = {c: m for n, k in leaves.items() for c, m in ((2 * n, (k + 1) // 2), (2 * n + 1, k // 2)) if m}
    order = {node: i for i, node in enumerate(sorted(leaves))}
    names = spark.createDataFrame(list(order.items()), "node int, shard int")
    return placed.join(F.broadcast(names), "node").drop("node")


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with slot: gapless from 0 within each value of `by`. Range partitions are sorted, and their counts added up; no value of `by` meets in one task."""
    dealt = rows.repartitionByRange(n_partitions(rows.sparkSession), by, *order).sortWithinPartitions(by, *order)
    held = stored(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "numbered")
    # a row for each partition and each value that it holds: partitions plus values at most
    counts = held.groupBy(by, "part").agg(F.count("*").alias("n"), F.min("nth").alias("first")).collect()
    offsets, seen = [], {}
    for r in sorted(counts, key=lambda r: (r[by], r.part)):
        offsets.append((r[by], r.part, seen.get(r[by], 0) - r["first"]))
        seen[r[by]] = seen.get(r[by], 0) + r.n
    at = rows.sparkSession.createDataFrame(offsets, f"{by} int, part int, shift long")
    return held.join(F.broadcast(at), [by, "part"]).withColumn("slot", F.col("nth") + F.col("shift")).drop("part", "nth", "shift")


def kd_shards(docs: DataFrame, shards: int = 8, target_bytes: int | None = None, group_share: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard. target_bytes: leaves of about this size instead of `shards` leaves."""
    rows = stored(sized(docs, id_col, text_col), "sized")
    if target_bytes:
        total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        shards = max(1, math.ceil(total / target_bytes))
    out = numbered(assign_shards(rows, shards, group_share), "shard", ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
