"""Base views: blocks, pictures, signals, symbols and packets from the tables.

Array form throughout: one row per block, picture or sequence, so that what is local to it needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, s: 64 integers per 8x8 block."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "cast(label as bigint) label", "transform(embedding, e -> cast(floor(cast(e as double) * 1024 + 0.5) as bigint)) s")


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = "transform(embedding, e -> least(greatest(128 + cast(floor(cast(e as double) * 256 + 0.5) as bigint), 0L), 255L)) p"
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id div 64 f", "vec_id % 64 b", value)


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, pic: full 64x64 pictures, 4096 pixels by rows. A picture has 64 blocks, so its group is bounded."""
    whole = _pixels(spark, sf_dir).groupBy("f").agg(F.sort_array(F.collect_list(F.struct("b", "p"))).alias("blocks")).where("size(blocks) = 64")
    block = "((i div 64) div 16 * 4 + (i % 64) div 16) * 4 + ((i div 64) % 16) div 8 * 2 + ((i % 64) % 16) div 8"
    return whole.selectExpr("f", f"transform(sequence(0, 4095), i -> blocks[int({block})].p[((i div 64) % 8) * 8 + i % 8]) pic")


def macroblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, m, mx, my, y: 16x16 blocks of full pictures."""
    cell = "int(((i div 16) + my * 16) * 64 + i % 16 + mx * 16)"
    tiles = pictures(spark, sf_dir).selectExpr("f", "pic", "explode(sequence(0, 15)) m").selectExpr("f", "pic", "cast(m as bigint) m", "cast(m % 4 as bigint) mx", "m div 4 my")
    return tiles.selectExpr("f", "m", "mx", "my", f"transform(sequence(0, 255), i -> pic[{cell}]) y")


def rgb_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, r, g_, b: three 64-pixel planes of an 8x8 tile; the incomplete last group is left out."""
    value = "transform(embedding, e -> least(greatest(128 + cast(floor(cast(e as double) * 256 + 0.5) as bigint), 0L), 255L)) p"
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id div 3 g", "vec_id % 3 c", value)
    return rows.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("c", "p"))).alias("t")).where("size(t) = 3").selectExpr("g", "get(t, 0).p r", "get(t, 1).p gr", "get(t, 2).p b")


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, v, iv: a sampled signal."""
    return table(spark, sf_dir, "events").selectExpr("event_id n", "value / 500 v", "cast(floor(value * 100 + 0.5) as bigint) iv")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, v, zero: one row per order: quantities in order, and whether each line's discount is zero. An order has few lines."""
    lines = table(spark, sf_dir, "lineitem")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.expr("cast(l_quantity as bigint) v"), F.expr("l_discount = 0 zero"))
    return lines.groupBy(F.col("l_orderkey").alias("seq")).agg(F.sort_array(F.collect_list(row)).alias("rows")).selectExpr("seq", "transform(rows, r -> r.v) v", "transform(rows, r -> r.zero) zero")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, seq, ts, ts_us, size: events as packets of two streams."""
    return table(spark, sf_dir, "events").selectExpr(
        "cast(case when event_type in ('view', 'click') then 0 else 1 end as bigint) stream_id", "event_id seq", "ts", "unix_micros(cast(ts as timestamp)) ts_us", "cast(length(props) as bigint) size", "user_id"
    )
