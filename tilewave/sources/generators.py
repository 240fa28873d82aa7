"""Synthetic pictures and signals, from row numbers and expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewave.functions.exprs import let


def pictures(spark: SparkSession, kind: str, size: int = 64, frames: int = 1) -> DataFrame:
    """picture, x, y, r, g, b. kind: gradient, sinusoid or flat."""
    at = spark.range(0, frames * size * size).selectExpr(f"id div {size * size} picture", f"id % {size} x", f"(id div {size}) % {size} y")
    wave = "cast(floor(255 * (0.5D * {w} + 0.5D)) as bigint)"
    channels = {
        "gradient": ["(4 * (x + picture)) & 255", "(4 * y) & 255", "(2 * (x + y + picture)) & 255"],
        "sinusoid": [wave.format(w="sin(0.2D * x)"), wave.format(w="cos(0.15D * y)"), wave.format(w="sin(0.1D * (x + y))")],
        "flat": ["128L", "64L", "200L"],
    }[kind]
    return at.selectExpr("picture", "x", "y", *[f"{e} {c}" for e, c in zip(channels, "rgb")])


def noise(spark: SparkSession, seeds: int, length: int, seed: int = 12345) -> DataFrame:
    """id, v: bytes of a linear congruential sequence; each row's sequence is a fold over its places."""
    step = f"aggregate(sequence(1, {length}), named_struct('s', {seed}L + id, 'v', cast(array() as array<bigint>)), (a, i) -> {let('(a.s * 1664525 + 1013904223) % 4294967296', 'n', 'named_struct(\"s\", n, \"v\", concat(a.v, array(n & 255)))')}).v"
    return spark.range(0, seeds).selectExpr("id", f"{step} v")


def sine(spark: SparkSession, samples: int, frequency: float = 440.0, rate: int = 44_100, amplitude: float = 0.5) -> DataFrame:
    return spark.range(0, samples).selectExpr("id n", f"{amplitude}D * sin(2 * pi() * {frequency}D * id / {rate}D) v")


def chirp(spark: SparkSession, samples: int, low: float = 200.0, high: float = 2200.0, rate: int = 44_100, amplitude: float = 0.3) -> DataFrame:
    return spark.range(0, samples).selectExpr("id n", f"{amplitude}D * sin(2 * pi() * ({low}D + ({high}D - {low}D) * id / {samples}D) * id / {rate}D) v")
