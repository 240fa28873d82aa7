"""Queries on sampled signals: channels, frames, lapped transforms, audio quantization, resampling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewave.functions import tables
from tilewave.operators import audio_coder, views
from tilewave.plans import duck
from tilewave.plans.registry import query

HOP, SIZE = 512, 1024
_PCM = f"WITH {duck.PCM}"
_STEREO = f"{_PCM}, st AS (SELECT n // 2 AS i, max(iv) FILTER (n % 2 = 0) AS l, max(iv) FILTER (n % 2 = 1) AS r FROM pcm GROUP BY 1 HAVING count(*) = 2)"


def stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pcm(spark, sf_dir).groupBy(F.expr("n div 2 i")).agg(F.expr("max(iv) filter (where n % 2 = 0) l"), F.expr("max(iv) filter (where n % 2 = 1) r"), F.count("*").alias("c")).where("c = 2").drop("c")


@query(f"{_STEREO} SELECT i, (l + r) / 2.0 AS mid, (l - r) / 2.0 AS side, ((l + r) / 2.0 + (l - r) / 2.0 = l AND (l + r) / 2.0 - (l - r) / 2.0 = r) AS whole FROM st")
def mid_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stereo(spark, sf_dir).selectExpr("i", "l", "r", "(l + r) / 2D mid", "(l - r) / 2D side")
    return rows.selectExpr("i", "mid", "side", "mid + side = l and mid - side = r whole")


@query(f"{_STEREO} SELECT i * 2 AS n, 0 AS channel, l AS v FROM st UNION ALL SELECT i * 2 + 1, 1, r FROM st")
def interleave_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stereo(spark, sf_dir).selectExpr("i", "posexplode(array(l, r)) as (c, v)")
    return rows.selectExpr("i * 2 + c n", "cast(c as bigint) channel", "v")


@query(f"{_PCM}, q AS (SELECT n // {HOP} AS frame, iv, {duck.rdiv('iv', '50')} * 50 AS rec FROM pcm) SELECT frame, sum(iv * iv)::BIGINT AS signal, sum((iv - rec) * (iv - rec))::BIGINT AS noise, CASE WHEN sum((iv - rec) * (iv - rec)) = 0 THEN 100.0 ELSE round(10 * log10(sum(iv * iv)::DOUBLE / sum((iv - rec) * (iv - rec))::DOUBLE), 4) END AS snr FROM q GROUP BY frame")
def snr_by_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pcm(spark, sf_dir).selectExpr(f"n div {HOP} frame", "iv", "(iv + 25) div 50 * 50 rec")
    sums = rows.groupBy("frame").agg(F.expr("sum(iv * iv) signal"), F.expr("sum((iv - rec) * (iv - rec)) noise"))
    return sums.selectExpr("frame", "signal", "noise", "case when noise = 0 then 100D else round(10 * log10(cast(signal as double) / cast(noise as double)), 4) end snr")


@query(f"WITH {duck.PKT} SELECT stream_id, count(*)::BIGINT AS frames, sum(size)::BIGINT AS bytes, round(sum(size) * 8 / 1000.0 / (count(*) / 30.0), 4) AS kbps, round(sum(size) * 8.0 / (count(*) * 4096.0), 6) AS bpp, round(count(*) * 4096.0 * 3 / sum(size), 4) AS ratio FROM pkt GROUP BY stream_id")
def bitrate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = views.packets(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("frames"), F.sum("size").alias("bytes"))
    return sums.selectExpr("stream_id", "frames", "bytes", "round(bytes * 8 / 1000D / (frames / 30D), 4) kbps", "round(bytes * 8D / (frames * 4096D), 6) bpp", "round(frames * 4096D * 3 / bytes, 4) ratio")


# ---- deltas -------------------------------------------------------------------------------------------------


@query(f"WITH {duck.PIX}, dc AS (SELECT f, y // 8 AS r, x // 8 AS c, sum(p)::BIGINT AS dc FROM pix GROUP BY ALL) SELECT f, r, c, dc - coalesce(CASE WHEN c > 0 THEN lag(dc) OVER (PARTITION BY f, r ORDER BY c) ELSE lag(dc) OVER (PARTITION BY f, c ORDER BY r) END, 0) AS delta FROM dc")
def dc_delta_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pictures(spark, sf_dir)
    tile = "transform(sequence(0, 63), q -> struct(q div 8 r, q % 8 c, aggregate(sequence(0, 63), 0L, (a, i) -> a + z[int(((q div 8) * 8 + i div 8) * 64 + (q % 8) * 8 + i % 8)]) dc))"
    rows = rows.selectExpr("f", f"transform(array(pic), z -> {tile})[0] t")
    before = "case when b.c > 0 then t[i - 1].dc when b.r > 0 then t[i - 8].dc else 0L end"
    return rows.selectExpr("f", f"inline(transform(t, (b, i) -> struct(cast(b.r as bigint) r, cast(b.c as bigint) c, b.dc - {before} delta)))")


@query(f"{_PCM}, f AS (SELECT n % 2 AS ch, n // {HOP} AS frame, sum(iv)::BIGINT AS c0 FROM pcm GROUP BY ALL) SELECT ch, frame, c0 - lag(c0, 1, 0) OVER (PARTITION BY ch ORDER BY frame) AS delta FROM f")
def dc_delta_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame before is found by an equi-join, so that no channel is a single window partition."""
    f = views.pcm(spark, sf_dir).groupBy(F.expr("n % 2 ch"), F.expr(f"n div {HOP} frame")).agg(F.sum("iv").alias("c0"))
    return f.join(f.selectExpr("ch", "frame + 1 frame", "c0 before"), ["ch", "frame"], "left").selectExpr("ch", "frame", "c0 - coalesce(before, 0L) delta")


@query(f"WITH {duck.PIX}, b AS (SELECT DISTINCT f, m, (f + m) % 5 = 0 AS copy, 8 + (f * 3 + m * 7) % 11 AS q FROM pix) SELECT f, m, q - lag(q, 1, 0) OVER (PARTITION BY f ORDER BY m) AS delta FROM b WHERE NOT copy")
def qp_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference to the block before that isn't a copy; a picture's blocks are one window of at most 16 rows."""
    blocks = views.pictures(spark, sf_dir).selectExpr("f", "explode(sequence(0L, 15L)) m").where("(f + m) % 5 != 0").selectExpr("f", "m", "8 + (f * 3 + m * 7) % 11 q")
    return blocks.select("f", "m", (F.col("q") - F.lag("q", 1, 0).over(Window.partitionBy("f").orderBy("m"))).alias("delta"))


# ---- resampling ---------------------------------------------------------------------------------------------


@query(f"""{_PCM}, c AS (SELECT n // 1000 AS chunk, row_number() OVER (PARTITION BY n // 1000 ORDER BY n) - 1 AS i, iv FROM pcm), k AS (SELECT chunk, count(*) AS size FROM c GROUP BY chunk),
o AS (SELECT chunk, size, j, j * 4 // 3 AS a, j * 4 % 3 AS part FROM k, LATERAL (SELECT unnest(range(0, (3 * size + 3) // 4)) AS j))
SELECT o.chunk, j AS n, round(x.iv + (y.iv - x.iv) * part / 3.0, 4) AS v FROM o JOIN c x ON x.chunk = o.chunk AND x.i = a JOIN c y ON y.chunk = o.chunk AND y.i = least(a + 1, size - 1)""")
def linear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4:3 by linear interpolation, in chunks of 1000 samples or what there is of them; the last sample stands in beyond a chunk."""
    chunks = views.pcm(spark, sf_dir).groupBy(F.expr("n div 1000 chunk")).agg(F.sort_array(F.collect_list(F.struct("n", "iv"))).alias("s"))
    value = "transform(sequence(0, (3 * size(z) + 3) div 4 - 1), j -> struct(cast(j as bigint) n, round(z[int(j * 4 div 3)].iv + (z[int(least(j * 4 div 3 + 1, size(z) - 1))].iv - z[int(j * 4 div 3)].iv) * (j * 4 % 3) / 3D, 4) v))"
    return chunks.selectExpr("chunk", f"inline(transform(array(s), z -> {value})[0])")


# ---- lapped transform ---------------------------------------------------------------------------------------


@query(f"""{_PCM}, w AS (SELECT i, sin(pi() * (i + 0.5) / {SIZE}) AS w, pow(sin(pi() * (i + 0.5) / {SIZE}), 2) + pow(sin(pi() * (i + {HOP} + 0.5) / {SIZE}), 2) AS power FROM range(0, {HOP}) t(i))
SELECT i, round(any_value(w), 6) AS w, round(any_value(power), 6) AS power, round(sum(iv * w), 4) AS windowed FROM pcm JOIN w ON n % {HOP} = i GROUP BY i""")
def sine_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window's first half, what it adds up to with the second, and the signal's sums under it."""
    sums = views.pcm(spark, sf_dir).groupBy(F.expr(f"n % {HOP} i")).agg(F.sum("iv").alias("t"))
    w = f"sin(pi() * (i + 0.5D) / {SIZE})"
    return sums.selectExpr("i", f"round({w}, 6) w", f"round(pow({w}, 2) + pow(sin(pi() * (i + {HOP} + 0.5D) / {SIZE}), 2), 6) power", f"round(t * {w}, 4) windowed")


@query(f"{_PCM}, h AS (SELECT n // {HOP} AS frame, n % {HOP} + {HOP} AS i, iv FROM pcm UNION ALL SELECT n // {HOP} + 1, n % {HOP}, iv FROM pcm) SELECT frame, count(*)::BIGINT AS n, sum(iv * (i + 1))::BIGINT AS checksum FROM h GROUP BY frame")
def hop_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hops(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("n"), F.expr("sum(iv * (i + 1)) checksum"))


def _hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample in the second half of its own frame and the first half of the next."""
    return views.pcm(spark, sf_dir).selectExpr("v", "iv", f"inline(array(struct(n div {HOP} frame, n % {HOP} + {HOP} i), struct(n div {HOP} + 1 frame, n % {HOP} i)))")


#: Hops of a group, as a power of two. A group also gets two hops before its own and one after: what the frames around need.
SPAN_BITS = 7
SPAN = 1 << SPAN_BITS


def _spans(spark: SparkSession, sf_dir: str, make: Callable[[int, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """What make(lo, x, there, n) gives for each span of the signal. x: 1024 samples of each frame from lo on, which are the last one of the
    span before, the span's own and the first one of the next; zeros where there is no sample, and `there` tells frames that have one.
    n: the places of the samples."""

    def run(key: tuple[pa.Scalar], part: pa.Table) -> pa.Table:
        lo, n, v = (key[0].as_py() << SPAN_BITS) - 1, part["n"].to_numpy(), part["v"].to_numpy()
        frame, i = _place(n)
        frame = np.r_[frame, frame + 1] - lo
        i = np.r_[i + HOP, i]
        own = (frame >= 0) & (frame < SPAN + 2) & (i >= 0)
        at = frame[own] * SIZE + i[own]
        x = np.bincount(at, np.r_[v, v][own], (SPAN + 2) * SIZE).reshape(SPAN + 2, SIZE)
        return make(lo, x, np.bincount(frame[own], minlength=SPAN + 2) > 0, n)

    samples = views.pcm(spark, sf_dir).where("n is not null").selectExpr("n", "coalesce(v, 0D) v", f"n div {HOP} h")
    dealt = samples.selectExpr(f"explode(array_distinct(transform(array(-1, 0, 2), d -> shiftright(h + d, {SPAN_BITS})))) span", "n", "v")
    return dealt.groupBy("span").applyInArrow(run, schema)


def _place(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hop and place in it, truncating."""
    hop = np.sign(n) * (np.abs(n) // HOP)
    return hop, n - hop * HOP


def _lists(y: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))


def _transformed(spark: SparkSession, sf_dir: str, matrix: np.ndarray) -> DataFrame:
    """frame, y: the samples of each frame times a matrix."""

    def make(lo: int, x: np.ndarray, there: np.ndarray, n: np.ndarray) -> pa.Table:
        own = np.flatnonzero(there[1:-1]) + 1
        return pa.table({"frame": lo + own, "y": _lists(x[own] @ matrix)})

    return _spans(spark, sf_dir, make, "frame long, y array<double>")


_MDCT = f"""{_PCM}, h AS (SELECT n // {HOP} AS frame, n % {HOP} + {HOP} AS i, v FROM pcm UNION ALL SELECT n // {HOP} + 1, n % {HOP}, v FROM pcm),
b AS (SELECT i, k, sin(pi() * (i + 0.5) / {SIZE}) * cos(pi() / {SIZE} * (i + 0.5 + {HOP // 2}) * (2 * k + 1)) AS w FROM range(0, {SIZE}) x(i), range(0, {HOP}) y(k)),
mdct AS (SELECT frame, k, sum(v * w) AS coef FROM h JOIN b USING (i) GROUP BY ALL)"""
_FORWARD = audio_coder.WINDOW[:, None] * audio_coder.BASIS


@query(f"{_MDCT} SELECT frame, k, round(coef, 4) + 0.0 AS coef FROM mdct WHERE k < 16")
def mdct_low_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first coefficients of each frame."""
    return _transformed(spark, sf_dir, _FORWARD[:, :16]).selectExpr("frame", "posexplode(y) as (k, c)").selectExpr("frame", "cast(k as bigint) k", "round(c, 4) + 0D coef")


@query(f"{_MDCT} SELECT frame, k, round(coef, 4) + 0.0 AS coef FROM mdct")
def mdct_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All coefficients of each frame."""
    return _transformed(spark, sf_dir, _FORWARD).selectExpr("frame", "posexplode(y) as (k, c)").selectExpr("frame", "cast(k as bigint) k", "round(c, 4) + 0D coef")


@query(f"""{_PCM}, f AS (SELECT n // {HOP} AS h, n % {HOP} AS i, v, sin(pi() * (n % {HOP} + {HOP} + 0.5) / {SIZE}) AS a, sin(pi() * (n % {HOP} + 0.5) / {SIZE}) AS b FROM pcm)
SELECT h AS hop, max(round(abs(v * a * a + v * b * b - v), 9)) AS worst FROM f GROUP BY h""")
def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed twice and added over the two frames that hold it, each sample comes back."""
    w = f"sin(pi() * (i + 0.5D) / {SIZE})"
    parts = _hops(spark, sf_dir).withColumn("n", F.expr(f"(frame - 1) * {HOP} + i")).selectExpr("n", "v", f"v * {w} * {w} part")
    whole = parts.groupBy("n").agg(F.sum("part").alias("rec"), F.first("v").alias("v"))
    return whole.groupBy(F.expr(f"n div {HOP} hop")).agg(F.expr("max(round(abs(rec - v), 9)) worst"))


# ---- quantization -------------------------------------------------------------------------------------------


_BARK = f"edges AS (SELECT unnest([{', '.join(map(str, tables.BARK_EDGES_HZ))}]) AS hz, generate_subscripts([{', '.join(map(str, tables.BARK_EDGES_HZ))}], 1) - 1 AS b)"


@query(f"""{_MDCT}, {_BARK}, w AS (SELECT unnest([44100, 48000]) AS rate), x AS (SELECT rate, l.b, floor(least(l.hz, rate / 2.0) / (rate / 2.0 / 512))::BIGINT AS first, floor(least(h.hz, rate / 2.0) / (rate / 2.0 / 512))::BIGINT AS last FROM edges l JOIN edges h ON h.b = l.b + 1, w),
y AS (SELECT rate, b AS band, least(first, 511) AS first, CASE WHEN b = 24 THEN 512 ELSE least(greatest(last, least(first, 511) + 1), 512) END AS last, round(1 + pow(b / 24.0, 2), 6) AS weight FROM x)
SELECT rate, band, first, last, weight, round(sum(coef * coef), 2) AS energy FROM y JOIN mdct ON k >= first AND k < last GROUP BY ALL""")
def bark_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical bands as ranges of coefficients at two rates, their weights, and the signal's energy in them."""
    rows = [(rate, b, first, end, round(1 + (b / 24) ** 2, 6)) for rate in (44_100, 48_000) for b, first, end in tables.bark_bands(rate)]
    bands = spark.createDataFrame(rows, "rate long, band long, first long, last long, weight double")

    def make(lo: int, x: np.ndarray, there: np.ndarray, n: np.ndarray) -> pa.Table:
        return pa.table({"y": _lists(((x[1:-1] @ _FORWARD) ** 2).sum(0)[None])})

    energy = _spans(spark, sf_dir, make, "y array<double>").selectExpr("posexplode(y) as (k, e)").groupBy("k").agg(F.sum("e").alias("e"))
    placed = bands.withColumn("k", F.explode(F.expr("sequence(first, last - 1)"))).join(energy, "k")  # 512 coefficients a rate
    return placed.groupBy("rate", "band", "first", "last", "weight").agg(F.expr("round(sum(e), 2) energy"))


QUALITY, RATE = 8, 44_100
_LEVELS = f"""{_MDCT}, {_BARK},
band AS (SELECT l.b, least(floor(least(l.hz, {RATE} / 2.0) / ({RATE} / 2.0 / 512))::BIGINT, 511) AS first, floor(least(h.hz, {RATE} / 2.0) / ({RATE} / 2.0 / 512))::BIGINT AS last FROM edges l JOIN edges h ON h.b = l.b + 1),
step AS (SELECT k, 0.02 * pow(2, {QUALITY} / 3.0) * (1 + pow(arg_max(b, b) / 24.0, 2)) AS step FROM band, range(0, {HOP}) t(k) WHERE k >= first AND (k < CASE WHEN b = 24 THEN 512 ELSE least(greatest(last, first + 1), 512) END) GROUP BY k),
lv AS (SELECT frame, k, least(greatest(sign(coef) * floor(abs(coef / step) + 0.5), -32768), 32767)::BIGINT AS level, step FROM mdct JOIN step USING (k))"""


def _rounded(x: np.ndarray) -> np.ndarray:
    y = x @ _FORWARD / audio_coder.steps(QUALITY, RATE)
    return np.clip(np.sign(y) * np.floor(np.abs(y) + 0.5), -32768, 32767).astype(np.int64)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, y, before: the levels of each frame, and the first one of the frame before, 0 if there is none."""

    def make(lo: int, x: np.ndarray, there: np.ndarray, n: np.ndarray) -> pa.Table:
        own, levels = np.flatnonzero(there[1:-1]) + 1, _rounded(x)
        return pa.table({"frame": lo + own, "y": _lists(levels[own]), "before": levels[own - 1, 0]})

    return _spans(spark, sf_dir, make, "frame long, y array<long>, before long")


@query(f"{_LEVELS} SELECT frame, k, level FROM lv")
def audio_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All coefficients of each frame, divided by the step and their band's weight, rounded and clamped to 16 bits."""
    return _levels(spark, sf_dir).selectExpr("frame", "posexplode(y) as (k, level)").selectExpr("frame", "cast(k as bigint) k", "level")


@query(f"""{_LEVELS}, inv AS (SELECT frame, i, sum(level * step * w) * {4 / SIZE} AS y FROM lv JOIN b USING (k) GROUP BY ALL),
o AS (SELECT (frame - 1) * {HOP} + i AS n, sum(y) AS rec FROM inv GROUP BY 1)
SELECT n, round(rec, 6) + 0.0 AS rec FROM o JOIN pcm USING (n)""")
def mdct_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels times their steps, transformed back, windowed, and added over the two frames that hold a sample."""
    inverse = audio_coder.steps(QUALITY, RATE)[:, None] * _FORWARD.T * (4 / SIZE)

    def make(lo: int, x: np.ndarray, there: np.ndarray, n: np.ndarray) -> pa.Table:
        part = _rounded(x) @ inverse
        hop, i = _place(n)
        own = (hop > lo) & (hop <= lo + SPAN)
        hop, i = hop[own] - lo, i[own]
        return pa.table({"n": n[own], "rec": part[hop, i + HOP] + np.where(i < 0, 0, part[hop + 1, np.maximum(i, 0)])})

    return _spans(spark, sf_dir, make, "n long, rec double").selectExpr("n", "round(rec, 6) + 0D rec")


@query(f"{_PCM}, k AS (SELECT n // {HOP} AS frame, n % {HOP} AS k, iv FROM pcm) SELECT frame, CASE WHEN k <= 8 THEN 0 WHEN k <= 24 THEN 1 WHEN k <= 56 THEN 2 WHEN k <= 112 THEN 3 WHEN k <= 192 THEN 4 WHEN k <= 320 THEN 5 ELSE 6 END AS band, sum(iv * iv)::BIGINT AS energy, count(*)::BIGINT AS n FROM k GROUP BY ALL")
def band_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pcm(spark, sf_dir).selectExpr(f"n div {HOP} frame", f"n % {HOP} k", "iv")
    return rows.groupBy("frame", F.expr(f"cast({_band('k')} as bigint) band")).agg(F.expr("sum(iv * iv) energy"), F.count("*").alias("n"))


def _band(k: str) -> str:
    return "case " + " ".join(f"when {k} <= {end} then {b}" for b, end in enumerate(tables.COEFFICIENT_BAND_ENDS)) + " else 6 end"


@query(f"{_LEVELS} SELECT k, CASE WHEN k <= 8 THEN 0 WHEN k <= 24 THEN 1 WHEN k <= 56 THEN 2 WHEN k <= 112 THEN 3 WHEN k <= 192 THEN 4 WHEN k <= 320 THEN 5 ELSE 6 END::BIGINT AS band, CASE WHEN k = 0 THEN 0 WHEN k <= 10 THEN 1 WHEN k <= 40 THEN 2 ELSE 3 END::BIGINT AS grp, sum(abs(level))::BIGINT AS size, count(*) FILTER (level <> 0)::BIGINT AS n FROM lv GROUP BY k")
def coefficient_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entropy band and the group of each coefficient place, and the levels that stand there."""
    rows = _levels(spark, sf_dir).selectExpr("posexplode(y) as (k, level)").groupBy(F.col("k").cast("long").alias("k")).agg(F.expr("sum(abs(level)) size"), F.expr("count_if(level != 0) n"))
    return rows.selectExpr("k", f"cast({_band('k')} as bigint) band", "cast(case when k = 0 then 0 when k <= 10 then 1 when k <= 40 then 2 else 3 end as bigint) grp", "size", "n")


@query(f"{_PCM}, e AS (SELECT n // {HOP} AS frame, max(iv) FILTER (n % {HOP} = 0) AS first, max(iv) FILTER (n % {HOP} = {HOP - 1}) AS last FROM pcm GROUP BY 1) SELECT frame, abs(first - lag(last) OVER (ORDER BY frame)) AS jump FROM e QUALIFY jump IS NOT NULL")
def boundary_smoothness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.pcm(spark, sf_dir).groupBy(F.expr(f"n div {HOP} frame")).agg(F.expr(f"max(iv) filter (where n % {HOP} = 0) first"), F.expr(f"max(iv) filter (where n % {HOP} = {HOP - 1}) last"))
    return e.join(e.selectExpr("frame + 1 frame", "last before"), "frame").selectExpr("frame", "abs(first - before) jump").where("jump is not null")
