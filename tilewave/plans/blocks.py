"""Queries on whole blocks of three planes: residual transforms there and back, bits, blends by direction, copies; and figures as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewave.functions import tables
from tilewave.functions.exprs import let, total
from tilewave.operators import quantize, transform, views
from tilewave.plans import duck, extras, pictures, transforms
from tilewave.plans.registry import SQL, query
from tilewave.plans.shared import shared_dir

# A block has four 8x8 of luma, and one of each chroma plane: u is the rounded mean of each four pixels, v what u lacks to 255.

_MEAN = "(sum(p)::BIGINT + 2) >> 2"
_SIX = f"""WITH {duck.PIX}, uv AS (SELECT f, m, y % 16 // 2 AS r, x % 16 // 2 AS c, {_MEAN} AS u FROM pix GROUP BY ALL),
six AS (SELECT f, m, y % 16 // 8 * 2 + x % 16 // 8 AS q, y % 8 AS r, x % 8 AS c, p FROM pix UNION ALL SELECT f, m, 4, r, c, u FROM uv UNION ALL SELECT f, m, 5, r, c, 255 - u FROM uv),
twin AS (SELECT a.f, a.m, a.q, a.r, a.c, a.p AS a, b.p AS b FROM six a JOIN six b ON b.f + 1 = a.f AND b.m = a.m AND b.q = a.q AND b.r = a.r AND b.c = a.c),
tile AS (SELECT (f * 16 + m) * 6 + q AS vec_id, 0 AS label, r, c, a - b AS s FROM twin), {duck.dct8('tile')}"""


def _six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, m, q, a, b: each 8x8 of a block's three planes, and the one at its place in the picture before."""
    rows = views.macroblocks(spark, sf_dir).select("f", "m", "y")
    mean = "shiftright(y[int((i div 8) * 32 + i % 8 * 2)] + y[int((i div 8) * 32 + i % 8 * 2 + 1)] + y[int((i div 8) * 32 + 16 + i % 8 * 2)] + y[int((i div 8) * 32 + 17 + i % 8 * 2)] + 2, 2)"
    rows = rows.selectExpr("f", "m", "y", f"{let('y', 'y', f'transform(sequence(0, 63), i -> {mean})')} u")
    luma = ", ".join(transform.quadrant("y", str(q)) for q in range(4))
    now = rows.selectExpr("f", "m", f"posexplode(array({luma}, u, transform(u, x -> 255 - x))) as (q, a)").selectExpr("f", "m", "cast(q as bigint) q", "a")
    return now.join(now.selectExpr("f + 1 f", "m", "q", "a b"), ["f", "m", "q"])


def subtract_forward(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """The forward transform of a block less its prediction."""
    return transform.forward(df.selectExpr("*", f"zip_with({a}, {b}, (x, y) -> x - y) __tw_d"), "__tw_d", out).drop("__tw_d")


def inverse_add(df: DataFrame, coef: str, b: str, out: str) -> DataFrame:
    """The inverse transform of coefficients, added to a prediction."""
    return transform.inverse(df, coef, "__tw_d").selectExpr("*", f"zip_with(__tw_d, {b}, (x, y) -> x + y) {out}").drop("__tw_d")


@query(f"""{_SIX}, {duck.idct8('dct', 'coef')}, sums AS (SELECT vec_id, sum(coef * (k + 1))::BIGINT AS forward FROM dct GROUP BY vec_id)
SELECT f, m, q, any_value(forward) AS forward, sum((rec + b) * (k + 1))::BIGINT AS back, max(abs(rec + b - a))::BIGINT AS worst
FROM idct JOIN (SELECT *, (f * 16 + m) * 6 + q AS vec_id, r * 8 + c AS k FROM twin) USING (vec_id, k) JOIN sums USING (vec_id) GROUP BY f, m, q""")
def block_subtract_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six 8x8 of each block less those of the picture before, transformed, and the transform's inverse added to them again."""
    rows = inverse_add(subtract_forward(_six(spark, sf_dir), "a", "b", "coef"), "coef", "b", "rec")
    return rows.selectExpr("f", "m", "q", f"{total('transform(coef, (x, k) -> x * (k + 1))')} forward", f"{total('transform(rec, (x, k) -> x * (k + 1))')} back", "array_max(zip_with(rec, a, (x, y) -> abs(x - y))) worst")


_CHROMA_QP = quantize.chroma_qp(transforms.QP)


@query(f"""{_SIX}, {duck.const('qn', tables.INTER_MATRIX)}, {duck.const('dead', tables.INTER_DEADZONE)},
fl AS (SELECT vec_id, k, w.v AS w, CASE WHEN vec_id % 6 < 4 THEN {transforms.QP} ELSE {_CHROMA_QP} END AS qp, {duck.rdiv('coef * 16', 'qn.v')} AS f FROM dct JOIN qn USING (k) JOIN dead w USING (k)),
lv AS (SELECT vec_id, k, ({duck.rdiv('f - ((sign(f) * qp * w)::BIGINT >> 1)', '(2 * qp)')})::BIGINT AS level FROM fl)
SELECT vec_id // 96 AS f, vec_id // 6 % 16 AS m, sum({transforms._bits_sql('level')})::BIGINT AS bits, count(*) FILTER (level <> 0 AND vec_id % 6 < 4)::BIGINT AS luma, count(*) FILTER (level <> 0 AND vec_id % 6 >= 4)::BIGINT AS chroma FROM lv GROUP BY ALL""")
def block_residual_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated bits of a block's residual over its three planes, chroma at a coarser step, and the levels that aren't zero."""
    rows = subtract_forward(_six(spark, sf_dir), "a", "b", "coef")
    rows = rows.selectExpr("f", "m", "q", f"if(q < 4, {quantize.inter('coef', transforms.QP)}, {quantize.inter('coef', _CHROMA_QP)}) level")
    rows = rows.selectExpr("f", "m", "q", f"{total(f'transform(level, v -> {quantize.coefficient_bits('v')})')} bits", "cast(size(filter(level, v -> v != 0)) as bigint) n")
    return rows.groupBy("f", "m").agg(F.sum("bits").alias("bits"), F.expr("sum(if(q < 4, n, 0L)) luma"), F.expr("sum(if(q >= 4, n, 0L)) chroma"))


# ---- blends and copies --------------------------------------------------------------------------------------

_DIRECTIONS = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]


@query(f"""WITH {duck.PIX}, d AS (SELECT unnest(range(0, 8)) AS direction, unnest([{', '.join(str(x) for x, _ in _DIRECTIONS)}]) AS dx, unnest([{', '.join(str(y) for _, y in _DIRECTIONS)}]) AS dy)
SELECT a.f, a.m, direction, sum(((a.p + b.p + 1) // 2) * (a.y % 16 * 16 + a.x % 16 + 1))::BIGINT AS half, sum(((3 * a.p + b.p + 2) // 4) * (a.y % 16 * 16 + a.x % 16 + 1))::BIGINT AS quarter
FROM pix a, d JOIN pix b ON b.f = a.f AND b.x = a.x + dx AND b.y = a.y + dy WHERE a.m % 4 * 16 + dx BETWEEN 0 AND 48 AND a.m // 4 * 16 + dy BETWEEN 0 AND 48 GROUP BY ALL""")
def bilinear_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block blended with the one a sample away in eight directions, by half and by a quarter, where that lies in the picture."""
    sides = ", ".join(f"struct({k}L direction, {x}L dx, {y}L dy)" for k, (x, y) in enumerate(_DIRECTIONS))
    rows = views.pictures(spark, sf_dir).selectExpr("f", "pic", "explode(sequence(0L, 15L)) m").selectExpr("f", "pic", "m", "m % 4 * 16 px", "m div 4 * 16 py", f"explode(array({sides})) d")
    rows = rows.where("px + d.dx between 0 and 48 and py + d.dy between 0 and 48")
    own, other = "pic[int((py + i div 16) * 64 + px + i % 16)]", "pic[int((py + d.dy + i div 16) * 64 + px + d.dx + i % 16)]"
    sums = [let("pic", "pic", total(f"transform(sequence(0L, 255L), i -> ({e}) * (i + 1))")) for e in (f"({own} + {other} + 1) div 2", f"(3 * {own} + {other} + 2) div 4")]
    return rows.selectExpr("f", "m", "d.direction", f"{sums[0]} half", f"{sums[1]} quarter")


@query(f"""WITH {duck.PIX}, o AS (SELECT a.f, a.m, a.x, a.y, CASE (a.f * 3 + a.m) % 4 WHEN 0 THEN 0 WHEN 1 THEN coalesce(b.p, 0) ELSE a.p END AS p FROM pix a LEFT JOIN pix b ON b.f + 1 = a.f AND b.x = a.x AND b.y = a.y)
SELECT f, m, (f * 3 + m) % 4 AS kind, sum(p * (y % 16 * 16 + x % 16 + 1))::BIGINT AS checksum FROM o GROUP BY ALL""")
def block_clear_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that are cleared, copied from the picture before (none: cleared), or left."""
    now = views.macroblocks(spark, sf_dir).selectExpr("f", "m", "y", "(f * 3 + m) % 4 kind")
    rows = now.join(now.selectExpr("f + 1 f", "m", "y before"), ["f", "m"], "left")
    made = "case kind when 0 then array_repeat(0L, 256) when 1 then coalesce(before, array_repeat(0L, 256)) else y end"
    return rows.selectExpr("f", "m", "kind", f"{made} o").selectExpr("f", "m", "kind", f"{total('transform(o, (p, i) -> p * (i + 1))')} checksum")


@query(SQL["psnr_by_picture"])
def metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures by picture, written as CSV with a header and read back."""
    rows = pictures.psnr_by_picture(spark, sf_dir)
    at = f"{shared_dir(spark)}/metrics/{uuid.uuid4().hex}"
    extras.write_metrics(rows, at)
    return spark.read.option("header", True).schema(rows.schema).csv(at)
