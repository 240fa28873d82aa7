"""The choice among a block's types: copied, predicted from the picture before with motion, or from its neighbours in three ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewave.functions import tables
from tilewave.functions.exprs import total
from tilewave.operators import block_search, picture_coder, quantize, transform
from tilewave.plans import duck, pictures, transforms
from tilewave.plans.filters import _PICS, RATE, _narrow, picture_pairs
from tilewave.plans.registry import query
from tilewave.plans.searches import _places_sql, _subsamples_sql

QP, WEIGHT = transforms.QP, transforms.LAMBDA
_SCALE = quantize.luma_dc_scale(QP)

# Types: 0 copy, 1 motion, 2 mean, 3 from above, 4 from the left. Bits: those of the levels, and 1, 3 and the vector's, or 4 for the type.

_TYPES = f"""WITH {_PICS}, pairs AS (SELECT a.f AS k, a.f, b.f AS r FROM pics a JOIN pics b ON b.f + 1 = a.f), {_places_sql('pairs')}, {_subsamples_sql()},
{pictures._NEIGHBOUR_SQL.removeprefix(duck.PIX + ', ')}, side AS (SELECT mb.*, (SELECT sum(t)::BIGINT FROM top WHERE top.f = mb.f AND top.m = mb.m) AS st, (SELECT sum(l)::BIGINT FROM lft WHERE lft.f = mb.f AND lft.m = mb.m) AS sl, greatest((my > 0)::INT * 16 + (mx > 0)::INT * 16, 1) AS n FROM mb),
pred AS (SELECT k AS f, m, 1 AS type, y % 16 AS r, x % 16 AS c, own, p FROM made
 UNION ALL SELECT pix.f, pix.m, t.type, pix.y % 16, pix.x % 16, pix.p, CASE t.type WHEN 2 THEN {pictures._DC_SQL} WHEN 3 THEN top.t ELSE lft.l END
 FROM side JOIN pix ON pix.f = side.f AND pix.m = side.m JOIN top ON top.f = side.f AND top.m = side.m AND top.i = pix.x % 16 JOIN lft ON lft.f = side.f AND lft.m = side.m AND lft.i = pix.y % 16, (SELECT unnest([2, 3, 4]) AS type) t WHERE side.f IN (SELECT f FROM pairs)),
keyed AS (SELECT ((f * 16 + m) * 8 + type) * 4 + r // 8 * 2 + c // 8 AS vec_id, r % 8 AS r, c % 8 AS c, own, p FROM pred),
tile AS (SELECT vec_id, 0 AS label, r, c, own - p AS s FROM keyed), {duck.dct8('tile')}, {duck.const('qi', tables.INTRA_MATRIX)}, {duck.const('qn', tables.INTER_MATRIX)}, {duck.const('dead', tables.INTER_DEADZONE)},
fl AS (SELECT vec_id, k, d.r, d.c, coef, vec_id // 4 % 8 > 1 AS intra, qi.v AS vi, qn.v AS vn, w.v AS w, {duck.rdiv('coef * 16', 'qi.v')} AS fi, {duck.rdiv('coef * 16', 'qn.v')} AS fn FROM dct d JOIN qi USING (k) JOIN qn USING (k) JOIN dead w USING (k)),
lv AS (SELECT *, (CASE WHEN intra AND k = 0 THEN {duck.rdiv('coef', str(_SCALE))} WHEN intra THEN {duck.rdiv('fi', str(2 * QP))} ELSE {duck.rdiv(f'fn - ((sign(fn) * {QP} * w)::BIGINT >> 1)', str(2 * QP))} END)::BIGINT AS level FROM fl),
dq AS (SELECT vec_id, r, c, (CASE WHEN intra AND k = 0 THEN level * {_SCALE} ELSE 2 * level * CASE WHEN intra THEN vi ELSE vn END * {QP} // 16 END)::BIGINT AS deq FROM lv), {duck.idct8('dq', 'deq')},
coded AS (SELECT vec_id // 32 AS b, vec_id // 4 % 8 AS type, sum((own - p - rec) * (own - p - rec))::BIGINT AS ssd FROM idct JOIN (SELECT *, r * 8 + c AS k FROM keyed) USING (vec_id, k) GROUP BY ALL),
bits AS (SELECT vec_id // 32 AS b, vec_id // 4 % 8 AS type, sum({transforms._bits_sql('level')})::BIGINT AS bits FROM lv GROUP BY ALL),
costs AS (SELECT b // 16 AS f, b % 16 AS m, type, ssd + {WEIGHT} * (bits + CASE WHEN type = 1 THEN 3 + abs(dx) + abs(dy) + 1 ELSE 4 END) AS cost FROM coded JOIN bits USING (b, type) LEFT JOIN whole w ON w.k = b // 16 AND w.m = b % 16 AND type = 1
 UNION ALL SELECT a.f, a.m, 0, sum((a.p - b.p) * (a.p - b.p))::BIGINT + {WEIGHT} FROM pix a JOIN pix b ON b.f + 1 = a.f AND b.x = a.x AND b.y = a.y GROUP BY ALL)"""


def _motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, m, dx, dy, place, p: each block's vector, its sub-sample and the prediction."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                now, ref = (c.flatten().to_numpy().reshape(-1, 64, 64) for c in part.columns[1:])
                dx, dy, *_ = block_search.ring_search(now, ref, RATE)
                place, _, made = block_search.subsample_search(now, ref, dx, dy)
                made = made.reshape(-1, 256)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * 256), pa.array(made.ravel(), pa.int64()))
                vector = [pa.array(x.ravel(), pa.int64()) for x in (dx, dy, place)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), 16)), pa.array(np.tile(np.arange(16), part.num_rows)), *vector, lists], ["f", "m", "dx", "dy", "place", "p"])

    return _narrow(picture_pairs(spark, sf_dir).select("f", "a", "b")).mapInArrow(moved, "f long, m long, dx long, dy long, place long, p array<bigint>")


def _coded(spark: SparkSession, sf_dir: str, motion: DataFrame) -> DataFrame:
    """f, m, type, head, q, p, s, level, rec: each quarter of a block under each type but copy: prediction, residual, levels and what they give."""
    own = pictures.predicted(spark, sf_dir).join(picture_pairs(spark, sf_dir).select("f"), "f").selectExpr("f", "cast(m as bigint) m", "y", "modes", "dc")
    intra = own.selectExpr("f", "m", "y", "inline(array(struct(2L type, array_repeat(dc, 256) p), struct(3L type, transform(modes[1], x -> cast(x as bigint)) p), struct(4L type, transform(modes[2], x -> cast(x as bigint)) p)))").selectExpr("f", "m", "type", "4L head", "y", "p")
    inter = motion.join(own.select("f", "m", "y"), ["f", "m"]).selectExpr("f", "m", "1L type", "abs(dx) + abs(dy) + 4 head", "y", "p")
    return _quarters(inter.unionAll(intra))


def _quarters(rows: DataFrame) -> DataFrame:
    """f, m, type, head, q, p, s, level, rec of blocks (f, m, type, head, y, p): a batch's quarters are transformed together."""
    schema = "f long, m long, type long, head long, q int, p array<bigint>, s array<bigint>, level array<bigint>, rec array<bigint>"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                y, p = (part[c].flatten().to_numpy().reshape(-1, 2, 8, 2, 8).swapaxes(2, 3).reshape(-1, 8, 8) for c in ("y", "p"))
                s, inter = y - p, np.repeat(part["type"].to_numpy() == 1, 4)
                level = picture_coder.forward8(s)
                rec = np.empty_like(level)
                for own, intra in ((inter, False), (~inter, True)):
                    level[own] = picture_coder.quantize8(level[own], QP, intra)
                    rec[own] = picture_coder.dequantize8(level[own], QP, intra)
                offsets = pa.array(np.arange(len(s) + 1, dtype=np.int32) * 64)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel())) for x in (p, s, level, picture_coder.inverse8(rec))]
                keys = [pa.array(np.repeat(part[c].to_numpy(), 4)) for c in ("f", "m", "type", "head")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.tile(np.arange(4, dtype=np.int32), part.num_rows)), *lists], ["f", "m", "type", "head", "q", "p", "s", "level", "rec"])

    return rows.mapInArrow(coded, schema)


def _costs(spark: SparkSession, sf_dir: str, coded: DataFrame) -> DataFrame:
    """f, m, type, cost."""
    rows = coded.selectExpr("f", "m", "type", "head", f"{total('zip_with(s, rec, (a, b) -> (a - b) * (a - b))')} ssd", f"{total(f'transform(level, v -> {quantize.coefficient_bits('v')})')} bits")
    sums = rows.groupBy("f", "m", "type").agg(F.expr(f"sum(ssd) + {WEIGHT} * (sum(bits) + max(head)) cost"))
    still = pictures._pairs(spark, sf_dir).selectExpr("f", "cast(m as bigint) m", "0L type", f"{total('zip_with(a, b, (x, y) -> (x - y) * (x - y))')} + {WEIGHT} cost")
    return sums.unionByName(still)


@query(f"""{_TYPES} SELECT f, m, arg_min(type, struct_pack(cost := cost, type := type))::BIGINT AS type, {', '.join(f'min(cost) FILTER (type = {k})::BIGINT AS cost{k}' for k in range(5))} FROM costs GROUP BY f, m""")
def rd_block_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's types by squared error after coding and estimated bits; of equals the first."""
    both = _costs(spark, sf_dir, _coded(spark, sf_dir, _motion(spark, sf_dir))).groupBy("f", "m")
    return both.agg(F.expr("min(struct(cost, type)).type type"), *[F.expr(f"min(cost) filter (where type = {k})").alias(f"cost{k}") for k in range(5)])


@query(f"""{_TYPES}, best AS (SELECT f * 16 + m AS b, arg_min(type, struct_pack(cost := cost, type := type)) AS type FROM costs GROUP BY ALL),
px AS (SELECT vec_id // 32 AS b, vec_id // 4 % 8 AS type, vec_id % 4 * 64 + k AS place, own, least(greatest(p + rec, 0), 255) AS o FROM idct JOIN (SELECT *, r * 8 + c AS k FROM keyed) USING (vec_id, k)
 UNION ALL SELECT a.f * 16 + a.m, 0, (a.y % 16 // 8 * 2 + a.x % 16 // 8) * 64 + a.y % 8 * 8 + a.x % 8, a.p, b.p FROM pix a JOIN pix b ON b.f + 1 = a.f AND b.x = a.x AND b.y = a.y),
rec AS (SELECT b, type, sum(o * (place + 1))::BIGINT AS rebuilt, sum((own - o) * (own - o))::BIGINT AS ssd FROM px GROUP BY ALL),
lsum AS (SELECT vec_id // 32 AS b, vec_id // 4 % 8 AS type, sum(level * (vec_id % 4 * 64 + k + 1))::BIGINT AS levels, count(*) FILTER (level <> 0)::BIGINT AS n FROM lv GROUP BY ALL)
SELECT b // 16 AS f, b % 16 AS m, type::BIGINT AS type, coalesce(levels, 0) AS levels, coalesce(n, 0) AS n, rebuilt, ssd FROM best JOIN rec USING (b, type) LEFT JOIN lsum USING (b, type)""")
def block_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block coded under its best type and rebuilt from its levels: prediction and inverse transform, from 0 to 255, or the copy."""
    coded = _coded(spark, sf_dir, _motion(spark, sf_dir))
    best = _costs(spark, sf_dir, coded).groupBy("f", "m").agg(F.expr("min(struct(cost, type)).type type"))
    rows = coded.selectExpr("f", "m", "type", "q", "level", "zip_with(p, rec, (a, b) -> least(greatest(a + b, 0L), 255L)) o", "zip_with(p, s, (a, b) -> a + b) own")
    still = pictures._pairs(spark, sf_dir).selectExpr("f", "cast(m as bigint) m", "0L type", "explode(sequence(0, 3)) q", "a", "b")
    still = still.selectExpr("f", "m", "type", "q", "cast(array() as array<bigint>) level", f"{transform.quadrant('b', 'q')} o", f"{transform.quadrant('a', 'q')} own")
    rows = rows.unionByName(still).join(best, ["f", "m", "type"])
    place = "(x, k) -> x * (q * 64 + k + 1)"
    rows = rows.selectExpr("f", "m", "type", f"{total(f'transform(level, {place})')} levels", "cast(size(filter(level, x -> x != 0)) as bigint) n", f"{total(f'transform(o, {place})')} rebuilt", f"{total('zip_with(own, o, (a, b) -> (a - b) * (a - b))')} ssd")
    return rows.groupBy("f", "m", "type").agg(*[F.sum(c).alias(c) for c in ("levels", "n", "rebuilt", "ssd")])
