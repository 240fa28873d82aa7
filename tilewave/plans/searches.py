"""Block searches: whole windows, coarse to fine, in the coded part of a picture, sub-samples by six taps, two references by their slots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewave.functions.exprs import let, total
from tilewave.operators import block_search, views
from tilewave.plans import containers, duck
from tilewave.plans.filters import _BOTH, _PICS, _fir, _narrow, picture_pairs, RATE
from tilewave.plans.registry import query

REACH = 2 * block_search.RADIUS - 1


def _searched(rows: DataFrame, columns: list[str], found: Callable[..., list[np.ndarray]]) -> DataFrame:
    """f, m and columns of found(pictures, ...), whose arrays are (pictures, blocks), for a batch of rows of pictures at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                pictures = [c.flatten().to_numpy().reshape(-1, 64, 64) for c in part.columns[1:]]
                out = [np.repeat(part.column(0).to_numpy(), 16), np.tile(np.arange(16), part.num_rows), *(x.ravel() for x in found(*pictures))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["f", "m", *columns])

    return _narrow(rows).mapInArrow(run, ", ".join(f"{c} long" for c in ["f", "m", *columns]))


# ---- whole windows ------------------------------------------------------------------------------------------


def _places_sql(pairs: str) -> str:
    """CTE place: for each source block of pairs(k, f, r) and each place of picture r within reach: cost, and bound by quarters of the block."""
    return f"""ap AS (SELECT k, r, m, m % 4 * 16 AS px, m // 4 * 16 AS py, x, y, p, (y % 16 // 8) * 2 + x % 16 // 8 AS q FROM {pairs} JOIN pix USING (f)),
quarter AS (SELECT k, a.m, b.x - a.x AS dx, b.y - a.y AS dy, q, sum(abs(a.p - b.p)) AS s, abs(sum(a.p - b.p)) AS least FROM ap a JOIN pix b ON b.f = a.r
 WHERE abs(b.x - a.x) <= {REACH} AND abs(b.y - a.y) <= {REACH} AND px + b.x - a.x BETWEEN 0 AND 48 AND py + b.y - a.y BETWEEN 0 AND 48 GROUP BY ALL),
place AS (SELECT k, m, dx, dy, sum(s)::BIGINT + {RATE} * (abs(dx) + abs(dy) + 1) AS cost, sum(least)::BIGINT + {RATE} * (abs(dx) + abs(dy) + 1) AS bound, dx * dx + dy * dy AS dist FROM quarter GROUP BY k, m, dx, dy),
whole AS (SELECT k, m, arg_min(dx, o) AS dx, arg_min(dy, o) AS dy, min(cost) AS cost FROM (SELECT *, struct_pack(cost := cost, dist := dist, dy := dy, dx := dx) AS o FROM place) GROUP BY k, m)"""


@query(f"""WITH {duck.PIX}, pairs AS (SELECT DISTINCT a.f AS k, a.f, b.f AS r FROM pix a JOIN pix b ON b.f + 1 = a.f), {_places_sql('pairs')},
ring AS (SELECT k, m, greatest(abs(dx), abs(dy)) AS ring, min(cost) AS best FROM place GROUP BY ALL),
before AS (SELECT k, m, ring, min(best) OVER (PARTITION BY k, m ORDER BY ring ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ring),
n AS (SELECT p.k, p.m, count(*)::BIGINT AS compared FROM place p JOIN before b ON b.k = p.k AND b.m = p.m AND b.ring = greatest(abs(p.dx), abs(p.dy)) WHERE b.best IS NULL OR p.bound <= b.best GROUP BY ALL)
SELECT k AS f, m, dx, dy, cost, compared FROM whole JOIN n USING (k, m)""")
def motion_search_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest of all displacements that radius 16 reaches, up to 31, and how many places were compared: rings from the middle
    outwards, less what a lower bound rules out."""
    return _searched(picture_pairs(spark, sf_dir).select("f", "a", "b"), ["dx", "dy", "cost", "compared"], lambda a, b: list(block_search.ring_search(a, b, RATE)))


# ---- steps --------------------------------------------------------------------------------------------------

_SEARCH = f"{_BOTH}, mbs AS (SELECT f, a, b, m, (m % 4) * 16 AS px, (m // 4) * 16 AS py FROM pp, range(0, 16) o(m))"
_OWN = f"WITH {_PICS}, mbs AS (SELECT f, pic AS a, pic AS b, m, (m % 4) * 16 AS px, (m // 4) * 16 AS py FROM pics, range(0, 16) o(m))"


def _sad_sql(x: str, y: str) -> str:
    return f"(SELECT sum(abs(a[(py + j // 16) * 64 + px + j % 16 + 1] - b[({y} + j // 16) * 64 + {x} + j % 16 + 1]))::BIGINT FROM range(0, 256) q(j))"


def _sad(x: str, y: str) -> str:
    return total(f"transform(sequence(0, 255), j -> abs(z.a[int((py + j div 16) * 64 + px + j % 16)] - z.b[int(({y} + j div 16) * 64 + {x} + j % 16)]))")


def _inside(dx: str, dy: str, coded: bool) -> str:
    return f"px + {dx} between 0 and 48 and py + {dy} between 0 and 48" + (f" and not ({dy} > -16 and {dx} > -16)" if coded else "")


def _steps_sql(start: str, steps: list[int], rate: int, coded: bool) -> str:
    """CTEs s0, s1, ...: from start(f, m, dx, dy, cost, dist), a 3x3 grid around the best so far for each step."""
    out = f", s0 AS ({start})"
    pick = "struct_pack(cost := cost, dist := dist, seq := seq)"
    for k, step in enumerate(steps):
        dx, dy = f"(g.dx + {step} * ux)", f"(g.dy + {step} * uy)"
        cand = f"SELECT g.f, g.m, {dx} AS dx, {dy} AS dy, (uy + 1) * 3 + ux + 1 AS seq, px, py, a, b FROM s{k} g JOIN mbs USING (f, m), range(-1, 2) u(ux), range(-1, 2) v(uy) WHERE {_inside(dx, dy, coded)}"
        costed = f"SELECT f, m, dx, dy, {_sad_sql('(px + dx)', '(py + dy)')} + {rate} * (abs(dx) + abs(dy) + 1) AS cost, dx * dx + dy * dy AS dist, seq FROM ({cand})"
        out += f", s{k + 1} AS (SELECT f, m, arg_min(dx, {pick}) AS dx, arg_min(dy, {pick}) AS dy, min(cost) AS cost, arg_min(dist, {pick}) AS dist FROM (SELECT *, -1 AS seq FROM s{k} UNION ALL BY NAME {costed}) GROUP BY f, m)"
    return out + f" SELECT f, m, dx, dy, cost::BIGINT AS cost FROM s{len(steps)}"


def _stepped(rows: DataFrame, steps: list[int], rate: int, coded: bool) -> DataFrame:
    """rows (f, m, z, px, py, g) -> f, m, dx, dy, cost: g is the best so far as (cost, dist, seq, dx, dy)."""
    for step in steps:
        grid = f"filter(transform(sequence(0L, 8L), s -> struct(g.dx + {step} * (s % 3 - 1) dx, g.dy + {step} * (s div 3 - 1) dy, s)), c -> {_inside('c.dx', 'c.dy', coded)})"
        around = f"transform({grid}, c -> struct({_sad('px + c.dx', 'py + c.dy')} + {rate} * (abs(c.dx) + abs(c.dy) + 1) cost, c.dx * c.dx + c.dy * c.dy dist, c.s seq, c.dx dx, c.dy dy))"
        kept = "array(struct(g.cost cost, g.dist dist, -1L seq, g.dx dx, g.dy dy))"
        rows = rows.selectExpr("f", "m", "z", "px", "py", f"{let('z', 'z', let('g', 'g', f'array_min(concat({kept}, {around}))'))} g")
    return rows.selectExpr("f", "m", "g.dx dx", "g.dy dy", "g.cost cost")


def _blocks(rows: DataFrame) -> DataFrame:
    """f, m, z, px, py of rows (f, a, b)."""
    return rows.selectExpr("f", "struct(a, b) z", "explode(sequence(0L, 15L)) m").selectExpr("f", "m", "z", "(m % 4) * 16 px", "(m div 4) * 16 py")


STEPS = [16, 8, 4, 2, 1]


@query(f"{_SEARCH}{_steps_sql(f'SELECT f, m, 0::BIGINT AS dx, 0::BIGINT AS dy, {_sad_sql('px', 'py')} + {RATE} AS cost, 0::BIGINT AS dist FROM mbs', STEPS, RATE, False)}")
def motion_search_coarse_to_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps 16, 8, 4, 2, 1: a 3x3 grid around the best so far, on lower cost, or equal cost and a smaller displacement."""
    rows = _blocks(picture_pairs(spark, sf_dir))
    rows = rows.selectExpr("*", f"{let('z', 'z', f'struct({_sad('px', 'py')} + {RATE} cost, 0L dist, -1L seq, 0L dx, 0L dy)')} g")
    return _stepped(rows, STEPS, RATE, False)


_GRID = f"""SELECT f, m, arg_min(dx, o) AS dx, arg_min(dy, o) AS dy, min(cost) AS cost, arg_min(dx * dx + dy * dy, o) AS dist FROM (
 SELECT f, m, dx, dy, {_sad_sql('(px + dx)', '(py + dy)')} AS cost, struct_pack(cost := {_sad_sql('(px + dx)', '(py + dy)')}, seq := ((dy + 32) // 16) * 3 + (dx + 16) // 16) AS o
 FROM mbs, (SELECT unnest([-16, 0, 16])::BIGINT AS dx), (SELECT unnest([-32, -16, 0])::BIGINT AS dy) WHERE {_inside('dx', 'dy', True)}) GROUP BY f, m"""


@query(f"{_OWN}{_steps_sql(_GRID, STEPS[1:], 0, True)}")
def motion_search_intra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the part of the same picture that is coded already: a start grid two radii up and one to each side, then steps 8, 4, 2, 1."""
    grid = f"filter(transform(sequence(0L, 8L), s -> struct((s % 3) * 16 - 16 dx, (s div 3) * 16 - 32 dy, s)), c -> {_inside('c.dx', 'c.dy', True)})"
    best = let("z", "z", f"array_min(transform({grid}, c -> struct({_sad('px + c.dx', 'py + c.dy')} cost, c.s seq, c.dx dx, c.dy dy)))")
    rows = _blocks(views.pictures(spark, sf_dir).selectExpr("f", "pic a", "pic b")).selectExpr("*", f"{best} c").where("c is not null")
    rows = rows.selectExpr("f", "m", "z", "px", "py", "struct(c.cost cost, c.dx * c.dx + c.dy * c.dy dist, -1L seq, c.dx dx, c.dy dy) g")
    return _stepped(rows, STEPS[1:], 0, True)


# ---- sub-samples --------------------------------------------------------------------------------------------


def _subsamples_sql() -> str:
    """CTE made(k, m, x, y, p, place, sad): the prediction of each block of ap around its whole-sample place, by pixel."""
    return f"""across AS (SELECT f, list({_fir(False, 1)} ORDER BY i) AS pic FROM pics, range(0, 4096) o(i) GROUP BY f),
planes AS (SELECT f, 0 AS kind, pic FROM pics UNION ALL SELECT f, 1, pic FROM across
 UNION ALL SELECT f, 2, list({_fir(False, 64)} ORDER BY i) FROM pics, range(0, 4096) o(i) GROUP BY f
 UNION ALL SELECT f, 3, list({_fir(False, 64)} ORDER BY i) FROM across, range(0, 4096) o(i) GROUP BY f),
plane AS (SELECT f, kind, i % 64 AS x, i // 64 AS y, pic[i + 1] AS p FROM planes, range(0, 4096) o(i)),
dirs AS (SELECT u, v, 2 * ((v + 1) * 3 + u + 1 - ((v + 1) * 3 + u + 1 > 4)::INT) + quarter AS place, quarter FROM range(-1, 2) a(u), range(-1, 2) b(v), range(0, 2) c(quarter) WHERE u <> 0 OR v <> 0
 UNION ALL SELECT 0, 0, -1, 0),
cand AS (SELECT w.k, w.m, w.dx, w.dy, d.*, abs(u) + 2 * abs(v) AS kind FROM whole w, dirs d WHERE m % 4 * 16 + w.dx + u BETWEEN 0 AND 48 AND m // 4 * 16 + w.dy + v BETWEEN 0 AND 48),
val AS (SELECT c.k, c.m, c.place, a.x, a.y, a.p AS own, CASE WHEN c.quarter = 1 THEN (b.p + s.p + 1) >> 1 ELSE s.p END AS p
 FROM cand c JOIN ap a ON a.k = c.k AND a.m = c.m JOIN plane s ON s.f = a.r AND s.kind = c.kind AND s.x = a.x + c.dx + least(c.u, 0) AND s.y = a.y + c.dy + least(c.v, 0)
 JOIN plane b ON b.f = a.r AND b.kind = 0 AND b.x = a.x + c.dx AND b.y = a.y + c.dy),
sums AS (SELECT k, m, place, sum(abs(own - p))::BIGINT AS sad FROM val GROUP BY ALL),
sub AS (SELECT k, m, arg_min(place, struct_pack(sad := sad, place := place)) AS place, min(sad) AS sad FROM sums GROUP BY k, m),
made AS (SELECT v.k, v.m, x, y, own, p, place, sad FROM val v JOIN sub USING (k, m, place))"""


@query(f"""WITH {_PICS}, pairs AS (SELECT a.f AS k, a.f, b.f AS r FROM pics a JOIN pics b ON b.f + 1 = a.f), {_places_sql('pairs')}, {_subsamples_sql()}
SELECT k AS f, m, dx, dy, place::BIGINT AS place, sad FROM whole JOIN sub USING (k, m)""")
def subpel_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half and quarter samples by six taps in eight directions around the best whole-sample place: 2 * direction + quarter, or -1."""

    def found(now: np.ndarray, ref: np.ndarray) -> list[np.ndarray]:
        dx, dy, *_ = block_search.ring_search(now, ref, RATE)
        place, sad, _ = block_search.subsample_search(now, ref, dx, dy)
        return [dx, dy, place, sad]

    return _searched(picture_pairs(spark, sf_dir).select("f", "a", "b"), ["dx", "dy", "place", "sad"], found)


# ---- two references -----------------------------------------------------------------------------------------


def slot_contents(schedule: DataFrame) -> DataFrame:
    """schedule (period, display, coded, slot, forward, backward) -> each picture with the pictures that its two slots hold when it is
    coded. A slot holds a picture from when that is coded until another is put there: an interval, of those of one slot and period."""
    after = F.lead("coded").over(Window.partitionBy("period", "slot").orderBy("coded"))  # a period is of bounded length
    held = schedule.select("period", "slot", F.col("display").alias("held"), F.col("coded").alias("since"), F.coalesce(after, F.lit(1 << 62)).alias("until"))
    out = schedule
    for side in ("forward", "backward"):
        own = held.select("period", F.col("slot").alias(side), F.col("held").alias(f"{side}_picture"), F.col("since"), "until")
        out = out.join(own, ["period", side]).where("since < coded and coded <= until").drop("since", "until")
    return out.select("period", "display", "coded", "forward_picture", "backward_picture")


_SLOTS = f"""{containers._schedule_sql()}, c AS (SELECT period, display, d, place, period * {containers.PERIOD} + CASE WHEN d = 0 THEN 0 ELSE 1 + g * 4 + place END AS coded,
 CASE WHEN d = 0 THEN 0 WHEN place = 0 THEN (g + 1) % 2 WHEN place = 1 THEN 2 ELSE 3 END AS slot, CASE WHEN d = 0 THEN 0 WHEN place = 3 THEN 2 ELSE g % 2 END AS forward, CASE WHEN d = 0 OR place = 0 THEN 0 WHEN place = 2 THEN 2 ELSE (g + 1) % 2 END AS backward FROM g),
held AS (SELECT c.period, c.display, c.coded, c.d, c.place, (SELECT arg_max(o.display, o.coded) FROM c o WHERE o.period = c.period AND o.slot = c.forward AND o.coded < c.coded AND o.coded >= c.coded - 64) AS forward_picture,
 (SELECT arg_max(o.display, o.coded) FROM c o WHERE o.period = c.period AND o.slot = c.backward AND o.coded < c.coded AND o.coded >= c.coded - 64) AS backward_picture FROM c)"""


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = containers._schedule(spark, sf_dir).selectExpr("period", "display", "d", "place", f"period * {containers.PERIOD} + if(d = 0, 0L, 1 + g * 4 + place) coded", "g")
    return rows.selectExpr("period", "display", "coded", "case when d = 0 then 0L when place = 0 then (g + 1) % 2 when place = 1 then 2L else 3L end slot", "case when d = 0 then 0L when place = 3 then 2L else g % 2 end forward", "case when d = 0 or place = 0 then 0L when place = 2 then 2L else (g + 1) % 2 end backward", "d > 0 and place > 0 b")


@query(f"{_SLOTS} SELECT display, coded, forward_picture, backward_picture FROM held WHERE forward_picture IS NOT NULL AND backward_picture IS NOT NULL")
def slot_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures in a picture's two slots when it is coded."""
    return slot_contents(_slots(spark, sf_dir)).select("display", "coded", "forward_picture", "backward_picture")


@query(f"""{_SLOTS}, {_PICS}, b AS (SELECT display AS f, forward_picture, backward_picture FROM held WHERE d > 0 AND place > 0),
pairs AS (SELECT 2 * f AS k, f, forward_picture AS r FROM b UNION ALL SELECT 2 * f + 1, f, backward_picture FROM b), {_places_sql('pairs')}, {_subsamples_sql()},
tri AS (SELECT x.k // 2 AS f, x.m, any_value(x.sad) AS fwd, any_value(y.sad) AS bwd, sum(abs(x.own - ((x.p + y.p + 1) >> 1)))::BIGINT AS bi FROM made x JOIN made y ON y.k = x.k + 1 AND x.k % 2 = 0 AND y.m = x.m AND y.x = x.x AND y.y = x.y GROUP BY ALL)
SELECT f, m, b.forward_picture AS forward, b.backward_picture AS backward, fwd, bwd, bi, CASE WHEN fwd <= bwd AND fwd <= bi + 8 * {RATE} THEN 0 WHEN bwd <= bi + 8 * {RATE} THEN 1 ELSE 2 END::BIGINT AS choice FROM tri JOIN b USING (f)""")
def bidir_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures between others: whole- and sub-sample searches in the pictures that their two slots hold, and the average of what they find."""

    def found(now: np.ndarray, before: np.ndarray, after: np.ndarray, *which: np.ndarray) -> list[np.ndarray]:
        sads, made = [], []
        for ref in (before, after):
            dx, dy, *_ = block_search.ring_search(now, ref, RATE)
            _, sad, block = block_search.subsample_search(now, ref, dx, dy)
            sads.append(sad)
            made.append(block)
        fwd, bwd, bi = *sads, np.abs(block_search.blocks_of(now).astype(np.int32) - ((made[0] + made[1] + 1) >> 1)).sum((2, 3))
        return [fwd, bwd, bi, np.where((fwd <= bwd) & (fwd <= bi + 8 * RATE), 0, np.where(bwd <= bi + 8 * RATE, 1, 2))]

    pictures = views.pictures(spark, sf_dir)
    slots = _slots(spark, sf_dir)
    between = slot_contents(slots).join(slots.where("b").select("display"), "display").select(F.col("display").alias("f"), "forward_picture", "backward_picture")
    rows = between.join(pictures.selectExpr("f", "pic a"), "f")
    for side, name in (("forward", "x"), ("backward", "y")):
        rows = rows.join(pictures.selectExpr(f"f {side}_picture", f"pic {name}"), f"{side}_picture")
    out = _searched(rows.select("f", "a", "x", "y"), ["fwd", "bwd", "bi", "choice"], found)
    return out.join(between.selectExpr("f", "forward_picture forward", "backward_picture backward"), "f").select("f", "m", "forward", "backward", "fwd", "bwd", "bi", "choice")
