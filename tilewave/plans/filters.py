"""Queries on edge filters, sample offsets, sub-sample interpolation and block search. Filters read a snapshot of the picture."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewave.functions import tables
from tilewave.functions.exprs import array, let, rdiv, total
from tilewave.operators import sample_offsets, views
from tilewave.plans import duck
from tilewave.plans.registry import query

RATE = 4
_PICS = f"{duck.PIX}, pics AS (SELECT f, list(p ORDER BY y, x) AS pic FROM pix GROUP BY f)"
_BOTH = f"WITH {_PICS}, pp AS (SELECT a.f, a.pic AS a, b.pic AS b FROM pics a JOIN pics b ON b.f + 1 = a.f)"


def picture_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, a, b: a picture (the source) and the one before (its reconstruction)."""
    now = views.pictures(spark, sf_dir)
    return now.selectExpr("f", "pic a").join(now.selectExpr("f + 1 f", "pic b"), "f")


def _narrow(rows: DataFrame) -> DataFrame:
    """f and pictures, whose pixels go to Python as two bytes each."""
    return rows.select("f", *[F.col(c).cast("array<smallint>").alias(c) for c in rows.columns if c != "f"])


# ---- deblocking ---------------------------------------------------------------------------------------------
# Decisions stand in for a coder's: a block is a copy if (f + m) % 5 = 0, and its quantizer is 14 + 2 m.


@dataclass
class Plane:
    """Side of a plane and of a block in it; strong: whether three pixels from an edge are filtered, or two; what is added to the quantizer;
    planes: how many planes of a picture stand under numbers of their own."""

    side: int = 64
    block: int = 16
    luma: bool = True
    qp_offset: int = 0
    planes: int = 1

    def picture(self, spark: bool) -> str:
        return "f" if self.planes == 1 else f"(f {'div' if spark else '//'} {self.planes})"


LUMA, CHROMA = Plane(), Plane(32, 8, False, 2, 2)


def _edge(spark: bool, p: str, q: str, at, plane: Plane = LUMA) -> tuple[str, str]:
    """(strength, average quantizer) between the blocks at (x, y) pairs p and q."""
    div = "div" if spark else "//"
    m = [f"(({y}) {div} {plane.block} * 4 + ({x}) {div} {plane.block})" for x, y in (p, q)]
    copy = [f"(({plane.picture(spark)} + {b}) % 5 = 0)" for b in m]
    strength = f"(CASE WHEN {copy[0]} AND {copy[1]} THEN 0 WHEN {copy[0]} OR {copy[1]} THEN 1 WHEN ({at}) % {plane.block} = 0 THEN 2 ELSE 1 END)"
    qp = [f"(14 + 2 * {b})" for b in m]
    half = f"({qp[0]} + {qp[1]}) {'div' if spark else '//'} 2"
    return strength, f"(CASE WHEN {copy[0]} AND {copy[1]} THEN 0 WHEN {copy[0]} THEN {qp[1]} WHEN {copy[1]} THEN {qp[0]} ELSE {half} END)"


def _filter(spark: bool, vertical: bool, rows: str, plane: Plane) -> str:
    """The new value of pixel i of pic: at most three from an edge, every eight. vertical: edges between columns."""
    div, round_ = ("div", rdiv) if spark else ("//", duck.rdiv)
    side, last = plane.side, plane.side - 1
    pos, line = (f"(i % {side})", f"(i {div} {side})") if vertical else (f"(i {div} {side})", f"(i % {side})")
    edge = f"(({pos} + 3) {div} 8 * 8)"

    def px(place: str) -> str:
        i = f"{line} * {side} + {place}" if vertical else f"({place}) * {side} + {line}"
        return f"pic[int({i})]" if spark else f"pic[({i}) + 1]"

    far = f"({pos} >= {edge})"
    near = [f"(CASE WHEN {far} THEN {px(f'least({edge} + {k}, {last})')} ELSE {px(f'greatest({edge} - {k + 1}, 0)')} END)" for k in range(4)]
    over = [f"(CASE WHEN {far} THEN {px(f'greatest({edge} - {k + 1}, 0)')} ELSE {px(f'least({edge} + {k}, {last})')} END)" for k in range(2)]
    k = f"(CASE WHEN {far} THEN {pos} - {edge} ELSE {edge} - 1 - {pos} END)"
    a, b = ((f"{edge} - 1", line), (edge, line)) if vertical else ((line, f"{edge} - 1"), (line, edge))
    strength, qp = _edge(spark, a, b, edge, plane)
    n0, n1, n2, n3, f0, f1 = ("n0", "n1", "n2", "n3", "f0", "f1")
    # what becomes of the first, second and third pixel from an edge
    strong = [round_(f"{n2} + 2 * {n1} + 2 * {n0} + 2 * {f0} + {f1}", "8"), round_(f"{n2} + {n1} + {n0} + {f0}", "4"), round_(f"2 * {n3} + 3 * {n2} + {n1} + {n0} + {f0}", "8") if plane.luma else "old"]
    weak = [round_(f"4 * ({n0} + {f0}) + {n1} - {f1}", "8"), round_(f"4 * {n2} + 2 * {n0} + 2 * {f0}", "8") if plane.luma else "old", "old"]
    strong, weak = (f"CASE k WHEN 0 THEN {x} WHEN 1 THEN {y} ELSE {z} END" for x, y, z in (strong, weak))
    alpha, beta = (f"{array(t)}[int(q)]" if spark else f"([{', '.join(map(str, t))}])[q + 1]" for t in (tables.EDGE_ALPHA, tables.EDGE_BETA))
    value = f"CASE WHEN abs(n0 - f0) >= {alpha} OR abs(n1 - n0) >= {beta} OR abs(f1 - f0) >= {beta} THEN old WHEN s = 2 THEN {strong} WHEN s = 1 THEN {weak} ELSE old END"
    names = {"old": "pic[i]" if spark else "pic[i + 1]", "n0": near[0], "n1": near[1], "n2": near[2], "n3": near[3], "f0": over[0], "f1": over[1], "k": k, "s": strength, "qa": qp}
    touched = f"{edge} BETWEEN 8 AND {side - 8} AND {pos} BETWEEN {edge} - 3 AND {edge} + 2 AND ({rows})"
    qe = f"least(qa + {plane.qp_offset}, 63)" if plane.qp_offset else "qa"
    q = f"least(CASE WHEN s = 2 AND {qe} > 0 THEN {qe} + 2 ELSE {qe} END, 63)"
    if spark:
        pair = ", ".join(f"{v} {n}" for n, v in names.items())
        for n in ("n0", "n1", "n2", "n3", "f0", "f1", "k", "s", "qa", "old", "q"):
            value, q = _word(value, n, f"z.{n}"), _word(q, n, f"z.{n}")
        return f"if({touched}, {let(f'struct({pair})', 'z', value.replace('z.q]', q + ']').replace('int(z.q)', f'int({q})'))}, pic[i])"
    return f"SELECT f, list(CASE WHEN {touched} THEN {value} ELSE pic_i END ORDER BY i) AS pic FROM (SELECT *, {q} AS q FROM (SELECT f, i, {', '.join(f'{v} AS {n}' for n, v in names.items())}, pic[i + 1] AS pic_i FROM {{source}}, range(0, {side * side}) o(i))) GROUP BY f"


def _word(text: str, name: str, to: str) -> str:
    return re.sub(rf"(?<![\w.]){name}(?![\w(])", to, text)


def _stage(vertical: bool, spark: bool, rows: str, plane: Plane = LUMA) -> str:
    return _filter(spark, vertical, rows.format(y=f"(i {'div' if spark else '//'} {plane.side})"), plane)


_STAGES = [(True, "{y} < 8 OR {y} % 8 >= 4"), (False, "TRUE"), (True, "{y} >= 8 AND {y} % 8 < 4")]


@query(
    f"WITH {_PICS}, s1 AS ({_stage(*(_STAGES[0][0], False, _STAGES[0][1])).format(source='pics')}), s2 AS ({_stage(False, False, _STAGES[1][1]).format(source='s1')}), s3 AS ({_stage(True, False, _STAGES[2][1]).format(source='s2')}) "
    "SELECT s3.f, i // 64 AS y, sum(s3.pic[i + 1] * (i % 64 + 1))::BIGINT AS checksum, count(*) FILTER (s3.pic[i + 1] <> pics.pic[i + 1])::BIGINT AS changed FROM s3 JOIN pics USING (f), range(0, 4096) o(i) GROUP BY ALL"
)
def deblock_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parallel stages equal the in-place order: edges between columns above, between rows, between columns beside them."""
    rows = views.pictures(spark, sf_dir).selectExpr("f", "pic src", "pic")
    for vertical, which in _STAGES:
        body = f"transform(sequence(0, 4095), i -> {_stage(vertical, True, which)})"
        rows = rows.selectExpr("f", "src", f"{let('pic', 'pic', body)} pic")
    line = "explode(transform(sequence(0, 63), y -> struct(y, slice(pic, y * 64 + 1, 64) a, slice(src, y * 64 + 1, 64) b))) r"
    rows = rows.selectExpr("f", line)
    return rows.selectExpr("f", "cast(r.y as bigint) y", f"{total('transform(r.a, (p, x) -> p * (x + 1))')} checksum", "cast(size(filter(zip_with(r.a, r.b, (p, q) -> p != q), d -> d)) as bigint) changed")


_CPICS = f"""{_PICS}, cpix AS (SELECT f, x // 2 AS x, y // 2 AS y, (sum(p)::BIGINT + 2) >> 2 AS u FROM pix GROUP BY ALL),
cpics AS (SELECT 2 * f AS f, list(u ORDER BY y, x) AS pic FROM cpix GROUP BY ALL UNION ALL SELECT 2 * f + 1, list(255 - u ORDER BY y, x) FROM cpix GROUP BY ALL)"""


def chroma_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, pic: the 32x32 chroma planes of each picture, under 2 f and 2 f + 1: rounded means of four pixels, and what they lack to 255."""
    at = "pic[int((i div 32) * 128 + i % 32 * 2 + {d})]"
    mean = "shiftright(" + " + ".join(at.format(d=d) for d in (0, 1, 64, 65)) + " + 2, 2)"
    rows = views.pictures(spark, sf_dir).selectExpr("f", f"{let('pic', 'pic', f'transform(sequence(0, 1023), i -> {mean})')} u")
    return rows.selectExpr("f", "posexplode(array(u, transform(u, x -> 255 - x))) as (k, pic)").selectExpr("2 * f + k f", "pic")


@query(
    f"WITH {_CPICS}, s1 AS ({_stage(True, False, _STAGES[0][1], CHROMA).format(source='cpics')}), s2 AS ({_stage(False, False, _STAGES[1][1], CHROMA).format(source='s1')}), s3 AS ({_stage(True, False, _STAGES[2][1], CHROMA).format(source='s2')}) "
    "SELECT s3.f // 2 AS f, s3.f % 2 AS plane, i // 32 AS y, sum(s3.pic[i + 1] * (i % 32 + 1))::BIGINT AS checksum, count(*) FILTER (s3.pic[i + 1] <> cpics.pic[i + 1])::BIGINT AS changed FROM s3 JOIN cpics USING (f), range(0, 1024) o(i) GROUP BY ALL"
)
def deblock_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As deblock_filter, on both chroma planes: every edge is a block's, two pixels beside it change at most, at a coarser step."""
    rows = chroma_planes(spark, sf_dir).selectExpr("f", "pic src", "pic")
    for vertical, which in _STAGES:
        body = f"transform(sequence(0, 1023), i -> {_stage(vertical, True, which, CHROMA)})"
        rows = rows.selectExpr("f", "src", f"{let('pic', 'pic', body)} pic")
    rows = rows.selectExpr("f", "explode(transform(sequence(0, 31), y -> struct(y, slice(pic, y * 32 + 1, 32) a, slice(src, y * 32 + 1, 32) b))) r")
    return rows.selectExpr("f div 2 f", "f % 2 plane", "cast(r.y as bigint) y", f"{total('transform(r.a, (p, x) -> p * (x + 1))')} checksum", "cast(size(filter(zip_with(r.a, r.b, (p, q) -> p != q), d -> d)) as bigint) changed")


def _strengths(spark: bool) -> dict[str, str]:
    s, q = _edge(spark, ("e * 8 - 1", "y * 8"), ("e * 8", "y * 8"), "e * 8")
    t, r = _edge(spark, ("y * 8", "e * 8 - 1"), ("y * 8", "e * 8"), "e * 8")
    return {"vertical": s, "vertical_qp": q, "horizontal": t, "horizontal_qp": r}


@query(f"WITH {_PICS} SELECT f, e, y, {', '.join(f'{v} AS {n}' for n, v in _strengths(False).items())} FROM pics, range(1, 8) a(e), range(0, 8) b(y)")
def deblock_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pictures(spark, sf_dir).selectExpr("f", "explode(sequence(1L, 7L)) e").selectExpr("f", "e", "explode(sequence(0L, 7L)) y")
    return rows.selectExpr("f", "e", "y", *[f"cast({v} as bigint) {n}" for n, v in _strengths(True).items()])


# ---- sample offsets -----------------------------------------------------------------------------------------


@query(f"{_BOTH} SELECT f, ((i // 64) // 16) * 4 + (i % 64) // 16 AS m, b[i + 1] // 8 AS band, sum(a[i + 1] - b[i + 1])::BIGINT AS err, count(*)::BIGINT AS n FROM pp, range(0, 4096) o(i) GROUP BY ALL")
def band_error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).where("kind = 'band'").selectExpr("f", "m", "slot band", "err", "n")


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, m, and t: structs of source, reconstruction and place, one for each of a block's 256 pixels."""
    at = "int(((m div 4) * 16 + j div 16) * 64 + (m % 4) * 16 + j % 16)"
    body = f"transform(sequence(0, 255), j -> struct(z.a[{at}] s, z.b[{at}] r, {at} i))"
    return picture_pairs(spark, sf_dir).selectExpr("f", "a", "b", "explode(sequence(0L, 15L)) m").selectExpr("f", "m", "b", f"{let('struct(a, b)', 'z', body)} t")


#: Steps of the four direction classes: horizontal, vertical, and both diagonals.
_STEPS = sample_offsets.STEPS
_EDGES = f"""{_BOTH}, st AS (SELECT unnest([0, 1, 2, 3]) AS class, unnest([{', '.join(str(x) for x, _ in _STEPS)}]) AS dx, unnest([{', '.join(str(y) for _, y in _STEPS)}]) AS dy),
e AS (SELECT f, ((i // 64) // 16) * 4 + (i % 64) // 16 AS m, class, i, a[i + 1] - b[i + 1] AS d, b[i + 1] AS r,
  CASE WHEN i % 64 - dx BETWEEN 0 AND 63 AND i % 64 + dx BETWEEN 0 AND 63 AND i // 64 - dy BETWEEN 0 AND 63 AND i // 64 + dy BETWEEN 0 AND 63
       THEN sign(b[i - dy * 64 - dx + 1] - b[i + 1]) + sign(b[i + dy * 64 + dx + 1] - b[i + 1]) ELSE 0 END::BIGINT AS category
 FROM pp, st, range(0, 4096) o(i))"""


@query(f"{_EDGES} SELECT f, m, class, category, sum(d)::BIGINT AS err, count(*)::BIGINT AS n FROM e WHERE category <> 0 GROUP BY ALL")
def edge_category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).where("kind = 'edge'").selectExpr("f", "m", "class", "slot category", "err", "n")


def _category(dx: str, dy: str, i: str = "p.i") -> str:
    inside = f"{i} % 64 - {dx} between 0 and 63 and {i} % 64 + {dx} between 0 and 63 and {i} div 64 - {dy} between 0 and 63 and {i} div 64 + {dy} between 0 and 63"
    return f"if({inside}, int(sign(pic[int({i} - {dy} * 64 - {dx})] - pic[{i}]) + sign(pic[int({i} + {dy} * 64 + {dx})] - pic[{i}])), 0)"


_CATEGORIES, _PER_BLOCK = sample_offsets.CATEGORIES, sample_offsets.PER_BLOCK


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, m, kind, slot, class, err, n: a block's bands and edge categories that hold pixels, in one pass over the picture pairs."""

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), 64):
                rows = batch.iloc[low : low + 64]
                source, made = (np.stack(rows[c].to_numpy()).astype(np.int64).reshape(-1, 64, 64) for c in ("a", "b"))
                err, n = (x.ravel() for x in sample_offsets.statistics(source, made))
                hit = np.flatnonzero(n)
                cell = hit % _PER_BLOCK
                edge, band = cell - 32, cell < 32
                yield pd.DataFrame({
                    "f": rows["f"].to_numpy()[hit // (16 * _PER_BLOCK)], "m": hit // _PER_BLOCK % 16, "kind": np.where(band, "band", "edge"),
                    "slot": np.where(band, cell, np.array(_CATEGORIES)[edge % 4]), "class": np.where(band, 0, edge // 4), "err": err[hit], "n": n[hit],
                })

    return _narrow(picture_pairs(spark, sf_dir).select("f", "a", "b")).mapInPandas(run, "f long, m long, kind string, slot long, class long, err long, n long")


_OFFSET = "least(greatest((err + CASE WHEN err >= 0 THEN n {div} 2 ELSE -(n {div} 2) END) {div} n, -7), 7)"
_CELLS = f"""{_EDGES}, cells AS (SELECT f, m, 'band' AS kind, b[i + 1] // 8 AS slot, 0 AS class, sum(a[i + 1] - b[i + 1])::BIGINT AS err, count(*)::BIGINT AS n FROM (SELECT pp.*, i, ((i // 64) // 16) * 4 + (i % 64) // 16 AS m FROM pp, range(0, 4096) o(i)) GROUP BY ALL
 UNION ALL SELECT f, m, 'edge', category, class, sum(d)::BIGINT, count(*)::BIGINT FROM e WHERE category <> 0 GROUP BY ALL),
offs AS (SELECT *, {_OFFSET.format(div='//')} AS off FROM cells)"""


@query(f"{_CELLS} SELECT f, m, kind, slot, class, off AS offset_ FROM offs")
def clamped_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir).selectExpr("f", "m", "kind", "slot", "class", "off offset_")


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).selectExpr("*", f"{_OFFSET.format(div='div')} off")


@query(f"{_BOTH} SELECT f, ((i // 64) // 16) * 4 + (i % 64) // 16 AS m, sum((b[i + 1] + CASE WHEN b[i + 1] // 8 BETWEEN 14 AND 17 THEN ([1, -2, 3, -1])[b[i + 1] // 8 - 13] ELSE 0 END) * (i + 1))::BIGINT AS checksum FROM pp, range(0, 4096) o(i) GROUP BY ALL")
def band_offset_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = "p.r + if(p.r div 8 between 14 and 17, array(1, -2, 3, -1)[int(p.r div 8 - 14)], 0)"
    return _tiles(spark, sf_dir).selectExpr("f", "m", f"{total(f'transform(t, p -> ({value}) * (p.i + 1))')} checksum")


@query(f"{_EDGES} SELECT f, m, class, sum((r + CASE category WHEN 2 THEN 2 WHEN 1 THEN 1 WHEN -1 THEN -1 WHEN -2 THEN -2 ELSE 0 END) * (i + 1))::BIGINT AS checksum FROM e GROUP BY ALL")
def edge_offset_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = ", ".join(f"struct({k}L c, {x} dx, {y} dy)" for k, (x, y) in enumerate(_STEPS))
    rows = _tiles(spark, sf_dir).selectExpr("f", "m", "b", "t", f"explode(array({sides})) s")
    sums = let("b", "pic", let("s", "w", total(f"transform(t, p -> (p.r + {_category('w.dx', 'w.dy')}) * (p.i + 1))")))
    return rows.selectExpr("f", "m", "s.c class", f"{sums} checksum")


@query(f"""{_CELLS}, gain AS (SELECT *, 2 * off * err - n * off * off AS gain, CASE WHEN off = 0 THEN 1 ELSE 4 END AS bits FROM offs),
cand AS (SELECT f, m, 0 AS seq, 0 AS gain, 2 AS bits FROM (SELECT DISTINCT f, m FROM offs)
 UNION ALL SELECT g.f, g.m, 1 + s, sum(gain), 7 + 4 - count(*) + sum(bits) FROM gain g, range(0, 29) o(s) WHERE kind = 'band' AND slot BETWEEN s AND s + 3 GROUP BY g.f, g.m, s HAVING max(abs(off)) > 0
 UNION ALL SELECT f, m, 30 + class, sum(gain), 4 + 4 - count(*) + sum(bits) FROM gain WHERE kind = 'edge' GROUP BY f, m, class HAVING max(abs(off)) > 0)
SELECT f, m, arg_min(seq, struct_pack(c := {RATE} * bits - gain, s := seq))::BIGINT AS choice, min({RATE} * bits - gain)::BIGINT AS cost FROM cand GROUP BY f, m""")
def offset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Off, 29 band positions and 4 classes by cost; the error's change follows from counts and sums alone."""
    gain = _offsets(spark, sf_dir).selectExpr("f", "m", "kind", "slot", "class", "off", "2 * off * err - n * off * off gain", "if(off = 0, 1L, 4L) bits")
    # the candidates that a cell counts for: off, and its class, or the positions whose four bands hold it
    seqs = "concat(array(0L), if(kind = 'edge', array(30 + class), transform(sequence(greatest(slot - 3, 0L), least(slot, 28L)), s -> 1 + s)))"
    rows = gain.selectExpr("f", "m", f"explode({seqs}) seq", "gain", "bits", "off")
    head = "case when seq = 0 then 2 else if(seq < 30, 7, 4) + 4 - count(*) + sum(bits) end"
    sums = rows.groupBy("f", "m", "seq").agg(F.expr(f"{RATE} * ({head}) - if(seq = 0, 0, sum(gain)) cost"), F.expr("max(abs(off)) most"))
    best = sums.where("most > 0 or seq = 0").groupBy("f", "m").agg(F.min(F.struct("cost", "seq")).alias("b"))
    return best.selectExpr("f", "m", "b.seq choice", "b.cost cost")


# ---- interpolation ------------------------------------------------------------------------------------------


def _fir(spark: bool, step: int) -> str:
    """Six taps between a pixel and the next along a row (step 1) or column (64), coordinates clamped."""
    div = "div" if spark else "//"
    pos, base = ("(i % 64)", f"(i {div} 64) * 64 + ") if step == 1 else (f"(i {div} 64)", "i % 64 + 64 * ")
    px = (lambda o: f"pic[int({base}least(greatest({pos} + {o}, 0), 63))]") if spark else (lambda o: f"pic[{base}least(greatest({pos} + {o}, 0), 63) + 1]")
    taps = " + ".join(f"{w} * {px(o)}" for w, o in zip((1, -5, 20, 20, -5, 1), range(-2, 4)))
    return f"shiftright({taps} + 16, 5)" if spark else f"(({taps} + 16) >> 5)"


@query(f"WITH {_PICS} SELECT f, i // 64 AS y, sum({_fir(False, 1)} * (i % 64 + 1))::BIGINT AS horizontal, sum({_fir(False, 64)} * (i % 64 + 1))::BIGINT AS vertical FROM pics, range(0, 4096) o(i) GROUP BY ALL")
def halfpel_fir(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pictures(spark, sf_dir).selectExpr("f", "pic", "explode(sequence(0L, 63L)) y")
    sums = [let("pic", "pic", total(f"transform(sequence(y * 64, y * 64 + 63), i -> ({_fir(True, s)}) * (i % 64 + 1))")) for s in (1, 64)]
    return rows.selectExpr("f", "y", f"{sums[0]} horizontal", f"{sums[1]} vertical")


@query(f"WITH {_PICS} SELECT f, i // 64 AS y, sum(((pic[i + 1] + {_fir(False, 1)} + 1) >> 1) * (i % 64 + 1))::BIGINT AS quarter FROM pics, range(0, 4096) o(i) GROUP BY ALL")
def quarterpel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pictures(spark, sf_dir).selectExpr("f", "pic", "explode(sequence(0L, 63L)) y")
    return rows.selectExpr("f", "y", f"{let('pic', 'pic', total(f'transform(sequence(y * 64, y * 64 + 63), i -> shiftright(pic[int(i)] + {_fir(True, 1)} + 1, 1) * (i % 64 + 1))'))} quarter")


@query(f"WITH {_PICS} SELECT f, i // 64 AS y, sum(((pic[i + 1] + {_fir(False, 64)} + 1) >> 1) * (i % 64 + 1))::BIGINT AS quarter FROM pics, range(0, 4096) o(i) GROUP BY ALL")
def quarterpel_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pictures(spark, sf_dir).selectExpr("f", "pic", "explode(sequence(0L, 63L)) y")
    return rows.selectExpr("f", "y", f"{let('pic', 'pic', total(f'transform(sequence(y * 64, y * 64 + 63), i -> shiftright(pic[int(i)] + {_fir(True, 64)} + 1, 1) * (i % 64 + 1))'))} quarter")


@query(f"""WITH {_PICS}, h AS (SELECT f, list({_fir(False, 1)} ORDER BY i) AS pic, any_value(pic) AS whole FROM pics, range(0, 4096) o(i) GROUP BY f)
SELECT f, i // 64 AS y, sum({_fir(False, 64)} * (i % 64 + 1))::BIGINT AS half, sum(((whole[i + 1] + {_fir(False, 64)} + 1) >> 1) * (i % 64 + 1))::BIGINT AS quarter FROM h, range(0, 4096) o(i) GROUP BY ALL""")
def diagonal_fir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half and quarter samples between four: taps along the rows, then along the columns of what they gave."""
    rows = views.pictures(spark, sf_dir).selectExpr("f", "pic whole", f"{let('pic', 'pic', f'transform(sequence(0, 4095), i -> {_fir(True, 1)})')} pic")
    rows = rows.selectExpr("f", "whole", f"{let('pic', 'pic', f'transform(sequence(0, 4095), i -> {_fir(True, 64)})')} both")
    rows = rows.selectExpr("f", "both", "zip_with(whole, both, (w, b) -> shiftright(w + b + 1, 1)) mixed")
    rows = rows.selectExpr("f", "explode(transform(sequence(0, 63), y -> struct(y, slice(both, y * 64 + 1, 64) a, slice(mixed, y * 64 + 1, 64) b))) r")
    return rows.selectExpr("f", "cast(r.y as bigint) y", f"{total('transform(r.a, (v, x) -> v * (x + 1))')} half", f"{total('transform(r.b, (v, x) -> v * (x + 1))')} quarter")


# ---- search -------------------------------------------------------------------------------------------------

_SEARCH = f"""{_BOTH}, mbs AS (SELECT f, a, b, m, (m % 4) * 16 AS px, (m // 4) * 16 AS py FROM pp, range(0, 16) o(m))"""


def _sad_sql(ref: str, x: str, y: str) -> str:
    return f"(SELECT sum(abs(a[(py + j // 16) * 64 + px + j % 16 + 1] - {ref}[({y} + j // 16) * 64 + {x} + j % 16 + 1]))::BIGINT FROM range(0, 256) q(j))"


def _sad(ref: str, x: str, y: str) -> str:
    return total(f"transform(sequence(0, 255), j -> abs(z.a[int((py + j div 16) * 64 + px + j % 16)] - z.{ref}[int(({y} + j div 16) * 64 + {x} + j % 16)]))")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picture_pairs(spark, sf_dir).selectExpr("f", "struct(a, b) z", "explode(sequence(0L, 15L)) m").selectExpr("f", "m", "z", "(m % 4) * 16 px", "(m div 4) * 16 py")


_VECTORS = "mv AS (SELECT DISTINCT f, m, m % 4 AS c, (f * 7 + m * 5) % 9 - 4 AS vx, (f * 3 + m * 11) % 9 - 4 AS vy FROM pix)"


def _median(sql: bool, c: str) -> str:
    div = "//" if sql else "div"
    a, b, d = f"p[1].{c}" if sql else f"get(p, 0).{c}", f"p[2].{c}" if sql else f"get(p, 1).{c}", f"p[3].{c}" if sql else f"get(p, 2).{c}"
    size = "len(p)" if sql else "size(p)"
    return f"CASE {size} WHEN 0 THEN 0 WHEN 1 THEN {a} WHEN 2 THEN ({a} + {b}) {div} 2 ELSE greatest(least({a}, {b}), least(greatest({a}, {b}), {d})) END"


@query(f"""WITH {duck.PIX}, {_VECTORS}, n AS (SELECT v.*, list_filter([CASE WHEN l.m IS NULL THEN NULL ELSE struct_pack(x := l.vx, y := l.vy) END, CASE WHEN t.m IS NULL THEN NULL ELSE struct_pack(x := t.vx, y := t.vy) END, CASE WHEN tr.m IS NOT NULL THEN struct_pack(x := tr.vx, y := tr.vy) WHEN tl.m IS NOT NULL THEN struct_pack(x := tl.vx, y := tl.vy) END], lambda q: q IS NOT NULL) AS s,
  CASE WHEN b.m IS NULL THEN NULL ELSE struct_pack(x := b.vx, y := b.vy) END AS tmp
 FROM mv v LEFT JOIN mv l ON l.f = v.f AND l.m = v.m - 1 AND v.c > 0 LEFT JOIN mv t ON t.f = v.f AND t.m = v.m - 4 LEFT JOIN mv tr ON tr.f = v.f AND tr.m = v.m - 3 AND v.c < 3 LEFT JOIN mv tl ON tl.f = v.f AND tl.m = v.m - 5 AND v.c > 0 LEFT JOIN mv b ON b.f = v.f - 1 AND b.m = v.m),
k AS (SELECT *, CASE WHEN len(s) < 3 AND tmp IS NOT NULL THEN list_append(s, tmp) ELSE s END AS p FROM n)
SELECT f, m, vx - ({_median(True, 'x')}) AS mvd_x, vy - ({_median(True, 'y')}) AS mvd_y FROM k""")
def mv_predictor_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left, top, top-right (else top-left) and, if one lacks, the picture before: five equi-joins on shifted keys."""
    v = views.pictures(spark, sf_dir).selectExpr("f", "explode(sequence(0L, 15L)) m").selectExpr("f", "m", "m % 4 c", "(f * 7 + m * 5) % 9 - 4 vx", "(f * 3 + m * 11) % 9 - 4 vy")
    rows = v
    for name, f, m, where in (("l", "f", "m + 1", "c < 3"), ("t", "f", "m + 4", "true"), ("tr", "f", "m + 3", "c > 0"), ("tl", "f", "m + 5", "c < 3"), ("tmp", "f + 1", "m", "true")):
        rows = rows.join(v.where(where).selectExpr(f"{f} f", f"{m} m", f"struct(vx x, vy y) {name}"), ["f", "m"], "left")
    rows = rows.selectExpr("f", "m", "vx", "vy", "tmp", "filter(array(l, t, coalesce(tr, tl)), q -> q is not null) s")
    rows = rows.selectExpr("f", "m", "vx", "vy", "if(size(s) < 3 and tmp is not null, concat(s, array(tmp)), s) p")
    return rows.selectExpr("f", "m", f"vx - ({_median(False, 'x')}) mvd_x", f"vy - ({_median(False, 'y')}) mvd_y")
