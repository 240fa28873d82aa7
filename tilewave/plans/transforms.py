"""Queries on transforms, quantization, scans and coefficient coding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewave.functions import exprs, tables
from tilewave.operators import quantize, transform, views
from tilewave.plans import duck
from tilewave.plans.registry import query

QP = 8
#: Rate weight of the trimming query, fixed so that both engines compare the same numbers.
LAMBDA = 4


def _long(df: DataFrame, value: str, name: str, *keys: str) -> DataFrame:
    return df.selectExpr(*keys, f"posexplode({value}) as (k, {name})").selectExpr(*keys, "cast(k as bigint) k", name)


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.forward(views.blocks8(spark, sf_dir), "s", "coef")


@query(f"WITH {duck.BLK8}, {duck.dct8()} SELECT vec_id, k, coef FROM dct")
def dct8_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(coefficients(spark, sf_dir), "coef", "coef", "vec_id")


@query(f"WITH {duck.BLK8}, {duck.dct8()} SELECT label, count(*)::BIGINT AS n, sum(coef)::BIGINT AS sum_c, sum(abs(coef))::BIGINT AS sum_abs, count(*) FILTER (abs(coef) >= 16)::BIGINT AS large, sum(coef * (k + 1))::BIGINT AS checksum FROM dct GROUP BY label")
def dct_energy_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_block = coefficients(spark, sf_dir).selectExpr(
        "label", f"{exprs.total('coef')} c", f"{exprs.total('transform(coef, x -> abs(x))')} a", "size(filter(coef, x -> abs(x) >= 16)) l", f"{exprs.total('transform(coef, (x, k) -> x * (k + 1))')} p"
    )
    return per_block.groupBy("label").agg({"*": "count", "c": "sum", "a": "sum", "l": "sum", "p": "sum"}).selectExpr("label", "`count(1)` * 64 n", "`sum(c)` sum_c", "`sum(a)` sum_abs", "`sum(l)` large", "`sum(p)` checksum")


@query(f"WITH {duck.BLK8}, {duck.dct8()}, {duck.idct8('dct', 'coef')} SELECT vec_id, sum(abs(rec - s))::BIGINT AS err, max(abs(rec - s))::BIGINT AS worst FROM idct JOIN blk8 USING (vec_id, k) GROUP BY vec_id")
def dct8_roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = transform.inverse(coefficients(spark, sf_dir), "coef", "rec")
    return back.selectExpr("vec_id", "zip_with(rec, s, (a, b) -> abs(a - b)) d").selectExpr("vec_id", f"{exprs.total('d')} err", "array_max(d) worst")


_DCT4 = f"""{duck.basis(4)},
t4 AS (SELECT vec_id, (r // 4) * 2 + c // 4 AS q, r % 4 AS r, c % 4 AS c, s FROM blk8),
h4 AS (SELECT vec_id, q, r, j AS u, {duck.rdiv("CASE WHEN j = 0 THEN t >> 1 ELSE (t * 2896) >> 12 END", "128")} AS s
       FROM (SELECT vec_id, q, r, j, sum(s * w)::BIGINT AS t FROM t4 JOIN basis ON c = i GROUP BY ALL)),
d4 AS (SELECT vec_id, q, j * 4 + u AS k, j AS r, u AS c, {duck.rdiv("CASE WHEN j = 0 THEN t >> 1 ELSE (t * 2896) >> 12 END", "128")} AS coef
       FROM (SELECT vec_id, q, u, j, sum(s * w)::BIGINT AS t FROM h4 JOIN basis ON r = i GROUP BY ALL))"""


def _tiles4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.blocks8(spark, sf_dir).selectExpr("vec_id", "s", "explode(sequence(0, 3)) q")
    return rows.selectExpr("vec_id", "cast(q as bigint) q", f"{transform.quadrant('s', 'q', 8, 4)} t")


@query(f"WITH {duck.BLK8}, {_DCT4} SELECT vec_id, q, k, coef FROM d4")
def dct4_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(transform.forward(_tiles4(spark, sf_dir), "t", "coef", 4), "coef", "coef", "vec_id", "q")


@query(f"""WITH {duck.BLK8}, {_DCT4},
i4 AS (SELECT vec_id, q, i AS r, c, {duck.rdiv("t", "128")} AS x FROM (
  SELECT vec_id, q, i, c, sum(CASE WHEN j = 0 THEN (coef * w) >> 1 ELSE (coef * w * 2896) >> 12 END)::BIGINT AS t FROM d4 JOIN basis ON r = j GROUP BY ALL)),
o4 AS (SELECT vec_id, q, r, i AS c, {duck.rdiv("t", "128")} AS rec FROM (
  SELECT vec_id, q, r, i, sum(CASE WHEN j = 0 THEN (x * w) >> 1 ELSE (x * w * 2896) >> 12 END)::BIGINT AS t FROM i4 JOIN basis ON c = j GROUP BY ALL))
SELECT vec_id, q, sum(abs(rec - s))::BIGINT AS err FROM o4 JOIN t4 USING (vec_id, q, r, c) GROUP BY ALL""")
def dct4_roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = transform.inverse(transform.forward(_tiles4(spark, sf_dir), "t", "coef", 4), "coef", "rec", 4)
    return back.selectExpr("vec_id", "q", f"{exprs.total('zip_with(rec, t, (a, b) -> abs(a - b))')} err")


@query(f"""WITH {duck.PIX}, tile AS (SELECT (f * 16 + m) * 4 + ((y % 16) // 8) * 2 + (x % 16) // 8 AS vec_id, f * 16 + m AS label, y % 8 AS r, x % 8 AS c, p AS s FROM pix),
{duck.dct8('tile')} SELECT label // 16 AS f, label % 16 AS m, vec_id % 4 AS q, k, coef FROM dct""")
def dct16_as_four_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.macroblocks(spark, sf_dir).selectExpr("f", "m", "y", "explode(sequence(0, 3)) q").selectExpr("f", "m", "cast(q as bigint) q", f"{transform.quadrant('y', 'q')} s")
    return _long(transform.forward(rows, "s", "coef"), "coef", "coef", "f", "m", "q")


@query(f"""WITH {duck.BLK8}, a AS (SELECT vec_id, (r // 4) * 2 + c // 4 AS q, (r % 4) * 4 + c % 4 AS t, s FROM blk8)
SELECT vec_id, q, i AS k, sum(s * CASE WHEN bit_count((i // 4) & (t // 4)) % 2 = 0 THEN 1 ELSE -1 END * CASE WHEN bit_count((i % 4) & (t % 4)) % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS h
FROM a, range(0, 16) o(i) GROUP BY ALL""")
def hadamard4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_tiles4(spark, sf_dir).selectExpr("vec_id", "q", f"{transform.hadamard4('t')} h"), "h", "h", "vec_id", "q")


def _quant_sql(kind: str, qp: int) -> str:
    """CTE lv(vec_id, label, k, r, c, coef, level)."""
    if kind == "intra":
        f = duck.rdiv("coef * 16", "q.v")
        dead = f"((sign(f) * {qp} * w.v)::BIGINT >> 1)" if qp >= 16 else "0"
        level = f"CASE WHEN d.k = 0 THEN {duck.rdiv('coef', str(quantize.luma_dc_scale(qp)))} ELSE {duck.rdiv(f'f - {dead}', str(2 * qp))} END"
        qm, wt = tables.INTRA_MATRIX, tables.INTRA_DEADZONE
    else:
        f = duck.rdiv("coef * 16", "q.v")
        level = duck.rdiv(f"f - ((sign(f) * {qp} * w.v)::BIGINT >> 1)", str(2 * qp))
        qm, wt = tables.INTER_MATRIX, [min(w + 1, 6) if qp >= 16 else w for w in tables.INTER_DEADZONE]
    return f"""{duck.const('qm', qm)}, {duck.const('dead', wt)},
lv AS (SELECT d.vec_id, d.label, d.k, d.r, d.c, d.coef, ({level})::BIGINT AS level
       FROM (SELECT dct.*, {f} AS f FROM dct JOIN qm q USING (k)) d JOIN dead w USING (k))"""


def levels(spark: SparkSession, sf_dir: str, kind: str = "intra", qp: int = QP) -> DataFrame:
    """Blocks with coef and level arrays."""
    rows = coefficients(spark, sf_dir)
    level = quantize.intra("coef", qp, quantize.luma_dc_scale(qp)) if kind == "intra" else quantize.inter("coef", qp)
    return rows.selectExpr("*", f"{level} level")


_LV = f"WITH {duck.BLK8}, {duck.dct8()}, {_quant_sql('intra', QP)}"


@query(f"{_LV} SELECT vec_id, k, level FROM lv")
def quantize_intra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(levels(spark, sf_dir), "level", "level", "vec_id")


@query(f"WITH {duck.BLK8}, {duck.dct8()}, {_quant_sql('intra', 20)} SELECT vec_id, k, level FROM lv")
def quantize_intra_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(levels(spark, sf_dir, "intra", 20), "level", "level", "vec_id")


@query(f"WITH {duck.BLK8}, {duck.dct8()}, {_quant_sql('inter', QP)} SELECT vec_id, k, level FROM lv")
def quantize_inter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(levels(spark, sf_dir, "inter"), "level", "level", "vec_id")


@query(f"WITH {duck.BLK8}, {duck.dct8()}, {_quant_sql('inter', 20)} SELECT vec_id, k, level FROM lv")
def quantize_inter_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(levels(spark, sf_dir, "inter", 20), "level", "level", "vec_id")


@query(f"WITH {duck.BLK8}, {duck.dct8()} SELECT vec_id, k, (CASE WHEN k = 0 THEN {duck.rdiv('coef', str(quantize.chroma_dc_scale(QP)))} ELSE {duck.rdiv('coef', str(2 * QP))} END)::BIGINT AS intra_level, (sign(coef) * {duck.rdiv(f'abs(coef) - {QP >> 1}', str(2 * QP))})::BIGINT AS inter_level FROM dct")
def quantize_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coefficients(spark, sf_dir).selectExpr("vec_id", f"arrays_zip({quantize.linear('coef', QP, quantize.chroma_dc_scale(QP))}, {quantize.linear('coef', QP, None)}) z")
    return rows.selectExpr("vec_id", "posexplode(z) as (k, z)").selectExpr("vec_id", "cast(k as bigint) k", "z.`0` intra_level", "z.`1` inter_level")


_DEQ = f"{_LV}, dq AS (SELECT vec_id, label, k, r, c, level, CASE WHEN k = 0 THEN level * {quantize.luma_dc_scale(QP)} ELSE 2 * level * v * {QP} // 16 END AS deq, coef FROM lv JOIN qm USING (k))"


@query(f"{_DEQ} SELECT vec_id, sum(abs(deq - coef))::BIGINT AS err, max(abs(deq - coef))::BIGINT AS worst, count(*) FILTER (level = 0)::BIGINT AS zeros FROM dq GROUP BY vec_id")
def dequantize_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = levels(spark, sf_dir).selectExpr("vec_id", "level", "coef", f"{quantize.dequantize('level', QP, tables.INTRA_MATRIX, quantize.luma_dc_scale(QP))} deq")
    return rows.selectExpr("vec_id", "level", "zip_with(deq, coef, (a, b) -> abs(a - b)) d").selectExpr("vec_id", f"{exprs.total('d')} err", "array_max(d) worst", "cast(size(filter(level, x -> x = 0)) as bigint) zeros")


_CQP = quantize.chroma_qp(QP)
_PLANES = f"""CASE WHEN vec_id % 6 < 4 THEN {QP} ELSE {_CQP} END AS qp, CASE WHEN vec_id % 6 < 4 THEN {quantize.luma_dc_scale(QP)} ELSE {quantize.chroma_dc_scale(_CQP)} END AS scale"""


@query(f"""WITH {duck.BLK8}, {duck.dct8()}, {duck.const('qi', tables.INTRA_MATRIX)}, {duck.const('qn', tables.INTER_MATRIX)}, {duck.const('dead', tables.INTER_DEADZONE)},
p AS (SELECT vec_id, k, coef, vec_id // 6 % 2 = 0 AS intra, {_PLANES} FROM dct),
f AS (SELECT p.*, CASE WHEN intra THEN qi.v ELSE qn.v END AS v, w.v AS w, CASE WHEN intra THEN {duck.rdiv('coef * 16', 'qi.v')} ELSE {duck.rdiv('coef * 16', 'qn.v')} END AS f FROM p JOIN qi USING (k) JOIN qn USING (k) JOIN dead w USING (k)),
l AS (SELECT *, CASE WHEN intra AND k = 0 THEN {duck.rdiv('coef', 'scale')} WHEN intra THEN {duck.rdiv('f', '(2 * qp)')} ELSE {duck.rdiv('f - ((sign(f) * qp * w)::BIGINT >> 1)', '(2 * qp)')} END AS level FROM f)
SELECT vec_id, k, level::BIGINT AS level, (CASE WHEN intra AND k = 0 THEN level * scale ELSE 2 * level * v * qp // 16 END)::BIGINT AS deq FROM l""")
def quantize_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels and their inverse by block type and plane: six 8x8 blocks, four of luma and two of chroma at a coarser step, are one
    block, and every other one is intra."""

    def pick(luma: str, chroma: str) -> str:
        return f"if(vec_id % 6 < 4, {luma}, {chroma})"

    luma, chroma = quantize.luma_dc_scale(QP), quantize.chroma_dc_scale(_CQP)
    intra = pick(quantize.intra("coef", QP, luma), quantize.intra("coef", _CQP, chroma))
    rows = coefficients(spark, sf_dir).selectExpr("vec_id", f"if(vec_id div 6 % 2 = 0, {intra}, {pick(quantize.inter('coef', QP), quantize.inter('coef', _CQP))}) level")
    back = [pick(quantize.dequantize("level", QP, m, a), quantize.dequantize("level", _CQP, m, b)) for m, a, b in ((tables.INTRA_MATRIX, luma, chroma), (tables.INTER_MATRIX, None, None))]
    rows = rows.selectExpr("vec_id", "level", f"if(vec_id div 6 % 2 = 0, {back[0]}, {back[1]}) deq")
    return rows.selectExpr("vec_id", "posexplode(arrays_zip(level, deq)) as (k, z)").selectExpr("vec_id", "cast(k as bigint) k", "z.level", "z.deq")


@query("SELECT qp, count(*)::BIGINT AS n, (CASE WHEN qp < 9 THEN greatest(2 * qp, 2) WHEN qp < 25 THEN qp + 8 ELSE 2 * qp - 16 END)::BIGINT AS luma, (CASE WHEN qp < 5 THEN greatest(2 * qp, 2) WHEN qp < 25 THEN (qp + 13) >> 1 ELSE qp - 6 END)::BIGINT AS chroma FROM (SELECT 1 + l_partkey % 63 AS qp FROM lineitem) GROUP BY qp")
def dc_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales of the quantizers that lines ask for, and how many ask."""
    qp = views.table(spark, sf_dir, "lineitem").selectExpr("1 + l_partkey % 63 qp").groupBy("qp").agg(F.count("*").alias("n"))
    luma = "case when qp < 9 then greatest(2 * qp, 2L) when qp < 25 then qp + 8 else 2 * qp - 16 end luma"
    return qp.selectExpr("qp", "n", luma, "case when qp < 5 then greatest(2 * qp, 2L) when qp < 25 then shiftright(qp + 13, 1) else qp - 6 end chroma")


@query("SELECT q AS quality, n, least(CASE WHEN c <= 16 THEN c ELSE c + (c - 16) * (c - 16) // 10 END, 63)::BIGINT AS qp, round(0.85 * pow(2, (c - 12) / 3.0), 6) AS weight, (q >> 2) + 1 AS copy_limit, round(0.02 * pow(2, least(q, 31) / 3.0), 6) AS audio_step FROM (SELECT q, least(greatest(q, 1), 31) AS c, n FROM (SELECT l_quantity::BIGINT - 1 AS q, count(*)::BIGINT AS n FROM lineitem GROUP BY 1))")
def quality_to_qp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the qualities that lines ask for, from 0 on, stand for, and how many ask."""
    rows = views.table(spark, sf_dir, "lineitem").selectExpr("cast(l_quantity as bigint) - 1 quality").groupBy("quality").agg(F.count("*").alias("n")).selectExpr("quality", "n", f"{exprs.clip('quality', '1L', '31L')} c")
    return rows.selectExpr("quality", "n", f"{quantize.quality_to_qp('quality')} qp", f"round({quantize.quality_lambda('c')}, 6) weight", "shiftright(quality, 2) + 1 copy_limit", "round(0.02D * pow(2D, least(quality, 31) / 3D), 6) audio_step")


def _variance2_sql(value: str = "s", cond: str = "k <> 0") -> str:
    s, n = f"sum({value}) FILTER ({cond} AND {value} <> 0)::BIGINT", f"count(*) FILTER ({cond} AND {value} <> 0)::BIGINT"
    return f"coalesce(sum({value} * {value}) FILTER ({cond})::BIGINT - {duck.rdiv(f'({s}) * ({s})', f'greatest({n}, 1)')}, 0)"


@query(f"""WITH {duck.BLK8}, v AS (SELECT vec_id, {_variance2_sql()} AS variance FROM blk8 GROUP BY vec_id),
i AS (SELECT *, least(greatest((CASE WHEN variance > 0 THEN {duck.bitlen('variance')} - 1 ELSE 0 END) // 2, 1), 63) AS idx FROM v)
SELECT vec_id, variance, least(greatest({QP} + least(greatest((idx - {QP}) >> 1, -6), 6), 1), 63)::BIGINT AS qp FROM i""")
def adaptive_qp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.blocks8(spark, sf_dir).selectExpr("vec_id", "filter(slice(s, 2, 63), x -> x != 0) a")
    rows = rows.selectExpr("vec_id", f"{exprs.total('a')} t", f"{exprs.total('transform(a, x -> x * x)')} q", "cast(size(a) as bigint) n")
    rows = rows.selectExpr("vec_id", f"case when n = 0 then 0L else q - {exprs.rdiv('t * t', 'greatest(n, 1L)')} end variance")
    return rows.selectExpr("vec_id", "variance", f"{quantize.adaptive_qp('variance', QP)} qp")


@query(f"{_LV}, {duck.ZIGZAG} SELECT vec_id, z.k AS pos, level FROM lv JOIN zigzag z ON lv.k = z.v")
def zigzag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir).selectExpr("vec_id", "posexplode(z) as (pos, level)").selectExpr("vec_id", "cast(pos as bigint) pos", "level")


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, level, z: levels in scan order."""
    return levels(spark, sf_dir).selectExpr("vec_id", "label", "level", f"{exprs.let('level', 'a', f'transform({exprs.array(tables.ZIGZAG8)}, p -> a[int(p)])')} z")


@query(f"""{_LV}, {duck.ZIGZAG}, {duck.const('vscan', tables.VERTICAL8)}, m AS (SELECT *, vec_id % 8 AS mode FROM lv)
SELECT vec_id, mode, sum(level * (CASE WHEN mode IN (1, 5) THEN m.k WHEN mode IN (2, 6) THEN vs.k ELSE z.k END + 1))::BIGINT AS checksum
FROM m JOIN zigzag z ON z.v = m.k JOIN vscan vs ON vs.v = m.k GROUP BY ALL""")
def scan_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = f"case when mode in (1, 5) then {exprs.array(tables.HORIZONTAL8)} when mode in (2, 6) then {exprs.array(tables.VERTICAL8)} else {exprs.array(tables.ZIGZAG8)} end"
    rows = levels(spark, sf_dir).selectExpr("vec_id", "level", "vec_id % 8 mode").selectExpr("vec_id", "mode", "level", f"{scan} scan")
    return rows.selectExpr("vec_id", "mode", f"{exprs.let('level', 'a', exprs.total('transform(scan, (p, i) -> a[int(p)] * (i + 1))'))} checksum")


_Z = f"{_LV}, {duck.ZIGZAG}, zz AS (SELECT vec_id, label, z.k AS pos, level FROM lv JOIN zigzag z ON lv.k = z.v)"


@query(f"{_Z} SELECT vec_id, coalesce(max(pos) FILTER (level <> 0), -1)::BIGINT AS last, count(*) FILTER (level <> 0)::BIGINT AS n FROM zz GROUP BY vec_id")
def last_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = "transform(filter(transform(z, (x, i) -> struct(x, i)), p -> p.x != 0), p -> cast(p.i as bigint))"
    return scanned(spark, sf_dir).selectExpr("vec_id", f"{places} a").selectExpr("vec_id", "coalesce(array_max(a), -1L) last", "cast(size(a) as bigint) n")


@query(f"""{_Z}, nz AS (SELECT vec_id, pos, level, lag(pos, 1, -1) OVER (PARTITION BY vec_id ORDER BY pos) AS prev FROM zz WHERE level <> 0)
SELECT vec_id, pos, pos - prev - 1 AS run, abs(level) - 1 AS rest, (level < 0)::INT::BIGINT AS neg FROM nz""")
def zero_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = "filter(transform(z, (x, i) -> struct(x, cast(i as bigint) i)), p -> p.x != 0)"
    rows = scanned(spark, sf_dir).selectExpr("vec_id", f"{places} a")
    runs = "transform(a, (p, j) -> struct(p.i pos, p.i - coalesce(get(a, j - 1).i, -1L) - 1 run, abs(p.x) - 1 rest, if(p.x < 0, 1L, 0L) neg))"
    return rows.selectExpr("vec_id", f"inline({runs})")


@query(f"""{_Z}, l AS (SELECT zz.*, max(pos) FILTER (level <> 0) OVER (PARTITION BY vec_id) AS last FROM zz),
s AS (SELECT *, coalesce(max((abs(level) > 1)::INT) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen,
 CASE WHEN pos = 0 THEN 0 WHEN pos <= 10 THEN 1 WHEN pos <= 40 THEN 2 ELSE 3 END AS grp FROM l)
SELECT vec_id, pos, 'sig' AS token, pos AS context, (level <> 0)::INT::BIGINT AS value FROM s WHERE pos < last
UNION ALL SELECT vec_id, pos, 'gt1', 68 + 2 * grp + seen, (abs(level) > 1)::INT FROM s WHERE level <> 0
UNION ALL SELECT vec_id, pos, 'gt2', 76 + 2 * grp + seen, (abs(level) > 2)::INT FROM s WHERE abs(level) > 1
UNION ALL SELECT vec_id, pos, 'rest', 84 + grp, abs(level) - 3 FROM s WHERE abs(level) > 2
UNION ALL SELECT vec_id, pos, 'sign', -1, (level < 0)::INT FROM s WHERE level <> 0
UNION ALL SELECT vec_id, -1, 'last', 64, coalesce(max(pos) FILTER (level <> 0), -1) + 1 FROM zz GROUP BY vec_id""")
def sigmap_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(spark, sf_dir).selectExpr("vec_id", "z", "coalesce(array_max(transform(filter(transform(z, (x, i) -> struct(x, i)), p -> p.x != 0), p -> p.i)), -1) last")
    big = "coalesce(array_min(transform(filter(transform(z, (x, i) -> struct(x, i)), p -> abs(p.x) > 1), p -> p.i)), 64)"
    rows = rows.selectExpr("vec_id", "z", "last", f"{big} big")
    group = "case when i = 0 then 0 when i <= 10 then 1 when i <= 40 then 2 else 3 end"
    seen = "if(big < i, 1, 0)"

    def token(name: str, context: str, value: str, when: str) -> str:
        return f"if({when}, array(struct(cast(i as bigint) pos, '{name}' token, cast({context} as bigint) context, cast({value} as bigint) value)), array())"

    parts = ", ".join(
        [
            token("sig", "i", "if(x != 0, 1, 0)", "i < last"),
            token("gt1", f"68 + 2 * ({group}) + {seen}", "if(abs(x) > 1, 1, 0)", "x != 0"),
            token("gt2", f"76 + 2 * ({group}) + {seen}", "if(abs(x) > 2, 1, 0)", "abs(x) > 1"),
            token("rest", f"84 + ({group})", "abs(x) - 3", "abs(x) > 2"),
            token("sign", "-1", "if(x < 0, 1, 0)", "x != 0"),
        ]
    )
    head = "array(struct(-1L pos, 'last' token, 64L context, cast(last + 1 as bigint) value))"
    return rows.selectExpr("vec_id", f"inline(concat({head}, flatten(transform(z, (x, i) -> concat({parts})))))")


@query(f"""{_Z}, l AS (SELECT zz.*, max(pos) FILTER (level <> 0) OVER (PARTITION BY vec_id) AS last FROM zz)
SELECT vec_id, pos, (coalesce(max((abs(level) > 1)::INT) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS seen FROM l""")
def gt1_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = "coalesce(array_min(transform(filter(transform(z, (x, i) -> struct(x, i)), p -> abs(p.x) > 1), p -> p.i)), 64)"
    rows = scanned(spark, sf_dir).selectExpr("vec_id", f"{exprs.let(big, 'big', 'transform(sequence(0, 63), i -> if(big < i, 1L, 0L))')} a")
    return rows.selectExpr("vec_id", "posexplode(a) as (pos, seen)").selectExpr("vec_id", "cast(pos as bigint) pos", "seen")


def _bits_sql(v: str) -> str:
    a = f"least(abs({v}), 255)"
    return f"CASE WHEN {a} = 0 THEN 1 WHEN {a} = 1 THEN 3 WHEN {a} = 2 THEN 4 ELSE 4 + 2 * {duck.bitlen(f'greatest({a} - 2, 1)')} END"


@query(f"{_LV} SELECT vec_id, label, sum({_bits_sql('level')})::BIGINT AS bits, count(*) FILTER (level <> 0)::BIGINT AS n FROM lv GROUP BY ALL")
def coefficient_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = exprs.total(f"transform(level, v -> {quantize.coefficient_bits('v')})")
    return levels(spark, sf_dir).selectExpr("vec_id", "label", f"{bits} bits", "cast(size(filter(level, v -> v != 0)) as bigint) n")


@query(f"""{_DEQ}, {duck.ZIGZAG},
t AS (SELECT dq.*, z.k AS pos, qm.v AS qmv, (coef - deq) * (coef - deq) + {LAMBDA} * {_bits_sql('level')} AS keep, coef * coef + {LAMBDA} AS zero FROM dq JOIN zigzag z ON z.v = dq.k JOIN qm ON qm.k = dq.k),
p1 AS (SELECT *, CASE WHEN pos > 0 AND min(CASE WHEN level = 0 OR zero <= keep THEN 1 ELSE 0 END) FILTER (pos > 0) OVER (PARTITION BY vec_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) = 1 THEN 0 ELSE level END AS l1 FROM t),
p2 AS (SELECT *, l1 - sign(l1)::BIGINT AS low FROM p1)
SELECT vec_id, pos, (CASE WHEN pos > 0 AND l1 <> 0 AND (coef - 2 * low * qmv * {QP} // 16) * (coef - 2 * low * qmv * {QP} // 16) + {LAMBDA} * {_bits_sql('low')} < keep THEN low ELSE l1 END)::BIGINT AS level FROM p2""")
def rd_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    zig = exprs.array(tables.ZIGZAG8)
    inv = f"2 * {{l}} * {exprs.array(tables.INTRA_MATRIX)}[int(p)] * {QP} div 16"
    cost = f"(coef[int(p)] - {{d}}) * (coef[int(p)] - {{d}}) + {LAMBDA} * {{b}}"
    keep = cost.format(d=f"(if(p = 0, level[0] * {quantize.luma_dc_scale(QP)}, {inv.format(l='level[int(p)]')}))", b=quantize.coefficient_bits("level[int(p)]"))
    rows = levels(spark, sf_dir).selectExpr("vec_id", "level", "coef", f"transform({zig}, p -> struct(p, level[int(p)] l, coef[int(p)] * coef[int(p)] + {LAMBDA} zero, {keep} keep)) z")
    # the last place, from 1 on, whose level is worth keeping
    stop = "coalesce(array_max(transform(filter(transform(z, (s, i) -> struct(s, i)), t -> t.i > 0 and t.s.l != 0 and t.s.zero > t.s.keep), t -> t.i)), 0)"
    rows = rows.selectExpr("vec_id", "coef", "z", f"{stop} stop").selectExpr("vec_id", "coef", f"{exprs.let('stop', 'last', 'transform(z, (s, i) -> struct(s.p, if(i > last, 0L, s.l) l, s.keep))')} z")
    low = "s.l - cast(sign(s.l) as bigint)"
    low_cost = f"transform(array(struct(s.p p, {low} l)), u -> {cost.replace('(p)', '(u.p)').format(d='(' + inv.replace('(p)', '(u.p)').format(l='u.l') + ')', b=quantize.coefficient_bits('u.l'))})[0]"
    return rows.selectExpr("vec_id", f"posexplode(transform(z, (s, i) -> if(i > 0 and s.l != 0 and {low_cost} < s.keep, {low}, s.l))) as (pos, level)").selectExpr("vec_id", "cast(pos as bigint) pos", "level")


@query(f"""{_DEQ}, {duck.idct8('dq', 'deq')}, {duck.const('one', [0])}
SELECT label, count(DISTINCT vec_id)::BIGINT AS blocks, sum((rec - s) * (rec - s))::BIGINT AS ssd,
 CASE WHEN sum((rec - s) * (rec - s)) = 0 THEN 100.0 ELSE round(10 * log10(1024.0 * 1024.0 / (sum((rec - s) * (rec - s)) / count(*))), 4) END AS psnr
FROM idct JOIN blk8 USING (vec_id, k) GROUP BY label""")
def rate_distortion_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: transform, quantize, and back, with the error by label."""
    rows = levels(spark, sf_dir).selectExpr("label", "s", f"{quantize.dequantize('level', QP, tables.INTRA_MATRIX, quantize.luma_dc_scale(QP))} deq")
    rows = transform.inverse(rows, "deq", "rec").selectExpr("label", f"{exprs.total('zip_with(rec, s, (a, b) -> (a - b) * (a - b))')} e")
    sums = rows.groupBy("label").agg({"e": "sum", "*": "count"}).selectExpr("label", "`count(1)` blocks", "`sum(e)` ssd")
    return sums.selectExpr("label", "blocks", "ssd", "case when ssd = 0 then 100D else round(10 * log10(1024D * 1024D / (ssd / (blocks * 64))), 4) end psnr")
