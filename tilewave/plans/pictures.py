"""Queries on pictures: colour, tiles, block metrics, prediction, filters and search. Open loop: predictions read source pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewave.functions import exprs, tables
from tilewave.functions.exprs import let, rdiv, total
from tilewave.operators import transform, views
from tilewave.plans import duck
from tilewave.plans.registry import query

# ---- colour -------------------------------------------------------------------------------------------------

_Y = "((77 * r + 150 * gr + 29 * b + 128) >> 8) + 16"
_U, _V = "(-43 * r - 85 * gr + 128 * b + 128) // 256 + 128", "(128 * r - 107 * gr - 21 * b + 128) // 256 + 128"


def _yuv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, t: 64 structs of r, gr, b, y, u, v."""
    pixel = "named_struct('r', r, 'gr', gr, 'b', b, 'y', shiftright(77 * r + 150 * gr + 29 * b + 128, 8) + 16, 'u', (-43 * r - 85 * gr + 128 * b + 128) div 256 + 128, 'v', (128 * r - 107 * gr - 21 * b + 128) div 256 + 128)"
    for c in ("r", "gr", "b"):
        pixel = pixel.replace(f" {c} ", f" z.{c} ").replace(f", {c},", f", z.{c},")
    return views.rgb_tiles(spark, sf_dir).selectExpr("g", f"transform(arrays_zip(r, gr, b), z -> {pixel}) t")


@query(f"WITH {duck.RGB} SELECT g, k, {_Y} AS y, {_U} AS u, {_V} AS v FROM rgb")
def rgb_to_yuv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _yuv(spark, sf_dir).selectExpr("g", "posexplode(t) as (k, p)").selectExpr("g", "cast(k as bigint) k", "p.y", "p.u", "p.v")


def _back(y: str, u: str, v: str, shift: str) -> list[str]:
    sums = [f"256 * ({y} - 16) + 358 * ({v} - 128) + 128", f"256 * ({y} - 16) - 88 * ({u} - 128) - 182 * ({v} - 128) + 128", f"256 * ({y} - 16) + 452 * ({u} - 128) + 128"]
    return [f"least(greatest({shift.format(x=s)}, 0), 255)" for s in sums]


_BACK = _back("y", "u", "v", "(({x}) >> 8)")


@query(f"WITH {duck.RGB}, c AS (SELECT *, {_Y} AS y, {_U} AS u, {_V} AS v FROM rgb) SELECT g, sum(abs({_BACK[0]} - r))::BIGINT AS err_r, sum(abs({_BACK[1]} - gr))::BIGINT AS err_g, sum(abs({_BACK[2]} - b))::BIGINT AS err_b FROM c GROUP BY g")
def yuv_to_rgb_roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _back("p.y", "p.u", "p.v", "shiftright({x}, 8)")
    errs = [f"{total(f'transform(t, p -> abs({e} - p.{c}))')} err_{n}" for e, c, n in zip(back, ("r", "gr", "b"), "rgb")]
    return _yuv(spark, sf_dir).selectExpr("g", *errs)


_CELL = "((k // 8) // 2) * 4 + (k % 8) // 2"


@query(f"WITH {duck.RGB}, c AS (SELECT g, {_CELL} AS q, {_U} AS u, {_V} AS v FROM rgb) SELECT g, q, (sum(u)::BIGINT + 2) >> 2 AS u, (sum(v)::BIGINT + 2) >> 2 AS v FROM c GROUP BY g, q")
def chroma_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = "int((q div 4) * 16 + (q % 4) * 2 + {d})"
    mean = "shiftright(" + " + ".join(f"t[{at.format(d=d)}].{{c}}" for d in (0, 1, 8, 9)) + " + 2, 2)"
    return _yuv(spark, sf_dir).selectExpr("g", "t", "explode(sequence(0, 15)) q").selectExpr("g", "cast(q as bigint) q", f"{mean.format(c='u')} u", f"{mean.format(c='v')} v")


@query(f"WITH {duck.RGB}, c AS (SELECT *, {_CELL} AS q, {_Y} AS y, {_U} AS u0, {_V} AS v0 FROM rgb), s AS (SELECT g, q, (sum(u0)::BIGINT + 2) >> 2 AS u, (sum(v0)::BIGINT + 2) >> 2 AS v FROM c GROUP BY g, q) SELECT g, k, {_BACK[0]} AS r, {_BACK[1]} AS gr, {_BACK[2]} AS b FROM (SELECT g, q, k, y FROM c) c JOIN s USING (g, q)")
def chroma_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = "int(((k div 8) div 2) * 16 + ((k % 8) div 2) * 2 + {d})"
    mean = "shiftright(" + " + ".join(f"t[{at.format(d=d)}].{{c}}" for d in (0, 1, 8, 9)) + " + 2, 2)"
    rows = _yuv(spark, sf_dir).selectExpr("g", "t", "explode(sequence(0, 63)) k").selectExpr("g", "cast(k as bigint) k", "t[k].y y", f"{mean.format(c='u')} u", f"{mean.format(c='v')} v")
    r, g, b = _back("y", "u", "v", "shiftright({x}, 8)")
    return rows.selectExpr("g", "k", f"{r} r", f"{g} gr", f"{b} b")


# ---- tiles and blocks ---------------------------------------------------------------------------------------


@query(f"WITH {duck.PIX} SELECT f, m, count(*)::BIGINT AS n, sum(p)::BIGINT AS total, sum(p * ((y % 16) * 16 + x % 16 + 1))::BIGINT AS checksum FROM pix GROUP BY f, m")
def tile_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.macroblocks(spark, sf_dir).selectExpr("f", "m", "cast(size(y) as bigint) n", f"{total('y')} total", f"{total('transform(y, (p, i) -> p * (i + 1))')} checksum")


@query("SELECT p_partkey, n, ((n + 15) // 16) * 16 AS align16, ((n + 7) // 8) * 8 AS align8, ((n + 2) // 3) * 3 AS multiple3, (n > 0 AND (n & (n - 1)) = 0)::INT::BIGINT AS is_pow2, CASE WHEN n <= 1 THEN n ELSE pow(2, ceil(log2(n)))::BIGINT END AS next_pow2 FROM (SELECT p_partkey, p_size * (p_partkey % 7) AS n FROM part)")
def align_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of parts, up to 300, padded to whole blocks and powers of two."""
    rows = views.table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size * (p_partkey % 7) n")
    power = f"case when n <= 1 then n else shiftleft(1L, int({exprs.bit_length('n - 1')})) end next_pow2"
    return rows.selectExpr("p_partkey", "n", "((n + 15) div 16) * 16 align16", "((n + 7) div 8) * 8 align8", "((n + 2) div 3) * 3 multiple3", "if(n > 0 and (n & (n - 1)) = 0, 1L, 0L) is_pow2", power)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, m, a, b: a block and the one at its place in the picture before."""
    now = views.macroblocks(spark, sf_dir)
    before = now.selectExpr("f + 1 f", "m", "y b")
    return now.selectExpr("f", "m", "mx", "my", "y a").join(before, ["f", "m"])


_PAIR = f"WITH {duck.PIX}, pr AS (SELECT a.f, a.m, a.x, a.y, (a.y % 16) * 16 + a.x % 16 AS k, a.p AS a, b.p AS b, a.p - b.p AS d FROM pix a JOIN pix b ON b.f + 1 = a.f AND b.x = a.x AND b.y = a.y)"


@query(f"{_PAIR} SELECT f, m, sum(d * (k + 1))::BIGINT AS residual, sum((b + d) * (k + 1))::BIGINT AS restored FROM pr GROUP BY f, m")
def block_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).selectExpr("f", "m", "b", "zip_with(a, b, (x, y) -> x - y) d")
    weighted = "transform({a}, (x, i) -> x * (i + 1))"
    return rows.selectExpr("f", "m", f"{total(weighted.format(a='d'))} residual", f"{total(weighted.format(a='zip_with(b, d, (x, y) -> x + y)'))} restored")


@query(f"{_PAIR} SELECT f, m, sum(((a + b + 1) // 2) * (k + 1))::BIGINT AS half, sum(((3 * a + b + 2) // 4) * (k + 1))::BIGINT AS quarter FROM pr GROUP BY f, m")
def blend_half_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    half, quarter = "zip_with(a, b, (x, y) -> (x + y + 1) div 2)", "zip_with(a, b, (x, y) -> (3 * x + y + 2) div 4)"
    return _pairs(spark, sf_dir).selectExpr("f", "m", *[f"{total(f'transform({e}, (x, i) -> x * (i + 1))')} {n}" for e, n in ((half, "half"), (quarter, "quarter"))])


@query(f"{_PAIR}, t AS (SELECT f, m, (m % 8)::BIGINT AS kind, max(abs(d))::BIGINT AS worst FROM pr GROUP BY f, m) SELECT f, m, kind, kind & 1 AS intra, (kind >> 1) & 1 AS motion, (kind >> 2) & 1 AS is_copy, CASE WHEN worst < 3 THEN kind | 4 ELSE kind END AS marked FROM t")
def block_type_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).selectExpr("f", "m", "m % 8 kind", "array_max(zip_with(a, b, (x, y) -> abs(x - y))) worst")
    return rows.selectExpr("f", "m", "kind", "kind & 1 intra", "shiftright(kind, 1) & 1 motion", "shiftright(kind, 2) & 1 is_copy", "if(worst < 3, kind | 4, kind) marked")


@query(f"{_PAIR}, t AS (SELECT f, m, max(abs(d))::BIGINT AS worst, sum(abs(d))::BIGINT AS sad FROM pr GROUP BY f, m) SELECT f, m, sad FROM t WHERE worst >= 40")
def copy_block_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that are as good as copies carry no residual: they go before anything is exploded."""
    return _pairs(spark, sf_dir).selectExpr("f", "m", "zip_with(a, b, (x, y) -> abs(x - y)) d").where("array_max(d) >= 40").selectExpr("f", "m", f"{total('d')} sad")


@query(f"{_PAIR} SELECT f, m, sum(abs(d))::BIGINT AS sad, sum(d * d)::BIGINT AS ssd, sum(d * d)::BIGINT >> 8 AS mse, max(abs(d))::BIGINT AS mad FROM pr GROUP BY f, m")
def block_sad_ssd_mse_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).selectExpr("f", "m", "zip_with(a, b, (x, y) -> abs(x - y)) d").selectExpr("f", "m", "d", f"{total('transform(d, x -> x * x)')} ssd")
    return rows.selectExpr("f", "m", f"{total('d')} sad", "ssd", "shiftright(ssd, 8) mse", "array_max(d) mad")


_SIGN = "CASE WHEN bit_count({a} & {b}) % 2 = 0 THEN 1 ELSE -1 END"


@query(f"""{_PAIR}, h AS (SELECT f, m, k // 64 * 4 + (k % 16) // 4 AS q, i, sum(d * {_SIGN.format(a='(i // 4)', b='((k // 16) % 4)')} * {_SIGN.format(a='(i % 4)', b='(k % 4)')}) AS h FROM pr, range(0, 16) o(i) GROUP BY ALL)
SELECT f, m, ((sum(abs(h)) + 1)::BIGINT >> 1) AS satd FROM h GROUP BY f, m""")
def block_satd(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = f"transform(sequence(0, 15), q -> {transform.hadamard4(transform.quadrant('d', 'q', 16, 4))})"
    sums = total(f"transform(flatten({tiles}), x -> abs(x))")
    rows = _pairs(spark, sf_dir).selectExpr("f", "m", f"{let('zip_with(a, b, (x, y) -> x - y)', 'd', sums)} t")
    return rows.selectExpr("f", "m", "shiftright(t + 1, 1) satd")


@query(f"""{_PAIR}, s AS (SELECT f, m, (sum(d)::BIGINT + 128) >> 8 AS mean, count(*) FILTER (d <> 0)::BIGINT AS nz, sum(abs(d))::BIGINT AS sad,
  count(*) FILTER (d <> 0 AND k > 0)::BIGINT AS n, coalesce(sum(d) FILTER (k > 0), 0)::BIGINT AS t, coalesce(sum(d * d) FILTER (k > 0), 0)::BIGINT AS sq, coalesce(sum(abs(d)) FILTER (k > 0), 0)::BIGINT AS ab FROM pr GROUP BY f, m),
v AS (SELECT s.*, CASE WHEN nz = 0 THEN 0 ELSE {duck.rdiv('sad', 'nz')} END AS nonzero_mean FROM s)
SELECT v.f, v.m, mean, nonzero_mean, (sum(abs(d - mean))::BIGINT + 128) >> 8 AS deviation, CASE WHEN n = 0 THEN 0 ELSE sq - {duck.rdiv('t * t', 'n')} END AS variance2, CASE WHEN n = 0 THEN 0 ELSE {duck.rdiv('nonzero_mean + ab', 'n')} END AS variance3
FROM v JOIN pr USING (f, m) GROUP BY v.f, v.m, mean, nonzero_mean, n, sq, t, ab""")
def block_variance_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).selectExpr("f", "m", "zip_with(a, b, (x, y) -> x - y) d")
    rows = rows.selectExpr("f", "m", "d", f"shiftright({total('d')} + 128, 8) mean", f"{total('transform(d, x -> abs(x))')} sad", "cast(size(filter(d, x -> x != 0)) as bigint) nz", "slice(d, 2, 255) ac")
    rows = rows.selectExpr("*", "cast(size(filter(ac, x -> x != 0)) as bigint) n", f"{total('ac')} t", f"{total('transform(ac, x -> x * x)')} sq", f"{total('transform(ac, x -> abs(x))')} ab", f"if(nz = 0, 0L, {rdiv('sad', 'greatest(nz, 1L)')}) nonzero_mean")
    deviation = f"shiftright({let('mean', 'mu', total('transform(d, x -> abs(x - mu))'))} + 128, 8) deviation"
    return rows.selectExpr("f", "m", "mean", "nonzero_mean", deviation, f"if(n = 0, 0L, sq - {rdiv('t * t', 'greatest(n, 1L)')}) variance2", f"if(n = 0, 0L, {rdiv('nonzero_mean + ab', 'greatest(n, 1L)')}) variance3")


# ---- quality ------------------------------------------------------------------------------------------------


def _picture_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = views.pictures(spark, sf_dir)
    return now.selectExpr("f", "pic a").join(now.selectExpr("f + 1 f", "pic b"), "f")


@query(f"{_PAIR} SELECT f, sum(d * d)::BIGINT AS ssd, CASE WHEN sum(d * d) = 0 THEN 100.0 ELSE round(10 * log10(255.0 * 255.0 / (sum(d * d) / 4096.0)), 4) END AS psnr FROM pr GROUP BY f")
def psnr_by_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _picture_pairs(spark, sf_dir).selectExpr("f", f"{total('zip_with(a, b, (x, y) -> (x - y) * (x - y))')} ssd")
    return rows.selectExpr("f", "ssd", "case when ssd = 0 then 100D else round(10 * log10(255D * 255D / (ssd / 4096D)), 4) end psnr")


_SSIM = "((2 * {ma} * {mb} + 6.5025D) * (2 * {cov} + 58.5225D)) / (({ma} * {ma} + {mb} * {mb} + 6.5025D) * ({va} + {vb} + 58.5225D))"


@query(f"""{_PAIR}, s AS (SELECT f, y // 8 AS r, x // 8 AS c, sum(a)::DOUBLE / 64 AS ma, sum(b)::DOUBLE / 64 AS mb, (sum(a * a)::DOUBLE - sum(a)::DOUBLE * sum(a)::DOUBLE / 64) / 63 AS va, (sum(b * b)::DOUBLE - sum(b)::DOUBLE * sum(b)::DOUBLE / 64) / 63 AS vb, (sum(a * b)::DOUBLE - sum(a)::DOUBLE * sum(b)::DOUBLE / 64) / 63 AS cov FROM pr GROUP BY ALL)
SELECT f, round(avg({_SSIM.format(ma='ma', mb='mb', cov='cov', va='va', vb='vb').replace('D)', ')').replace('5D', '5')}), 4) AS ssim FROM s GROUP BY f""")
def ssim_by_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    tile = "transform(sequence(0, 63), i -> {p}[int(((q div 8) * 8 + i div 8) * 64 + (q % 8) * 8 + i % 8)])"
    rows = _picture_pairs(spark, sf_dir).selectExpr("f", "a", "b", "explode(sequence(0, 63)) q").selectExpr("f", f"{let('a', 'pa', tile.format(p='pa'))} a", f"{let('b', 'pb', tile.format(p='pb'))} b")
    rows = rows.selectExpr("f", f"cast({total('a')} as double) sa", f"cast({total('b')} as double) sb", *[f"cast({total(f'zip_with({x}, {y}, (x, y) -> x * y)')} as double) {n}" for x, y, n in (("a", "a", "aa"), ("b", "b", "bb"), ("a", "b", "ab"))])
    rows = rows.selectExpr("f", "sa / 64 ma", "sb / 64 mb", "(aa - sa * sa / 64) / 63 va", "(bb - sb * sb / 64) / 63 vb", "(ab - sa * sb / 64) / 63 cov")
    return rows.groupBy("f").agg(F.expr(f"round(avg({_SSIM.format(ma='ma', mb='mb', cov='cov', va='va', vb='vb')}), 4) ssim"))


# ---- prediction ---------------------------------------------------------------------------------------------

#: Columns top, left (16 source pixels, 128 where missing), corner, has_top, has_left of each macroblock.
_NEIGHBOUR_SQL = f"""{duck.PIX}, mb AS (SELECT DISTINCT f, m, x // 16 AS mx, y // 16 AS my FROM pix),
top AS (SELECT mb.f, mb.m, i, coalesce(p, 128) AS t FROM mb CROSS JOIN range(0, 16) o(i) LEFT JOIN pix ON pix.f = mb.f AND pix.x = mb.mx * 16 + i AND pix.y = mb.my * 16 - 1),
lft AS (SELECT mb.f, mb.m, i, coalesce(p, 128) AS l FROM mb CROSS JOIN range(0, 16) o(i) LEFT JOIN pix ON pix.f = mb.f AND pix.y = mb.my * 16 + i AND pix.x = mb.mx * 16 - 1),
cor AS (SELECT mb.f, mb.m, CASE WHEN mx > 0 AND my > 0 THEN p WHEN my > 0 THEN t WHEN mx > 0 THEN l ELSE 128 END AS corner
  FROM mb LEFT JOIN pix ON pix.f = mb.f AND pix.x = mb.mx * 16 - 1 AND pix.y = mb.my * 16 - 1 JOIN top ON top.f = mb.f AND top.m = mb.m AND top.i = 0 JOIN lft ON lft.f = mb.f AND lft.m = mb.m AND lft.i = 0)"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, m, mx, my, y, top, left, corner: absent neighbours are 128."""
    tiles = views.pictures(spark, sf_dir).selectExpr("f", "pic", "explode(sequence(0, 15)) m").selectExpr("f", "pic", "cast(m as bigint) m", "cast(m % 4 as bigint) mx", "m div 4 my")
    top = "if(my > 0, slice(pic, int((my * 16 - 1) * 64 + mx * 16 + 1), 16), array_repeat(128L, 16)) top"
    left = f"{let('pic', 'p', 'transform(sequence(0, 15), i -> if(mx > 0, p[int((my * 16 + i) * 64 + mx * 16 - 1)], 128L))')} left"
    block = f"{let('pic', 'p', 'transform(sequence(0, 255), i -> p[int((my * 16 + i div 16) * 64 + mx * 16 + i % 16)])')} y"
    rows = tiles.selectExpr("f", "m", "mx", "my", "pic", top, left, block)
    return rows.selectExpr("f", "m", "mx", "my", "y", "top", "left", "case when mx > 0 and my > 0 then pic[int((my * 16 - 1) * 64 + mx * 16 - 1)] when my > 0 then top[0] when mx > 0 then left[0] else 128L end corner")


_DC_SQL = "CASE WHEN my = 0 AND mx = 0 THEN 128 ELSE ((CASE WHEN my > 0 THEN st ELSE 0 END + CASE WHEN mx > 0 THEN sl ELSE 0 END) + n // 2) // n END"


@query(f"""WITH {_NEIGHBOUR_SQL}, s AS (SELECT mb.*, (SELECT sum(t)::BIGINT FROM top WHERE top.f = mb.f AND top.m = mb.m) AS st, (SELECT sum(l)::BIGINT FROM lft WHERE lft.f = mb.f AND lft.m = mb.m) AS sl,
  greatest((my > 0)::INT * 16 + (mx > 0)::INT * 16, 1) AS n FROM mb)
SELECT s.f, s.m, ({_DC_SQL})::BIGINT AS dc, sum(abs(p - ({_DC_SQL})))::BIGINT AS sad_dc, sum(abs(p - t))::BIGINT AS sad_v, sum(abs(p - l))::BIGINT AS sad_h
FROM s JOIN pix ON pix.f = s.f AND pix.m = s.m JOIN top ON top.f = s.f AND top.m = s.m AND top.i = pix.x % 16 JOIN lft ON lft.f = s.f AND lft.m = s.m AND lft.i = pix.y % 16
GROUP BY s.f, s.m, mx, my, st, sl, n""")
def intra_mode_dc_v_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predicted(spark, sf_dir)
    return rows.selectExpr("f", "m", "dc", *[f"{_sad(k)} sad_{n}" for k, n in ((0, "dc"), (1, "v"), (2, "h"))])


def _sad(mode: int) -> str:
    return total(f"zip_with(y, modes[{mode}], (a, b) -> abs(a - b))")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """neighbours with dc and modes: the seven predictions of 256 pixels."""
    rows = neighbours(spark, sf_dir)
    n = "greatest(if(my > 0, 16, 0) + if(mx > 0, 16, 0), 1)"
    dc = f"case when my = 0 and mx = 0 then 128L else (if(my > 0, {total('top')}, 0L) + if(mx > 0, {total('left')}, 0L) + {n} div 2) div {n} end dc"
    rows = rows.selectExpr("*", dc, "concat(reverse(left), array(corner), top) ref")
    three = "shiftright(ref[int({d} - 1)] + 2 * ref[int({d})] + ref[int({d} + 1)] + 2, 2)"
    two = "shiftright(ref[int({d})] + ref[int({d} + 1)] + 1, 1)"
    x, y = "(i % 16)", "(i div 16)"
    d4 = f"({x} - {y} + 16)"
    d5 = f"least(greatest({x} - ({y} div 2) + 16, 1), 31)"
    d6 = f"least(greatest(({x} div 2) - {y} + 16, 1), 31)"
    tap = f"shiftright(top[int(least({x} + {y}, 15))] + 2 * top[int(least({x} + {y} + 1, 15))] + top[int(least({x} + {y} + 2, 15))] + 2, 2)"
    modes = [
        "dc", f"top[int{x}]", f"left[int{y}]", tap, three.format(d=d4),
        f"if({y} % 2 = 1, {three.format(d=d5)}, {two.format(d=d5)})",
        f"if({x} % 2 = 1, {three.format(d=d6)}, {two.format(d=d6)})",
    ]
    return rows.selectExpr("*", "array(" + ", ".join(f"transform(sequence(0, 255), i -> {e})" for e in modes) + ") modes")


_REF = "ref AS (SELECT f, m, 15 - i AS d, l AS v FROM lft UNION ALL SELECT f, m, 16, corner FROM cor UNION ALL SELECT f, m, 17 + i, t FROM top)"


def _tap3(d: str) -> str:
    return "((" + " + ".join(f"{w} * (SELECT v FROM ref WHERE ref.f = pix.f AND ref.m = pix.m AND ref.d = {d} + {o})" for w, o in ((1, -1), (2, 0), (1, 1))) + " + 2) >> 2)"


def _tap2(d: str) -> str:
    return "((" + " + ".join(f"(SELECT v FROM ref WHERE ref.f = pix.f AND ref.m = pix.m AND ref.d = {d} + {o})" for o in (0, 1)) + " + 1) >> 1)"


def _top(i: str) -> str:
    return f"(SELECT t FROM top WHERE top.f = pix.f AND top.m = pix.m AND top.i = least({i}, 15))"


_X, _Y16 = "(x % 16)", "(y % 16)"
_D5, _D6 = f"least(greatest({_X} - {_Y16} // 2 + 16, 1), 31)", f"least(greatest({_X} // 2 - {_Y16} + 16, 1), 31)"
_DIAGONALS = f"""WITH {_NEIGHBOUR_SQL}, {_REF}, e AS (SELECT f, m, p,
 (({_top(f'{_X} + {_Y16}')} + 2 * {_top(f'{_X} + {_Y16} + 1')} + {_top(f'{_X} + {_Y16} + 2')} + 2) >> 2) AS p3, {_tap3(f'({_X} - {_Y16} + 16)')} AS p4,
 CASE WHEN {_Y16} % 2 = 1 THEN {_tap3(_D5)} ELSE {_tap2(_D5)} END AS p5, CASE WHEN {_X} % 2 = 1 THEN {_tap3(_D6)} ELSE {_tap2(_D6)} END AS p6 FROM pix)"""


@query(f"{_DIAGONALS} SELECT f, m, sum(abs(p - p3))::BIGINT AS sad3, sum(abs(p - p4))::BIGINT AS sad4, sum(abs(p - p5))::BIGINT AS sad5, sum(abs(p - p6))::BIGINT AS sad6 FROM e GROUP BY f, m")
def intra_mode_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).selectExpr("f", "m", *[f"{_sad(k)} sad{k}" for k in (3, 4, 5, 6)])


_GRADIENT = f"""g AS (SELECT mb.f, mb.m, mb.mx, mb.my,
  CASE WHEN my > 0 THEN (SELECT coalesce(sum(abs(b.t - a.t)), 0)::BIGINT FROM top a JOIN top b ON b.f = a.f AND b.m = a.m AND b.i = a.i + 1 WHERE a.f = mb.f AND a.m = mb.m) ELSE 0 END AS gh,
  CASE WHEN mx > 0 THEN (SELECT coalesce(sum(abs(b.l - a.l)), 0)::BIGINT FROM lft a JOIN lft b ON b.f = a.f AND b.m = a.m AND b.i = a.i + 1 WHERE a.f = mb.f AND a.m = mb.m) ELSE 0 END AS gv FROM mb)"""


@query(f"WITH {_NEIGHBOUR_SQL}, {_GRADIENT} SELECT f, m, gh, gv, CASE WHEN gv > gh * 3 // 2 THEN '0,2,6' WHEN gh > gv * 3 // 2 THEN '0,1,5' ELSE '0,3,4' END AS candidates FROM g")
def intra_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(neighbours(spark, sf_dir)).selectExpr("f", "m", "gh", "gv", "array_join(candidates, ',') candidates")


def _candidates(rows: DataFrame) -> DataFrame:
    slope = "{t}(zip_with(slice({a}, 2, 15), slice({a}, 1, 15), (x, y) -> abs(x - y)))"
    gh, gv = (total(slope.format(t="", a=a)) for a in ("top", "left"))
    rows = rows.selectExpr("*", f"if(my > 0, {gh}, 0L) gh", f"if(mx > 0, {gv}, 0L) gv")
    return rows.selectExpr("*", "case when gv > gh * 3 div 2 then array(0, 2, 6) when gh > gv * 3 div 2 then array(0, 1, 5) else array(0, 3, 4) end candidates")


_ALL_SADS = f"""{_DIAGONALS}, {_GRADIENT}, s AS (SELECT mb.*, (SELECT sum(t)::BIGINT FROM top WHERE top.f = mb.f AND top.m = mb.m) AS st, (SELECT sum(l)::BIGINT FROM lft WHERE lft.f = mb.f AND lft.m = mb.m) AS sl, greatest((my > 0)::INT * 16 + (mx > 0)::INT * 16, 1) AS n FROM mb),
b AS (SELECT s.f, s.m, sum(abs(p - ({_DC_SQL})))::BIGINT AS s0, sum(abs(p - t))::BIGINT AS s1, sum(abs(p - l))::BIGINT AS s2
 FROM s JOIN pix ON pix.f = s.f AND pix.m = s.m JOIN top ON top.f = s.f AND top.m = s.m AND top.i = pix.x % 16 JOIN lft ON lft.f = s.f AND lft.m = s.m AND lft.i = pix.y % 16 GROUP BY s.f, s.m, mx, my, st, sl, n),
d AS (SELECT f, m, sum(abs(p - p3))::BIGINT AS s3, sum(abs(p - p4))::BIGINT AS s4, sum(abs(p - p5))::BIGINT AS s5, sum(abs(p - p6))::BIGINT AS s6 FROM e GROUP BY f, m),
c AS (SELECT f, m, gh, gv, unnest([0, 1, 2, 3, 4, 5, 6]) AS mode, unnest([s0, s1, s2, s3, s4, s5, s6]) AS sad FROM b JOIN d USING (f, m) JOIN g USING (f, m)),
k AS (SELECT f, m, mode::BIGINT AS mode, sad, list_position(CASE WHEN gv > gh * 3 // 2 THEN [0, 2, 6] WHEN gh > gv * 3 // 2 THEN [0, 1, 5] ELSE [0, 3, 4] END, mode) AS seq FROM c),
best AS (SELECT f, m, first(mode ORDER BY sad, mode) AS exhaustive, first(mode ORDER BY seq IS NULL, sad, seq) AS fast, min(sad) AS sad FROM k GROUP BY f, m)"""


@query(f"{_ALL_SADS} SELECT f, m, fast, exhaustive, sad FROM best")
def intra_best_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best_modes(spark, sf_dir).selectExpr("f", "m", "fast", "exhaustive", "sad")


def _best_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(predicted(spark, sf_dir)).selectExpr("f", "m", "mx", "my", "candidates", "array(" + ", ".join(_sad(k) for k in range(7)) + ") sads")
    fast = let("sads", "s", "array_min(transform(candidates, (c, i) -> struct(s[c] cost, i, c)))")
    return rows.selectExpr("f", "m", "mx", "my", f"cast({fast}.c as bigint) fast", "cast(array_min(transform(sads, (s, i) -> struct(s, i))).i as bigint) exhaustive", "array_min(sads) sad")


@query(f"""{_ALL_SADS}, n AS (SELECT best.f, best.m, coalesce(l.fast, 0) AS a, coalesce(t.fast, 0) AS b FROM best LEFT JOIN best l ON l.f = best.f AND l.m = best.m - 1 AND best.m % 4 <> 0 LEFT JOIN best t ON t.f = best.f AND t.m = best.m - 4)
SELECT f, m, a AS mpm0, CASE WHEN a <> b THEN b WHEN a = 0 THEN 1 ELSE 0 END AS mpm1 FROM n""")
def mpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _best_modes(spark, sf_dir).select("f", "m", "mx", "fast")
    left, top = best.selectExpr("f", "m + 1 m", "fast a").where("m % 4 != 0"), best.selectExpr("f", "m + 4 m", "fast b")
    both = best.join(left, ["f", "m"], "left").join(top, ["f", "m"], "left").selectExpr("f", "m", "coalesce(a, 0L) a", "coalesce(b, 0L) b")
    return both.selectExpr("f", "m", "a mpm0", "case when a != b then b when a = 0 then 1L else 0L end mpm1")
