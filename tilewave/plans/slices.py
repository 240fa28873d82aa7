"""The code of whole pictures: the table of their blocks, and the blocks' levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewave.functions import bits, exprs, tables
from tilewave.plans import choices, duck
from tilewave.plans.bitstreams import _code_sql, runs_code
from tilewave.plans.registry import query

# A block is its type, and with motion the difference of its vector to that of the block on its left (none: 0) and its sub-sample.


def _signed_sql(v: str) -> str:
    return _code_sql(f"(CASE WHEN {v} = 0 THEN 1 ELSE abs({v}) * 2 + ({v} < 0)::INT END)")


_SLICES = f"""{choices._TYPES}, {duck.ZIGZAG}, best AS (SELECT f, m, arg_min(type, struct_pack(cost := cost, type := type)) AS type FROM costs GROUP BY ALL),
v AS (SELECT b.f, b.m, type, CASE WHEN type = 1 THEN dx ELSE 0 END AS dx, CASE WHEN type = 1 THEN dy ELSE 0 END AS dy, sub.place FROM best b JOIN whole w ON w.k = b.f AND w.m = b.m JOIN sub ON sub.k = b.f AND sub.m = b.m),
d AS (SELECT *, dx - CASE WHEN m % 4 > 0 THEN lag(dx) OVER w ELSE 0 END AS ddx, dy - CASE WHEN m % 4 > 0 THEN lag(dy) OVER w ELSE 0 END AS ddy FROM v WINDOW w AS (PARTITION BY f ORDER BY m)),
t AS (SELECT f, m, {_code_sql('type + 1')} || CASE WHEN type = 1 THEN {_signed_sql('ddx')} || {_signed_sql('ddy')} || {_code_sql('place + 2')} ELSE '' END AS code FROM d),
zz AS (SELECT vec_id, z.k AS pos, level FROM lv JOIN zigzag z ON z.v = lv.k JOIN best ON best.f * 16 + best.m = vec_id // 32 AND best.type = vec_id // 4 % 8),
nz AS (SELECT vec_id, pos, level, pos - lag(pos, 1, -1) OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS run FROM zz WHERE level <> 0),
parts AS (SELECT vec_id, pos, {_code_sql('run + 1')} || {_code_sql('abs(level)')} || (level < 0)::INT::VARCHAR AS part FROM nz
 UNION ALL SELECT vec_id, -1, {_code_sql('coalesce(max(pos) FILTER (level <> 0), -1) + 2')} FROM zz GROUP BY vec_id),
table_code AS (SELECT f, string_agg(code, '' ORDER BY m) AS code FROM t GROUP BY f),
level_code AS (SELECT vec_id // 512 AS f, string_agg(part, '' ORDER BY vec_id, pos) AS code FROM parts GROUP BY 1)"""


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(f, m, type, dx, dy, place), and (f, m, q, level) of the types that are chosen."""
    motion = choices._motion(spark, sf_dir)
    coded = choices._coded(spark, sf_dir, motion)
    best = choices._costs(spark, sf_dir, coded).groupBy("f", "m").agg(F.expr("min(struct(cost, type)).type type"))
    table = best.join(motion.drop("p"), ["f", "m"]).selectExpr("f", "m", "type", "if(type = 1, dx, 0L) dx", "if(type = 1, dy, 0L) dy", "place")
    return table, coded.select("f", "m", "type", "q", "level").join(best, ["f", "m", "type"])


def _table_code(table: DataFrame) -> DataFrame:
    """f, code: a picture's blocks in order; a picture has sixteen."""
    left = Window.partitionBy("f").orderBy("m")
    rows = table.select("*", *[F.when(F.col("m") % 4 > 0, F.lag(c).over(left)).otherwise(0).alias("p" + c) for c in ("dx", "dy")])
    vector = f"concat({bits.golomb(exprs.signed_code('(dx - pdx)'))}, {bits.golomb(exprs.signed_code('(dy - pdy)'))}, {bits.golomb('(place + 2)')})"
    codes = rows.selectExpr("f", "m", f"concat({bits.golomb('(type + 1)')}, if(type = 1, {vector}, '')) code")
    return codes.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("m", "code"))).alias("s")).selectExpr("f", "array_join(transform(s, x -> x.code), '') code")


@query(f"""{_SLICES} SELECT f, length(c.code)::BIGINT AS bits, md5(c.code) AS digest, (SELECT sum((type + 3 * dx + 5 * dy + CASE WHEN type = 1 THEN 7 * place ELSE 0 END) * (m + 1))::BIGINT FROM v WHERE v.f = c.f) AS decoded FROM table_code c""")
def block_table_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each picture's table of types, vectors and sub-samples as a code, and the table read back from it."""
    rows = _table_code(_blocks(spark, sf_dir)[0])
    # a step reads a type, and with motion two differences and a sub-sample; it keeps the vector for the block on its right
    second = bits.golomb_stop("c", "t.at")
    third = exprs.let(second, "u", bits.golomb_stop("c", "u"))
    vector = f"""named_struct('at', {exprs.let(third, 'w', bits.golomb_stop('c', 'w'))}, 'type', t.type,
        'dx', if(i % 4 > 0, s.dx, 0L) + {exprs.let(bits.golomb_value('c', 't.at'), 'x', bits.signed_of('x'))},
        'dy', if(i % 4 > 0, s.dy, 0L) + {exprs.let(second, 'u', exprs.let(bits.golomb_value('c', 'u'), 'x', bits.signed_of('x')))},
        'place', {exprs.let(third, 'w', bits.golomb_value('c', 'w'))} - 2)"""
    still = "named_struct('at', t.at, 'type', t.type, 'dx', 0L, 'dy', 0L, 'place', 0L)"
    head = f"named_struct('type', {bits.golomb_value('c', 's.at')} - 1, 'at', {bits.golomb_stop('c', 's.at')})"
    after = exprs.let(f"if(t.type = 1, {vector}, {still})", "n", "named_struct('at', n.at, 'dx', n.dx, 'dy', n.dy, 'sum', s.sum + (n.type + 3 * n.dx + 5 * n.dy + 7 * n.place) * (i + 1))")
    back = exprs.let("code", "c", f"aggregate(sequence(0L, 15L), named_struct('at', 1, 'dx', 0L, 'dy', 0L, 'sum', 0L), (s, i) -> {exprs.let(head, 't', after)}).sum")
    return rows.selectExpr("f", "cast(length(code) as bigint) bits", "md5(code) digest", f"{back} decoded")


@query(f"""{_SLICES} SELECT c.f, length(c.code)::BIGINT AS table_bits, length(coalesce(l.code, ''))::BIGINT AS level_bits, md5(c.code || coalesce(l.code, '')) AS digest FROM table_code c LEFT JOIN level_code l ON l.f = c.f""")
def slice_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture's whole code: its table of blocks, then the levels of each block that isn't a copy, quarter by quarter as runs."""
    table, levels = _blocks(spark, sf_dir)
    scanned = levels.selectExpr("f", "m", "q", f"{exprs.let('level', 'a', f'transform({exprs.array(tables.ZIGZAG8)}, p -> a[int(p)])')} z")
    codes = scanned.selectExpr("f", "m", "q", f"{runs_code('z')} code").groupBy("f").agg(F.sort_array(F.collect_list(F.struct("m", "q", "code"))).alias("s")).selectExpr("f", "array_join(transform(s, x -> x.code), '') l")
    rows = _table_code(table).join(codes, "f", "left").selectExpr("f", "code", "coalesce(l, '') l")
    return rows.selectExpr("f", "cast(length(code) as bigint) table_bits", "cast(length(l) as bigint) level_bits", "md5(concat(code, l)) digest")
