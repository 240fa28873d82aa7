"""Queries on symbol codes and integer functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewave.functions.exprs import bit_length, floor_log2, rdiv, signed_code, total
from tilewave.operators import arithmetic_coder, views
from tilewave.plans import duck
from tilewave.plans.registry import query

_SYM = f"WITH {duck.SYM}"


@query(f"{_SYM} SELECT seq, sum(2 * {duck.bitlen('v + 1')} - 1)::BIGINT AS bits, string_agg(repeat('0', {duck.bitlen('v + 1')} - 1) || ltrim((v + 1)::BIT::VARCHAR, '0'), '' ORDER BY pos) AS code FROM sym GROUP BY seq")
def golomb_unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zeros, one fewer than the number's bits, then the number plus one."""
    code = "concat(repeat('0', length(bin(x + 1)) - 1), bin(x + 1))"
    return views.symbols(spark, sf_dir).selectExpr("seq", f"{total('transform(v, x -> 2 * length(bin(x + 1)) - 1L)')} bits", f"array_join(transform(v, x -> {code}), '') code")


_SIGNED = "CASE WHEN s = 0 THEN 1 ELSE abs(s) * 2 + (s < 0)::INT END"


@query(f"{_SYM}, d AS (SELECT seq, pos, v - lag(v, 1, 0) OVER (PARTITION BY seq ORDER BY pos) AS s FROM sym), m AS (SELECT *, {_SIGNED} AS m FROM d) SELECT seq, sum(2 * {duck.bitlen('m')} - 1)::BIGINT AS bits, sum(m * (pos + 1))::BIGINT AS checksum, sum(CASE WHEN m = 1 THEN 0 WHEN m % 2 = 1 THEN -(m // 2) ELSE m // 2 END * (pos + 1))::BIGINT AS decoded FROM m GROUP BY seq")
def golomb_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences within each sequence; decoded: the values read back from their codes' numbers."""
    rows = views.symbols(spark, sf_dir).selectExpr("seq", "transform(v, (x, i) -> x - if(i > 0, get(v, i - 1), 0L)) s")
    rows = rows.selectExpr("seq", f"transform(s, x -> {signed_code('x')}) m")
    back = "case when x = 1 then 0 when x % 2 = 1 then -(x div 2) else x div 2 end"
    return rows.selectExpr("seq", f"{total('transform(m, x -> 2 * length(bin(x)) - 1L)')} bits", f"{total('transform(m, (x, i) -> x * (i + 1))')} checksum", f"{total(f'transform(m, (x, i) -> ({back}) * (i + 1))')} decoded")


@query(f"{_SYM} SELECT n, count(*)::BIGINT AS sequences, sum(bits)::BIGINT AS bits, max(bits)::BIGINT AS most FROM (SELECT seq, count(*) AS n, sum(2 * {duck.bitlen('v + 1')} - 1)::BIGINT AS bits FROM sym GROUP BY seq) GROUP BY n")
def golomb_bits_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golomb_unsigned(spark, sf_dir).join(views.symbols(spark, sf_dir).selectExpr("seq", "cast(size(v) as bigint) n"), "seq").groupBy("n").agg(F.count("*").alias("sequences"), F.sum("bits").alias("bits"), F.max("bits").alias("most"))


@query(f"{_SYM} SELECT seq, string_agg(repeat('0', (v % 8)::INT) || CASE WHEN v % 8 < 7 THEN '1' ELSE '' END, '' ORDER BY pos) AS code FROM sym GROUP BY seq")
def unary_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.symbols(spark, sf_dir).selectExpr("seq", "array_join(transform(v, x -> concat(repeat('0', int(x % 8)), if(x % 8 < 7, '1', ''))), '') code")


@query(f"{_SYM}, z AS (SELECT seq, pos, zero, count(*) FILTER (NOT zero) OVER (PARTITION BY seq ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM sym) SELECT seq, island, count(*)::BIGINT AS run FROM z WHERE zero GROUP BY seq, island")
def symbol_zero_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines without discount: gaps and islands inside a sequence's array."""
    step = "aggregate(zero, named_struct('island', 0L, 'out', cast(array() as array<bigint>)), (a, z) -> named_struct('island', if(z, a.island, a.island + 1), 'out', if(z, concat(a.out, array(a.island)), a.out))).out"
    rows = views.symbols(spark, sf_dir).selectExpr("seq", f"{step} o").selectExpr("seq", "explode(o) island")
    return rows.groupBy("seq", "island").agg(F.count("*").alias("run"))


@query(f"""{_SYM}, b AS (SELECT seq, pos, (v % 2)::INT AS bit FROM sym), c AS (SELECT *, 1 + count(*) FILTER (bit = 0) OVER w AS n0, 1 + count(*) FILTER (bit = 1) OVER w AS n1 FROM b WINDOW w AS (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT seq, count(*)::BIGINT AS n, round(sum(-log2(CASE bit WHEN 0 THEN n0 ELSE n1 END::DOUBLE / (n0 + n1))), 6) + 0.0 AS cost FROM c GROUP BY seq""")
def adaptive_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that an adaptive coder needs: running counts of what came before, exact below the halving limit."""
    step = "aggregate(v, named_struct('n0', 1L, 'n1', 1L, 'c', 0D), (a, x) -> named_struct('n0', a.n0 + if(x % 2 = 0, 1, 0), 'n1', a.n1 + if(x % 2 = 0, 0, 1), 'c', a.c - log2(cast(if(x % 2 = 0, a.n0, a.n1) as double) / (a.n0 + a.n1)))).c"
    return views.symbols(spark, sf_dir).selectExpr("seq", "cast(size(v) as bigint) n", f"round({step}, 6) + 0D cost")


_QUARTER = (1 << 30) - 1


def coder_sql() -> str:
    """CTEs bn, ends, steps, coded: the arithmetic code of each seq of b(seq, i, bit, ctx), i from 1, one step of the interval a row. For
    WITH RECURSIVE, and sequences too short for the counts' halving."""
    act = f"CASE WHEN xor(low, high) >> 31 = 0 THEN 0 WHEN low > {_QUARTER} AND high <= {3 * _QUARTER} THEN 1 ELSE 2 END"
    middle = "low + (high - low) * n0 // (n0 + n1)"
    twice = f"((({{0}} - CASE WHEN act = 1 THEN {_QUARTER + 1} ELSE 0 END) * 2) & 4294967295)"
    return f"""bn AS (SELECT seq, i, bit, 1 + count(*) FILTER (bit = 0) OVER w AS n0, 1 + count(*) FILTER (bit = 1) OVER w AS n1
  FROM b WINDOW w AS (PARTITION BY seq, ctx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ends AS (SELECT seq, max(i) AS last FROM b GROUP BY seq),
steps AS (
  SELECT seq, last, 1::BIGINT AS i, 0::BIGINT AS low, 4294967295::BIGINT AS high, 0::BIGINT AS pending, ''::VARCHAR AS code FROM ends
  UNION ALL
  SELECT s.seq, last, CASE WHEN act = 2 THEN s.i + 1 ELSE s.i END,
    CASE WHEN act < 2 THEN {twice.format("low")} WHEN bit = 1 THEN {middle} + 1 ELSE low END,
    CASE WHEN act < 2 THEN {twice.format("high")} + 1 WHEN bit = 0 THEN {middle} ELSE high END,
    CASE act WHEN 0 THEN 0 WHEN 1 THEN pending + 1 ELSE pending END,
    CASE WHEN act > 0 THEN code WHEN low >> 31 = 1 THEN code || '1' || repeat('0', pending) ELSE code || '0' || repeat('1', pending) END
  FROM (SELECT *, {act} AS act FROM steps) s LEFT JOIN bn ON bn.seq = s.seq AND bn.i = s.i WHERE act < 2 OR s.i <= last),
coded AS (SELECT seq, code || CASE WHEN low < {_QUARTER} THEN '0' || repeat('1', pending + 1) ELSE '1' || repeat('0', pending + 1) END AS code
  FROM (SELECT *, {act} AS act FROM steps) WHERE act = 2 AND i > last)"""


_GOLOMB = f"""g AS (SELECT seq, pos, v, v + 1 AS z, {duck.bitlen('v + 1')} AS n FROM sym),
b AS (SELECT seq, pos % 2 AS ctx, row_number() OVER (PARTITION BY seq ORDER BY pos, k) AS i, CASE WHEN k < n - 1 THEN 0 ELSE (z >> (2 * n - 2 - k)::BIGINT) & 1 END AS bit
  FROM g, LATERAL (SELECT unnest(range(0, 2 * n - 1)) AS k))"""


@query(f"WITH RECURSIVE {duck.SYM}, {_GOLOMB}, {coder_sql()} SELECT seq, code, length(code)::BIGINT AS bits, decoded FROM coded JOIN (SELECT seq, string_agg(v, ',' ORDER BY pos) AS decoded FROM sym GROUP BY seq) USING (seq)")
def arith_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sequence's values as Exp-Golomb codes through the arithmetic coder, even and odd places with a context each: the code's
    bits, and the values decoded from them."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            rows = batch.column(1)
            values, counts = rows.flatten().to_numpy(), rows.value_lengths().to_numpy().astype(np.int64)
            code, back = _side_by_side(values, counts) if counts.max(initial=0) <= LONG else _one_by_one(values, counts)
            decoded = [",".join(map(str, x.tolist())) for x in np.split(back, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code), pa.array([len(c) for c in code]), pa.array(decoded, pa.string())], ["seq", "code", "bits", "decoded"])

    return views.symbols(spark, sf_dir).select("seq", "v").mapInArrow(coded, "seq long, code string, bits long, decoded string")


#: A batch with a sequence of more values than these is coded sequence by sequence, as few would go side by side to its end.
LONG = 1000


def _side_by_side(values: np.ndarray, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The codes as text, and the values decoded from them."""
    symbols, size = arithmetic_coder.golomb_bits(values)
    starts = np.cumsum(counts) - counts
    places = (np.arange(len(values)) - np.repeat(starts, counts)) % 2
    lengths = np.diff(np.r_[0, np.cumsum(size)][np.r_[starts, len(values)]])
    code, ends = arithmetic_coder.encode_many(symbols, np.repeat(places, size), lengths)
    text = (code[np.arange(code.shape[1]) < ends[:, None]] + ord("0")).tobytes().decode()
    edges = [0, *np.cumsum(ends).tolist()]
    return [text[i:j] for i, j in zip(edges, edges[1:])], arithmetic_coder.golomb_many(code, counts, 2)


def _one_by_one(values: np.ndarray, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
    codes, back = [], []
    for own in np.split(values, np.cumsum(counts)[:-1]):
        coder = arithmetic_coder.Encoder()
        for i, v in enumerate(own.tolist()):
            arithmetic_coder.put_golomb(coder, v, i % 2)
        bits = coder.finish()
        decoder = arithmetic_coder.Decoder(bits)
        back += [arithmetic_coder.get_golomb(decoder, i % 2) for i in range(len(own))]
        codes.append("".join(map(str, bits)))
    return codes, np.array(back, np.int64)


@query(f"""SELECT p_partkey, n, CASE WHEN abs(n) > 0 THEN {duck.bitlen('abs(n)')} - 1 ELSE 0 END::BIGINT AS log2, CASE WHEN abs(n) > 0 THEN {duck.bitlen('abs(n)')} ELSE 1 END::BIGINT AS bits, sign(n)::BIGINT AS sgn, least(abs(n), 32767)::BIGINT AS sat_abs,
 least(greatest(n, 0), 255)::BIGINT AS saturated, {duck.rdiv('n', '7')}::BIGINT AS rounded7, {duck.rdiv('n', '-4')}::BIGINT AS rounded_neg4, floor(sqrt(abs(n)))::BIGINT AS root, greatest(least(n, 5), least(greatest(n, 5), 9))::BIGINT AS median FROM (SELECT p_partkey, p_partkey * 37 % 1200 - 600 AS n FROM part)""")
def integer_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey * 37 % 1200 - 600 n")
    return rows.selectExpr(
        "p_partkey", "n", f"{floor_log2('abs(n)')} log2", f"if(n = 0, 1L, {bit_length('abs(n)')}) bits", "cast(sign(n) as bigint) sgn", "least(abs(n), 32767L) sat_abs", "least(greatest(n, 0L), 255L) saturated",
        f"{rdiv('n', '7L')} rounded7", f"{rdiv('n', '(-4L)')} rounded_neg4", "cast(floor(sqrt(abs(n))) as bigint) root", "greatest(least(n, 5L), least(greatest(n, 5L), 9L)) median",
    )


# The coefficients of the quadratic on a number's mantissa, and the first guess of the inverse root.
_LOG2, _GUESS = (-0.34484843, 2.02466578, 0.67487759), 0x5F3759DF


def _floats(div: str, e: str, floor: str) -> dict[str, str]:
    m = f"(n / pow(2.0, {e}))"
    bits = f"(({e} + 127) * 8388608 + cast(({m} - 1) * 8388608 as bigint))"
    guess = f"({_GUESS} - {bits} {div} 2)"
    first = f"(pow(2.0, {guess} {div} 8388608 - 127) * (1 + ({guess} % 8388608) / 8388608.0))"
    inverse = f"({first} * (1.5 - 0.5 * n * {first} * {first}))"
    return {
        "log2": f"round({e} - 1 + ({_LOG2[0]} * {m} + {_LOG2[1]}) * {m} - {_LOG2[2]}, 5)",
        "inverse_root": f"round({inverse}, 7)",
        "root": f"cast(floor(1 / {inverse} + 0.5) as bigint)",
        "halved": f"cast({floor}((n - 600 + case when n < 600 then -4 else 4 end) / 8.0) as bigint)",
    }


@query(f"SELECT p_partkey, n, {', '.join(f'{v} AS {k}' for k, v in _floats('//', '(' + duck.bitlen('n') + ' - 1)', 'floor').items())} FROM (SELECT p_partkey, 1 + p_partkey * 31 % 3999 AS n FROM part)")
def float_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate logarithm and roots from a number's exponent and mantissa, in double precision; and a division of n - 600 by a
    power of two, rounded away from zero before an arithmetic shift."""
    return views.table(spark, sf_dir, "part").selectExpr("p_partkey", "1 + p_partkey * 31 % 3999 n").selectExpr("p_partkey", "n", *[f"{v} {k}" for k, v in _floats("div", f"({bit_length('n')} - 1)", "floor").items()])


@query("SELECT l_partkey % 64 AS grp, count(*)::BIGINT AS symbols, sum(length(ltrim(l_partkey::BIT::VARCHAR, '0')))::BIGINT AS bits, sum(bit_count(l_partkey))::BIGINT AS ones FROM lineitem WHERE l_partkey > 0 GROUP BY 1")
def bit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem").where("l_partkey > 0").selectExpr("l_partkey % 64 grp", f"{bit_length('l_partkey')} bits", "bit_count(l_partkey) ones")
    return rows.groupBy("grp").agg(F.count("*").alias("symbols"), F.sum("bits").alias("bits"), F.sum("ones").alias("ones"))
