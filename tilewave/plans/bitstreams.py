"""Queries on coded bits: coefficients as variable-length codes, buffers read and copied at any bit, long adaptive counts, damaged containers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewave.functions import bits, exprs, tables
from tilewave.operators import adaptive_counts, views
from tilewave.plans import containers, duck, signals, transforms
from tilewave.plans.registry import query
from tilewave.sources import container

# ---- coefficients -------------------------------------------------------------------------------------------


def _code_sql(m: str) -> str:
    return f"repeat('0', {duck.bitlen(m)} - 1) || ltrim(({m})::BIGINT::BIT::VARCHAR, '0')"


def _hex_sql(source: str) -> str:
    """CTE hexed(id, size, bits, code): bytes of source(id, size, code)."""
    return f"""hexed AS (SELECT id, size, any_value(length(code))::BIGINT AS bits, string_agg(printf('%02x', (SELECT sum((substr(rpad(substr(code, 8 * k::INT + 1, 8), 8, '0'), i::INT + 1, 1) = '1')::INT << i) FROM range(0, 8) b(i))::INT), '' ORDER BY k) AS code
 FROM {source}, LATERAL (SELECT unnest(range(0, (length(code) + 7) // 8)) AS k) GROUP BY id, size)"""


_EACH = f"""each AS (
 SELECT vec_id // 4 AS id, 16 AS size, vec_id % 4 * 64 + z.k AS place, level FROM lv JOIN zigzag z ON z.v = lv.k WHERE vec_id // 4 IN (SELECT vec_id // 4 FROM lv GROUP BY 1 HAVING count(DISTINCT vec_id) = 4)
 UNION ALL SELECT vec_id, 8, z.k, level FROM lv JOIN zigzag z ON z.v = lv.k
 UNION ALL SELECT vec_id * 4 + (lv.k // 32) * 2 + lv.k % 8 // 4, 4, z.k, level FROM lv JOIN zig4 z ON z.v = (lv.k // 8) % 4 * 4 + lv.k % 4)"""


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, size, z: levels in scan order of the 4x4 and 8x8 blocks, and of the 16x16 as four 8x8."""
    rows = transforms.levels(spark, sf_dir).select("vec_id", "level")
    cell = "level[int((q div 2 * 4 + p div 4) * 8 + q % 2 * 4 + p % 4)]"
    four = rows.selectExpr("vec_id", f"posexplode(transform(sequence(0, 3), q -> transform({exprs.array(tables.zigzag(4))}, p -> {cell}))) as (q, z)").selectExpr("vec_id * 4 + q id", "4L size", "z")
    eight = rows.selectExpr("vec_id", f"{exprs.let('level', 'a', f'transform({exprs.array(tables.ZIGZAG8)}, p -> a[int(p)])')} z")
    sixteen = eight.groupBy(F.expr("vec_id div 4 id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "z"))).alias("s")).where("size(s) = 4").selectExpr("id", "16L size", "flatten(transform(s, x -> x.z)) z")
    return four.unionAll(eight.selectExpr("vec_id id", "8L size", "z")).unionAll(sixteen)


@query(f"""{transforms._LV}, {duck.ZIGZAG}, {duck.const('zig4', tables.zigzag(4))}, {_EACH}, c AS (SELECT n, r, c FROM (SELECT unnest([4, 8]) AS n), range(0, 8) a(r), range(0, 8) b(c) WHERE r < n AND c < n),
z AS (SELECT n, r * n + c AS raster, row_number() OVER (PARTITION BY n ORDER BY r + c, CASE WHEN (r + c) % 2 = 1 THEN r ELSE c END) - 1 AS place FROM c),
o AS (SELECT n, place, raster FROM z UNION ALL SELECT 16, q * 64 + place, (q // 2 * 8 + raster // 8) * 16 + q % 2 * 8 + raster % 8 FROM z, range(0, 4) t(q) WHERE n = 8)
SELECT o.n::BIGINT AS n, o.place, raster, count(*)::BIGINT AS blocks, sum(abs(level))::BIGINT AS total FROM o JOIN each ON each.size = o.n AND each.place = o.place GROUP BY ALL""")
def scan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zigzag orders of 4x4 and 8x8, and of 16x16 as four of 8x8: what stands at each place of the scan, over all blocks."""
    rows = [(n, i, p) for n in (4, 8) for i, p in enumerate(tables.zigzag(n))]
    rows += [(16, q * 64 + i, (q // 2 * 8 + p // 8) * 16 + q % 2 * 8 + p % 8) for q in range(4) for i, p in enumerate(tables.ZIGZAG8)]
    orders = spark.createDataFrame(rows, "n long, place long, raster long")
    sums = _scanned(spark, sf_dir).selectExpr("size n", "posexplode(z) as (place, level)").groupBy("n", F.col("place").cast("long").alias("place")).agg(F.count("*").alias("blocks"), F.expr("sum(abs(level)) total"))
    return orders.join(sums, ["n", "place"])


_SIGNED = "CASE WHEN level = 0 THEN 1 ELSE abs(level) * 2 + (level < 0)::INT END"


@query(f"""{transforms._LV}, {duck.ZIGZAG}, {duck.const('zig4', tables.zigzag(4))}, {_EACH},
c AS (SELECT id, size, string_agg({_code_sql(_SIGNED)}, '' ORDER BY place) AS code, sum(level * (place + 1))::BIGINT AS decoded FROM each GROUP BY ALL), {_hex_sql('c')}
SELECT hexed.id, hexed.size::BIGINT AS size, bits, md5(hexed.code) AS digest, decoded FROM hexed JOIN c USING (id, size)""")
def coefficient_code_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of 4x4, 8x8 and 16x16 blocks in scan order as signed Exp-Golomb codes, packed into bytes, and read back from the code."""
    rows = _scanned(spark, sf_dir).selectExpr("id", "size", "size(z) n", f"array_join(transform(z, v -> {bits.golomb(exprs.signed_code('v'))}), '') code")
    m = bits.golomb_value("c", "a.at")
    step = f"named_struct('at', {bits.golomb_stop('c', 'a.at')}, 'sum', a.sum + {bits.signed_of(m)} * (i + 1))"
    back = exprs.let("code", "c", f"aggregate(sequence(0L, n - 1L), named_struct('at', 1, 'sum', 0L), (a, i) -> {step}).sum")
    return rows.selectExpr("id", "size", "cast(length(code) as bigint) bits", f"md5({bits.packed_hex('code')}) digest", f"{back} decoded")


def runs_code(z: str) -> str:
    """The code of levels in scan order as runs: the last place, then for each level the zeros before it, its size and its sign."""
    last = "coalesce(array_max(transform(a, p -> p.i)), -1L)"
    run = "(p.i - coalesce(get(a, j - 1).i, -1L))"
    parts = f"transform(a, (p, j) -> concat({bits.golomb(run)}, {bits.golomb('abs(p.x)')}, if(p.x < 0, '1', '0')))"
    places = f"filter(transform({z}, (x, i) -> struct(x, cast(i as bigint) i)), p -> p.x != 0)"
    return exprs.let(places, "a", f"concat({bits.golomb(f'({last} + 2)')}, array_join({parts}, ''))")


@query(f"""{transforms._Z}, nz AS (SELECT vec_id, pos, level, pos - lag(pos, 1, -1) OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS run FROM zz WHERE level <> 0),
t AS (SELECT vec_id, pos, {_code_sql('run + 1')} || {_code_sql('abs(level)')} || (level < 0)::INT::VARCHAR AS part FROM nz
 UNION ALL SELECT vec_id, -1, {_code_sql('coalesce(max(pos) FILTER (level <> 0), -1) + 2')} FROM zz GROUP BY vec_id),
c AS (SELECT vec_id AS id, 8 AS size, string_agg(part, '' ORDER BY pos) AS code FROM t GROUP BY vec_id), {_hex_sql('c')}
SELECT id AS vec_id, bits, md5(code) AS digest, (SELECT sum(level * (pos + 1))::BIGINT FROM zz WHERE zz.vec_id = id) AS decoded FROM hexed""")
def coefficient_code_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of 8x8 blocks as runs: the last place, then for each level the zeros before it, its size and its sign; and read back."""
    rows = transforms.scanned(spark, sf_dir).selectExpr("vec_id", f"{runs_code('z')} code")
    # each step reads a run, a size and a sign, until the last place is there
    head = f"named_struct('at', {bits.golomb_stop('c', '1')}, 'last', {bits.golomb_value('c', '1')} - 2, 'pos', -1L, 'sum', 0L)"
    run_m, size_at = bits.golomb_value("c", "s.at"), bits.golomb_stop("c", "s.at")
    token = exprs.let(f"named_struct('run', {run_m}, 'at', {size_at})", "r", f"named_struct('run', r.run, 'size', {bits.golomb_value('c', 'r.at')}, 'at', {bits.golomb_stop('c', 'r.at')})")
    after = "named_struct('at', t.at + 1, 'last', s.last, 'pos', s.pos + t.run, 'sum', s.sum + t.size * (s.pos + t.run + 1) * if(substring(c, t.at, 1) = '1', -1L, 1L))"
    step = f"if(s.pos < s.last, {exprs.let(token, 't', after)}, s)"
    back = exprs.let("code", "c", f"aggregate(sequence(1, 64), {head}, (s, i) -> {step}).sum")
    return rows.selectExpr("vec_id", "cast(length(code) as bigint) bits", f"md5({bits.packed_hex('code')}) digest", f"{back} decoded")


# ---- buffers ------------------------------------------------------------------------------------------------

_BUFFERS = f"""WITH {duck.SYM}, w AS (SELECT seq, pos, v * 40503 * 65537 % 4294967296 AS s, (v + pos) * 30011 * 50021 % 4294967296 AS d FROM sym),
t AS (SELECT seq, count(*) * 32 AS len, string_agg(reverse(right(s::BIT::VARCHAR, 32)), '' ORDER BY pos) AS src, string_agg(reverse(right(d::BIT::VARCHAR, 32)), '' ORDER BY pos) AS dst FROM w GROUP BY seq),
o AS (SELECT *, seq * 7919 % len AS a, seq * 104729 % len AS b FROM t), n AS (SELECT *, 1 + seq * 31 % (len - greatest(a, b)) AS n FROM o)"""


def _buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, src, dst: two buffers of words for each order; a, b, n: places in them, and how many bits."""
    rows = views.symbols(spark, sf_dir).selectExpr("seq", "transform(v, x -> x * 40503 * 65537 % 4294967296) src", "transform(v, (x, i) -> (x + i) * 30011 * 50021 % 4294967296) dst")
    rows = rows.selectExpr("*", "size(src) * 32L len").selectExpr("*", "seq * 7919 % len a", "seq * 104729 % len b")
    return rows.selectExpr("*", "1 + seq * 31 % (len - greatest(a, b)) n")


def _digits(words: str) -> str:
    return f"array_join(transform({words}, x -> reverse(lpad(bin(x), 32, '0'))), '')"


@query(f"{_BUFFERS} SELECT seq, n, substr(src, a + 1, n) AS cut, md5(substr(dst, 1, b) || substr(src, a + 1, n) || substr(dst, b + n + 1)) AS pasted FROM n")
def bit_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n bits from any place of one buffer to any place of another: cut out as a buffer of their own, and pasted over what was there."""
    rows = _buffers(spark, sf_dir).selectExpr("seq", "n", f"{bits.shifted('src', 'a', 'n')} cut", f"{bits.pasted('dst', 'b', 'src', 'a', 'n')} whole")
    return rows.selectExpr("seq", "n", f"substring({_digits('cut')}, 1, int(n)) cut", f"md5({_digits('whole')}) pasted")


@query(f"{_BUFFERS}, r AS (SELECT seq, k, substr(src, (a + 5 * k) % len + 1, 1 + k * 3) AS bits FROM n, range(0, 11) x(k)) SELECT seq, sum((k + 1) * (SELECT coalesce(sum(1::BIGINT << i), 0) FROM range(0, 32) y(i) WHERE substr(bits, i::INT + 1, 1) = '1'))::BIGINT AS checksum FROM r GROUP BY seq")
def bit_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 1 to 31 bits at eleven places of each buffer."""
    own = bits.read("w", "((a + 5 * k) % len)", "(1 + k * 3)")
    return _buffers(spark, sf_dir).selectExpr("seq", exprs.let("src", "w", exprs.total(f"transform(sequence(0L, 10L), k -> (k + 1) * {own})")) + " checksum")


# ---- long adaptive counts -----------------------------------------------------------------------------------

_LONG = """b AS (SELECT l_linenumber::BIGINT AS stream, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice, k) AS i, (l_partkey >> k) & 1 AS bit
 FROM lineitem, range(0, 10) x(k)),
p AS (SELECT stream, i, bit, sum(bit) OVER (PARTITION BY stream ORDER BY i) AS ones FROM b), len AS (SELECT stream, max(i) AS n FROM b GROUP BY stream),
e AS (SELECT stream, n, 0::BIGINT AS start, 1::BIGINT AS n0, 1::BIGINT AS n1, 0::BIGINT AS ones, 0::BIGINT AS halved FROM len
 UNION ALL SELECT e.stream, e.n, p.i, ((e.n0 + p.i - e.start - (p.ones - e.ones)) >> 1) | 1, ((e.n1 + p.ones - e.ones) >> 1) | 1, p.ones, halved + 1 FROM e JOIN p ON p.stream = e.stream AND p.i = e.start + 65536 - e.n0 - e.n1)"""


@query(f"""WITH RECURSIVE {_LONG}, m AS (SELECT stream, start, n0, n1, ones AS base, halved, lead(start, 1, n) OVER (PARTITION BY stream ORDER BY start) AS stop FROM e),
c AS (SELECT m.stream, p.i, bit, m.n0 + p.i - 1 - start - (p.ones - bit - base) AS n0, m.n1 + p.ones - bit - base AS n1 FROM m JOIN p ON p.stream = m.stream AND p.i > start AND p.i <= stop)
SELECT stream, count(*)::BIGINT AS n, (SELECT max(halved) FROM m WHERE m.stream = c.stream)::BIGINT AS halvings, sum(n1 % 9973)::BIGINT AS checksum, round(sum(-log2(CASE bit WHEN 0 THEN n0 ELSE n1 END::DOUBLE / (n0 + n1))), 3) AS cost FROM c GROUP BY stream""")
def adaptive_cost_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that an adaptive coder needs for streams of any length, whose counts are halved whenever they reach 65,536 together."""
    lines = views.table(spark, sf_dir, "lineitem").where("l_linenumber is not null").selectExpr("cast(l_linenumber as bigint) stream", "l_orderkey a", "l_partkey b", "l_suppkey c", "l_extendedprice d")
    sums = counted(spark, lines).groupBy("stream").agg(*[F.sum(c).alias(c) for c in ("n", "halvings", "checksum", "cost")])
    return sums.selectExpr("stream", "n", "halvings", "checksum", "round(cost, 3) cost")


def counted(spark: SparkSession, lines: DataFrame, limit: int = adaptive_counts.LIMIT) -> DataFrame:
    """stream, n, halvings, checksum, cost of each block of lines (stream, a, b, c, d), taken in order; the symbols are the ten lowest bits of b.

    A sort by ranges cuts the streams into blocks. Only the two counts are handed from block to block: a task for each stream goes
    over its blocks, one bit a symbol and a block at a time, and notes the counts at each one's beginning. The costs are then found
    for each block by itself."""
    columns, block = ["stream", "a", "b", "c", "d"], "stream long, a long, b long, c long, d double, n long, bits binary"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stream = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, stream[1:] != stream[:-1]]) if len(stream) else []
            for first, end in zip(cuts, [*cuts[1:], len(stream)]):
                symbols = adaptive_counts.low_bits(batch.column(2)[first:end].to_numpy(), 10)
                yield pa.RecordBatch.from_arrays([c[first : first + 1] for c in batch.columns] + [pa.array([len(symbols)]), pa.array([np.packbits(symbols.astype(np.uint8)).tobytes()])], [*columns, "n", "bits"])

    unpacked = lambda n, data: np.unpackbits(np.frombuffer(data, np.uint8), count=n)

    def handed_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, nth = None, (1, 1), 0
        for batch in batches:
            for stream, n, data in zip(batch["stream"].to_pylist(), batch["n"].to_pylist(), batch["bits"]):
                if stream != now:
                    now, counts, nth = stream, (1, 1), 0
                yield pa.RecordBatch.from_pydict({"stream": [stream], "nth": [nth], "n": [n], "n0": [counts[0]], "n1": [counts[1]], "bits": pa.array([data.as_py()], pa.binary())})
                counts, nth = adaptive_counts.advance(unpacked(n, data.as_py()), counts, limit), nth + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, _, n, n0, n1, data in zip(*(c.to_pylist() for c in batch.columns)):
                found = adaptive_counts.cost(unpacked(n, data).astype(np.int64), limit, (n0, n1))
                yield pa.RecordBatch.from_pydict({"stream": [stream], "n": [n], "halvings": [found.halvings], "checksum": [int((found.ones % 9973).sum())], "cost": [found.bits]})

    order = [F.asc_nulls_last(c) for c in columns]
    blocks = lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(packed, block)
    # blocks of equal first lines hold nothing but lines like these
    chain = blocks.repartition("stream").sortWithinPartitions(*order).mapInArrow(handed_on, "stream long, nth long, n long, n0 long, n1 long, bits binary")
    # by number: what is so small would be put together to few tasks
    dealt = chain.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "stream", "nth")
    return dealt.mapInArrow(run, "stream long, n long, halvings long, checksum long, cost double")


# ---- damage -------------------------------------------------------------------------------------------------

_HURT = "(ts_us // 1000000) % 20 = 7"


@query(f"""WITH {containers._EVENTS}, h AS (SELECT *, {_HURT} AS hurt, 16 + octet_length(encode(payload)) AS bytes FROM e)
SELECT 'packet' AS outcome, stream_id, count(*)::BIGINT AS n, sum(bytes - 16)::BIGINT AS bytes, sum(ts_us % 1000003)::BIGINT AS checksum FROM h WHERE NOT hurt GROUP BY stream_id
UNION ALL SELECT 'lost', -1, NULL, sum(bytes)::BIGINT, NULL FROM h WHERE hurt HAVING count(*) > 0""")
def container_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets whose headers are overwritten in the files: the source finds the next header that can be one, and says what was lost."""
    at = containers._written(spark, sf_dir)
    index = spark.read.format("packets").option("payload", "false").load(at).drop("payload").where("(ts_us div 1000000) % 20 = 7")

    def spoil(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(path, "r+b") as f:
                    f.seek(place - container.PACKET.size)
                    f.write(b"\xff\x00")
            yield batch.slice(0, 0)

    index.select("file", "payload_at").mapInArrow(spoil, "file string, payload_at long").count()
    rows = spark.read.format("packets").option("damaged", "skip").load(at)
    kind = F.when(F.col("stream_id") < 0, "lost").otherwise("packet")
    sums = rows.groupBy(kind.alias("outcome"), F.col("stream_id").cast("long").alias("stream_id")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.expr("sum(ts_us % 1000003) checksum"))
    return sums.select("outcome", "stream_id", *[F.when(F.col("outcome") == "packet", F.col(c)).alias(c) if c != "bytes" else c for c in ("n", "bytes", "checksum")])


# ---- audio frames -------------------------------------------------------------------------------------------


@query(f"""{signals._LEVELS}, f AS (SELECT frame, coalesce(max(k) FILTER (level <> 0), -1) AS last, max(level) FILTER (k = 0) AS first FROM lv GROUP BY frame),
p AS (SELECT f.*, coalesce(b.first, 0) AS before FROM f LEFT JOIN f b ON b.frame + 1 = f.frame),
t AS (SELECT frame, k, {_code_sql('(CASE WHEN d = 0 THEN 1 ELSE abs(d) * 2 + (d < 0)::INT END)')} AS code FROM (SELECT lv.frame, k, level - CASE WHEN k = 0 THEN before ELSE 0 END AS d FROM lv JOIN p ON p.frame = lv.frame AND k <= last)
 UNION ALL SELECT frame, -1, {_code_sql('last + 2')} FROM p),
c AS (SELECT frame AS id, 0 AS size, string_agg(code, '' ORDER BY k) AS code FROM t GROUP BY frame), {_hex_sql('c')}
SELECT id AS frame, bits, md5(code) AS digest, (SELECT sum(level * (k + 1))::BIGINT FROM lv WHERE lv.frame = id) AS decoded FROM hexed""")
def audio_frame_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame's levels up to the last that isn't zero, the first as its difference to that of the frame before; and read back from the code."""
    rows = signals._levels(spark, sf_dir).selectExpr("frame", "y", "before", "coalesce(array_max(transform(filter(transform(y, (x, k) -> struct(x, cast(k as bigint) k)), p -> p.x != 0), p -> p.k)), -1L) last")
    each = f"transform(slice(y, 1, int(last + 1)), (x, k) -> {exprs.let('x - if(k = 0, before, 0L)', 'd', bits.golomb(exprs.signed_code('d')))})"
    rows = rows.selectExpr("frame", "before", f"concat({bits.golomb('(last + 2)')}, array_join({each}, '')) code")
    head = f"named_struct('at', {bits.golomb_stop('c', '1')}, 'last', {bits.golomb_value('c', '1')} - 2, 'sum', 0L)"
    value = exprs.let(bits.golomb_value("c", "s.at"), "x", bits.signed_of("x"))
    step = f"if(k <= s.last, named_struct('at', {bits.golomb_stop('c', 's.at')}, 'last', s.last, 'sum', s.sum + ({value} + if(k = 0, before, 0L)) * (k + 1)), s)"
    back = exprs.let("code", "c", f"aggregate(sequence(0L, {signals.HOP - 1}L), {head}, (s, k) -> {step}).sum")
    return rows.selectExpr("frame", "cast(length(code) as bigint) bits", f"md5({bits.packed_hex('code')}) digest", f"{back} decoded")
