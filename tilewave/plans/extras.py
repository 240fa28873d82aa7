"""Further queries: scan orders, routing, framing, inheritance between blocks, sub-sample search, bytes by kind."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewave.functions import tables
from tilewave.functions.exprs import let, total
from tilewave.operators import offset_table, views
from tilewave.plans import containers, duck, filters
from tilewave.plans.codes import coder_sql
from tilewave.plans.registry import SQL, query


@query(f"WITH {duck.PKT}, k AS (SELECT *, user_id % 5 AS stream, user_id % 5 % 2 AS kind FROM pkt), f AS (SELECT kind, arg_min(stream, seq) AS stream FROM k GROUP BY kind) SELECT kind, stream, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes FROM k JOIN f USING (kind, stream) GROUP BY ALL")
def stream_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stream of each type is taken; packets of other streams are left out."""
    k = views.packets(spark, sf_dir).selectExpr("seq", "size", "user_id % 5 stream", "user_id % 5 % 2 kind")
    first = k.groupBy("kind").agg(F.min_by("stream", "seq").alias("stream"))  # a row per type
    return k.join(F.broadcast(first), ["kind", "stream"]).groupBy("kind", "stream").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def split_framed(buffers: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys, nth, payload: the messages of buffers of length-prefixed messages."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in buffers.select(*keys).schema.fields)

    def run(batches):
        for rows in batches:
            out = []
            for key, data in zip(rows[keys].itertuples(index=False), rows[column]):
                at = nth = 0
                while at + 4 <= len(data):
                    (n,) = struct.unpack_from("<I", data, at)
                    out.append((*key, nth, bytes(data[at + 4 : at + 4 + n])))
                    at, nth = at + 4 + n, nth + 1
            yield pd.DataFrame(out, columns=[*keys, "nth", "payload"])

    return buffers.mapInPandas(run, f"{schema}, nth long, payload binary")


@query("SELECT user_id AS part, event_id // 4096 AS chunk, row_number() OVER (PARTITION BY user_id, event_id // 4096 ORDER BY event_id) - 1 AS nth, props AS payload FROM events")
def framed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's payloads framed into buffers, one per 4096 events, and split again."""
    return split_framed(framed_buffers(views.table(spark, sf_dir, "events")), "b", ["part", "chunk"]).selectExpr("part", "chunk", "nth", "cast(payload as string) payload")


def framed_buffers(events: DataFrame) -> DataFrame:
    """part, chunk, b: the payloads of a user's events in each 4096, one after another behind their lengths."""
    rows = events.selectExpr("user_id part", "event_id div 4096 chunk", "event_id", "cast(props as binary) p")
    frame = "concat(unhex(lpad(hex(shiftleft(length(x.p) & 255, 24) | shiftleft(length(x.p) & 65280, 8)), 8, '0')), x.p)"
    framed = rows.groupBy("part", "chunk").agg(F.sort_array(F.collect_list(F.struct("event_id", "p"))).alias("s"))
    return framed.selectExpr("part", "chunk", f"aggregate(transform(s, x -> {frame}), cast('' as binary), (a, b) -> concat(a, b)) b")


@query(f"WITH {duck.PIX}, b AS (SELECT DISTINCT f, m, (f + m) % 3 AS how, (f * 5 + m * 3) % 15 - 7 AS own FROM pix) SELECT b.f, b.m, CASE WHEN b.how = 0 AND b.m % 4 > 0 THEN l.own WHEN b.how = 1 AND b.m >= 4 THEN t.own ELSE b.own END AS offset_ FROM b LEFT JOIN b l ON l.f = b.f AND l.m = b.m - 1 LEFT JOIN b t ON t.f = b.f AND t.m = b.m - 4")
def merge_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block takes its left or upper neighbour's parameter if it is merged with it. One hop: parameters were copied when coded."""
    b = views.pictures(spark, sf_dir).selectExpr("f", "explode(sequence(0L, 15L)) m").selectExpr("f", "m", "(f + m) % 3 how", "(f * 5 + m * 3) % 15 - 7 own")
    rows = b.join(b.selectExpr("f", "m + 1 m", "own l"), ["f", "m"], "left").join(b.selectExpr("f", "m + 4 m", "own t"), ["f", "m"], "left")
    return rows.selectExpr("f", "m", "case when how = 0 and m % 4 > 0 then l when how = 1 and m >= 4 then t else own end offset_")


@query(f"{containers._schedule_sql()} SELECT CASE WHEN d = 0 THEN 'I' WHEN place = 0 THEN 'P' ELSE 'B' END AS kind, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes, round(avg(size), 4) AS mean FROM g JOIN pkt ON pkt.seq = g.display GROUP BY 1")
def bytes_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded sizes matched with the schedule by display place."""
    kinds = containers.gop_schedule(spark, sf_dir).select(F.col("display").alias("seq"), "kind")
    return kinds.join(views.packets(spark, sf_dir), "seq").groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.round(F.avg("size"), 4).alias("mean"))


@query(f"{filters._BOTH}, t AS (SELECT f, ((i // 64) // 16) * 4 + (i % 64) // 16 AS m, a[i + 1] AS s, b[i + 1] AS r FROM pp, range(0, 4096) o(i)) SELECT f, m, min(s) AS darkest, max(s) AS lightest, sum(abs(s - r))::BIGINT AS residual, CASE WHEN max(abs(s - r)) < 40 THEN 'copy' WHEN sum(abs(s - r)) < 8192 THEN 'motion' ELSE 'intra' END AS shown FROM t GROUP BY f, m")
def block_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an inspector shows of each block: its range, its difference to the reference, and the kind that suggests."""
    rows = filters._tiles(spark, sf_dir).selectExpr("f", "m", "t", "transform(t, p -> abs(p.s - p.r)) d").selectExpr("f", "m", "array_min(transform(t, p -> p.s)) darkest", "array_max(transform(t, p -> p.s)) lightest", f"{total('d')} residual", "array_max(d) worst")
    return rows.selectExpr("f", "m", "darkest", "lightest", "residual", "case when worst < 40 then 'copy' when residual < 8192 then 'motion' else 'intra' end shown")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Per-picture figures as CSV with a header, one file per partition."""
    metrics.write.mode("overwrite").option("header", True).csv(path)


# ---- merging of offsets -------------------------------------------------------------------------------------

_SLOTS = "(c.choice BETWEEN 1 AND 29 AND o.kind = 'band' AND o.slot BETWEEN c.choice - 1 AND c.choice + 2) OR (c.choice >= 30 AND o.kind = 'edge' AND o.class = c.choice - 30)"


@query(f"""{filters._CELLS}, gain AS (SELECT *, 2 * off * err - n * off * off AS gain, CASE WHEN off = 0 THEN 1 ELSE 4 END AS bits FROM offs),
cand AS (SELECT f, m, 0 AS seq, 0 AS gain, 2 AS bits FROM (SELECT DISTINCT f, m FROM offs)
 UNION ALL SELECT g.f, g.m, 1 + s, sum(gain), 7 + 4 - count(*) + sum(bits) FROM gain g, range(0, 29) o(s) WHERE kind = 'band' AND slot BETWEEN s AND s + 3 GROUP BY g.f, g.m, s HAVING max(abs(off)) > 0
 UNION ALL SELECT f, m, 30 + class, sum(gain), 4 + 4 - count(*) + sum(bits) FROM gain WHERE kind = 'edge' GROUP BY f, m, class HAVING max(abs(off)) > 0),
c AS (SELECT f, m, arg_min(seq, struct_pack(c := {filters.RATE} * bits - gain, s := seq))::BIGINT AS choice, min({filters.RATE} * bits - gain)::BIGINT AS cost FROM cand GROUP BY f, m),
used AS (SELECT c.f, c.m, o.kind, o.slot, o.class, o.off FROM c JOIN offs o ON o.f = c.f AND o.m = c.m AND ({_SLOTS})),
merged AS (SELECT c.f, c.m, d.step, {filters.RATE} - coalesce(sum(2 * u.off * w.err - w.n * u.off * u.off), 0)::BIGINT AS cost
 FROM c JOIN (SELECT unnest([1, 4]) AS step) d ON CASE d.step WHEN 1 THEN c.m % 4 > 0 ELSE c.m >= 4 END LEFT JOIN used u ON u.f = c.f AND u.m = c.m - d.step LEFT JOIN cells w ON w.f = c.f AND w.m = c.m AND w.kind = u.kind AND w.slot = u.slot AND w.class = u.class GROUP BY ALL)
SELECT c.f, c.m, c.cost AS own, l.cost AS left_cost, t.cost AS top_cost, CASE WHEN coalesce(t.cost < least(c.cost, coalesce(l.cost, c.cost)), FALSE) THEN 'top' WHEN coalesce(l.cost < c.cost, FALSE) THEN 'left' ELSE 'own' END AS taken
FROM c LEFT JOIN merged l ON l.f = c.f AND l.m = c.m AND l.step = 1 LEFT JOIN merged t ON t.f = c.f AND t.m = c.m AND t.step = 4""")
def offset_merge_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a block does better with its left or upper neighbour's own parameters; each is costed from the block's own sums."""
    own = filters.offset_search(spark, sf_dir)
    offs = filters._offsets(spark, sf_dir)
    slots = _SLOTS.replace("c.choice", "choice").replace("o.", "")
    used = own.join(offs, ["f", "m"]).where(slots).select("f", "m", "kind", "slot", "class", "off")
    cells = offs.select("f", "m", "kind", "slot", "class", "err", "n")
    rows = own.selectExpr("f", "m", "cost own")
    for name, step, inside in (("left_cost", 1, "m % 4 > 0"), ("top_cost", 4, "m >= 4")):
        moved = used.selectExpr("f", f"m + {step} m", "kind", "slot", "class", "off")
        gain = moved.join(cells, ["f", "m", "kind", "slot", "class"]).groupBy("f", "m").agg(F.expr("sum(2 * off * err - n * off * off) gain"))
        rows = rows.join(gain, ["f", "m"], "left").withColumn(name, F.expr(f"if({inside}, {filters.RATE} - coalesce(gain, 0L), null)")).drop("gain")
    taken = "case when coalesce(top_cost < least(own, coalesce(left_cost, own)), false) then 'top' when coalesce(left_cost < own, false) then 'left' else 'own' end taken"
    return rows.selectExpr("f", "m", "own", "left_cost", "top_cost", taken)


def _signed_sql(v: str) -> str:
    z = f"(CASE WHEN {v} = 0 THEN 1 ELSE 2 * abs({v}) + ({v} < 0)::INT END)"
    return f"repeat('0', {duck.bitlen(z)} - 1) || ltrim({z}::BIGINT::BIT::VARCHAR, '0')"


_MERGED, _CHOSEN = SQL["offset_merge_decision"].replace("WITH ", "WITH RECURSIVE ", 1).split("\nSELECT c.f, c.m, c.cost AS own", 1)
_TABLE = f"""{_MERGED}, dec AS (SELECT c.f, c.m, c.cost AS own{_CHOSEN}), p AS (SELECT dec.f, dec.m, taken, choice FROM dec JOIN c ON c.f = dec.f AND c.m = dec.m),
o AS (SELECT q.f, q.m, q.k, taken, choice, coalesce(max(u.off) FILTER (u.slot = CASE WHEN choice < 30 THEN choice - 1 + k ELSE ([-2, -1, 1, 2])[k + 1] END), 0) AS off
 FROM (SELECT * FROM p, range(0, 4) r(k)) q LEFT JOIN used u ON u.f = q.f AND u.m = q.m GROUP BY ALL),
tok AS (SELECT f, m, 0 AS part, (taken = 'left')::INT::VARCHAR AS bits, 0 AS ctx FROM p WHERE m % 4 > 0
 UNION ALL SELECT f, m, 1, (taken = 'top')::INT::VARCHAR, 0 FROM p WHERE taken <> 'left' AND m >= 4
 UNION ALL SELECT f, m, 2, CASE WHEN choice = 0 THEN '00' WHEN choice < 30 THEN '01' ELSE '10' END, 1 FROM p WHERE taken = 'own'
 UNION ALL SELECT f, m, 3, CASE WHEN choice < 30 THEN {_signed_sql('(choice - 1)')} ELSE (['00', '10', '01', '11'])[choice - 29] END, CASE WHEN choice < 30 THEN 3 ELSE 2 END FROM p WHERE taken = 'own' AND choice > 0
 UNION ALL SELECT f, m, 4 + k, {_signed_sql('off')}, 4 FROM o WHERE taken = 'own' AND choice > 0
 UNION ALL SELECT f, m, 8, '00', 1 FROM p WHERE taken = 'own'),
b AS (SELECT f AS seq, ctx, row_number() OVER (PARTITION BY f ORDER BY m, part, k) AS i, substr(bits, (k + 1)::BIGINT, 1)::INT AS bit FROM tok, LATERAL (SELECT unnest(range(0, length(bits))) AS k))"""
_SHOWN = "CASE WHEN taken <> 'own' THEN taken WHEN choice = 0 THEN '0:0:' ELSE CASE WHEN choice < 30 THEN '2:' || (choice - 1) ELSE '1:' || (choice - 30) END || ':' || offs END"


@query(f"""{_TABLE}, {coder_sql()}, shown AS (SELECT f, string_agg({_SHOWN}, ' ' ORDER BY m) AS decoded FROM (SELECT f, m, taken, choice, string_agg(off, ',' ORDER BY k) AS offs FROM o GROUP BY ALL) GROUP BY f)
SELECT f, code, length(code)::BIGINT AS bits, decoded FROM coded JOIN shown ON seq = f""")
def offset_table_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each picture's table of merged and own offset parameters in the arithmetic coder's contexts, and the table decoded from it."""
    own = filters.offset_search(spark, sf_dir).select("f", "m", "choice")
    slots = _SLOTS.replace("c.choice", "choice").replace("o.", "")
    used = own.join(filters._offsets(spark, sf_dir), ["f", "m"]).where(slots).groupBy("f", "m").agg(F.map_from_entries(F.collect_list(F.struct("slot", "off"))).alias("offs"))
    at = "if(choice < 30, choice - 1 + k, element_at(array(-2L, -1L, 1L, 2L), int(k + 1)))"
    four = f"transform(sequence(0L, 3L), k -> coalesce(try_element_at(offs, {at}), 0L)) four"
    rows = own.join(used, ["f", "m"], "left").join(offset_merge_decision(spark, sf_dir).select("f", "m", "taken"), ["f", "m"])
    pictures = rows.selectExpr("f", "m", "taken", "choice", four).groupBy("f").agg(F.sort_array(F.collect_list(F.struct("m", "taken", "choice", "four"))).alias("t"))

    def run(batches):
        for batch in batches:
            out = []
            for f, taken, choice, four in zip(batch["f"], batch["taken"], batch["choice"], batch["four"]):
                blocks = []
                for how, c, offsets in zip(taken, choice, four):
                    offsets = tuple(map(int, offsets))
                    own = (offset_table.OFF, 0, ()) if c == 0 else (offset_table.BAND, int(c) - 1, offsets) if c < 30 else (offset_table.EDGE, int(c) - 30, offsets)
                    blocks.append(own if how == "own" else how)
                code = offset_table.encode(blocks, 4)
                back = offset_table.decode(code, len(blocks), 4)
                shown = [x if isinstance(x, str) else f"{x[0]}:{x[1]}:{','.join(map(str, x[2]))}" for x in back]
                out.append((f, "".join(map(str, code)), len(code), " ".join(shown)))
            yield pd.DataFrame(out, columns=["f", "code", "bits", "decoded"])

    return pictures.selectExpr("f", "t.taken", "t.choice", "t.four").mapInPandas(run, "f long, code string, bits long, decoded string")


@query(f"WITH {duck.PIX} SELECT f, count(*)::BIGINT AS n, sum(p * (y * 64 + x + 1))::BIGINT AS checksum FROM pix WHERE x < least(64 - f % 7, 60) AND y < least(64 - f % 5, 62) GROUP BY f")
def crop_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture cut to the smaller of two extents."""
    keep = "i % 64 < least(64 - k % 7, 60) and i div 64 < least(64 - k % 5, 62)"
    rows = views.pictures(spark, sf_dir).selectExpr("f", f"{let('f', 'k', f'filter(transform(pic, (p, i) -> if({keep}, p * (i + 1), null)), q -> q is not null)')} a")
    return rows.selectExpr("f", "cast(size(a) as bigint) n", f"{total('a')} checksum")


@query(f"WITH {duck.PKT} SELECT stream_id, count(*) FILTER (size > 0 AND size < 40)::BIGINT AS good, count(*) FILTER (size IS NULL OR size = 0 OR size >= 40)::BIGINT AS bad FROM pkt GROUP BY stream_id")
def decode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of a length that a decoder takes, and others."""
    return views.packets(spark, sf_dir).groupBy("stream_id").agg(F.count(F.when((F.col("size") > 0) & (F.col("size") < 40), 1)).alias("good"), F.count(F.when(F.col("size").isNull() | (F.col("size") == 0) | (F.col("size") >= 40), 1)).alias("bad"))
