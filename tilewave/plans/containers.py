"""Queries on packets: interleaving, routing, timestamps, as-of matching, picture schedules."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewave.operators import views
from tilewave.plans import duck
from tilewave.plans.registry import query
from tilewave.plans.shared import drained, shared_dir
from tilewave.sources import audio, container

_PKT = f"WITH {duck.PKT}"
FPS, RATE, HOP = 30, 44_100, 512


@query(f"{_PKT} SELECT stream_id, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes, min(seq) AS first FROM pkt GROUP BY stream_id")
def demux_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.packets(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("seq").alias("first"))


@query(f"{_PKT}, p AS (SELECT *, seq // 1000 AS part FROM pkt) SELECT part, seq, stream_id, size, sum(size + 16) OVER (PARTITION BY part ORDER BY seq)::BIGINT - size AS payload_at FROM p")
def packet_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each payload begins in a file of a thousand packets, from headers alone: payloads aren't read."""
    rows = views.packets(spark, sf_dir).selectExpr("seq div 1000 part", "seq", "stream_id", "size")
    before = F.sum(F.col("size") + 16).over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("part", "seq", "stream_id", "size", (before - F.col("size")).alias("payload_at"))


@query(f"{_PKT} SELECT seq, (seq * 1000000) // {FPS} AS video_us, (seq * {HOP} * 1000000) // {RATE} AS audio_us FROM pkt")
def packet_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.packets(spark, sf_dir).selectExpr("seq", f"seq * 1000000 div {FPS} video_us", f"seq * {HOP} * 1000000 div {RATE} audio_us")


@query(f"""{_PKT}, v AS (SELECT seq AS i, size FROM pkt), a AS (SELECT i, 0 AS kind, i AS idx FROM v UNION ALL
 SELECT i, 1, k FROM (SELECT i, unnest(range(i * {RATE} // ({HOP} * {FPS}), (i + 1) * {RATE} // ({HOP} * {FPS}))) AS k FROM v)) SELECT i, kind, idx, CASE kind WHEN 0 THEN idx * 1000000 // {FPS} ELSE idx * {HOP} * 1000000 // {RATE} END AS ts_us FROM a""")
def mux_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each video packet, the audio packets that fall due: a fraction that adds up, in closed form."""
    due = f"(i * {RATE}) div ({HOP} * {FPS})"
    rows = views.packets(spark, sf_dir).selectExpr("seq i").selectExpr("i", f"{due} a", f"((i + 1) * {RATE}) div ({HOP} * {FPS}) b")
    audio = rows.where("b > a").selectExpr("i", "1L kind", "explode(sequence(a, b - 1)) idx")
    both = rows.selectExpr("i", "0L kind", "i idx").unionByName(audio)
    return both.selectExpr("i", "kind", "idx", f"case kind when 0 then idx * 1000000 div {FPS} else idx * {HOP} * 1000000 div {RATE} end ts_us")


@query(f"{_PKT} SELECT a.seq, v.seq AS picture, a.ts_us - v.ts_us AS lag_us FROM pkt a ASOF JOIN pkt v ON v.user_id = a.user_id AND v.ts_us <= a.ts_us AND v.stream_id <> a.stream_id WHERE FALSE UNION ALL "
       "SELECT a.seq, v.seq, a.ts_us - v.ts_us FROM (SELECT * FROM pkt WHERE stream_id = 1) a ASOF JOIN (SELECT * FROM pkt WHERE stream_id = 0) v ON a.user_id = v.user_id AND a.ts_us >= v.ts_us")  # fmt: skip
def av_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each packet of stream 1, its user's latest packet of stream 0 at or before it.

    A user's history is cut into days: the last packet of stream 0 in the same day, else the last of earlier days, so that a
    user with very many packets is no single task.
    """
    rows = views.packets(spark, sf_dir).selectExpr("user_id", "stream_id", "seq", "ts_us", "ts_us div 86400000000 day")
    at = F.when(F.col("stream_id") == 0, F.struct("ts_us", "seq"))
    days = rows.where("stream_id = 0").groupBy("user_id", "day").agg(F.max(F.struct("ts_us", "seq")).alias("last"))
    # days of a user: few rows, whatever the number of packets
    known = rows.select("user_id", "day").distinct().join(days, ["user_id", "day"], "left")
    known = known.select("user_id", "day", F.max("last").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    inside = F.max(at).over(Window.partitionBy("user_id", "day").orderBy("ts_us", "stream_id", "seq").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("same", inside).where("stream_id = 1").join(known, ["user_id", "day"]).selectExpr("seq", "ts_us", "coalesce(same, earlier) p")
    return found.where("p is not null").selectExpr("seq", "p.seq picture", "ts_us - p.ts_us lag_us")


# ---- schedule -----------------------------------------------------------------------------------------------
# Display 0 of a period is a key picture; groups of four follow, coded as anchor, middle, first, third.

PERIOD, QUALITY = 3600, 16


def place_of(j: str, size: str, div: str) -> str:
    """Coding place of picture j of a group of `size`: the last is the anchor, then the middle, then the others."""
    middle = f"({size} - 1) {div} 2"
    return f"CASE WHEN {j} = {size} - 1 THEN 0 WHEN {j} = {middle} THEN 1 WHEN {j} < {middle} THEN 2 + {j} ELSE 1 + {j} END"


def _schedule_sql() -> str:
    return f"""{_PKT}, n AS (SELECT count(*) AS n FROM pkt), s0 AS (SELECT seq AS display, seq % {PERIOD} AS d, seq // {PERIOD} AS period, n FROM pkt, n),
s AS (SELECT *, CASE WHEN d = 0 THEN -1 ELSE (d - 1) // 4 END AS g, (d - 1) % 4 AS j, least(4, least({PERIOD}, n - period * {PERIOD}) - 1 - (d - 1) // 4 * 4) AS members FROM s0),
g AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE {place_of('j', 'members', '//')} END AS place FROM s)"""


def _schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last group of a period or of all can be short."""
    pkt = views.packets(spark, sf_dir).select("seq")
    rows = pkt.crossJoin(F.broadcast(pkt.agg(F.count("*").alias("n"))))  # one row
    rows = rows.selectExpr("seq display", f"seq % {PERIOD} d", f"seq div {PERIOD} period", "n")
    rows = rows.selectExpr("*", "if(d = 0, -1L, (d - 1) div 4) g", "(d - 1) % 4 j", f"least(4L, least({PERIOD}L, n - period * {PERIOD}) - 1 - (d - 1) div 4 * 4) members")
    return rows.selectExpr("display", "d", "period", "g", f"if(d = 0, 0L, cast({place_of('j', 'members', 'div')} as bigint)) place")


@query(f"{_schedule_sql()} SELECT display, g, CASE WHEN d = 0 THEN 'I' WHEN place = 0 THEN 'P' ELSE 'B' END AS kind, CASE WHEN place < 2 THEN 1 ELSE 0 END AS is_reference, CASE WHEN place = 0 THEN {QUALITY} WHEN place = 1 THEN least({QUALITY} + 1, 31) ELSE least({QUALITY} + 2, 31) END AS qp FROM g")
def gop_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schedule(spark, sf_dir).selectExpr("display", "g", "case when d = 0 then 'I' when place = 0 then 'P' else 'B' end kind", "if(place < 2, 1L, 0L) is_reference", f"cast(case when place = 0 then {QUALITY} when place = 1 then least({QUALITY} + 1, 31) else least({QUALITY} + 2, 31) end as bigint) qp")


@query(f"{_schedule_sql()} SELECT display, period * {PERIOD} + CASE WHEN d = 0 THEN 0 ELSE 1 + g * 4 + place END AS coded FROM g")
def coding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schedule(spark, sf_dir).selectExpr("display", f"period * {PERIOD} + if(d = 0, 0L, 1 + g * 4 + place) coded")


@query(f"{_schedule_sql()} SELECT display, CASE WHEN d = 0 THEN 0 WHEN place = 0 THEN (g + 1) % 2 WHEN place = 1 THEN 2 ELSE 3 END AS slot, CASE WHEN d = 0 THEN 0 WHEN place = 3 THEN 2 ELSE g % 2 END AS forward, CASE WHEN d = 0 OR place = 0 THEN 0 WHEN place = 2 THEN 2 ELSE (g + 1) % 2 END AS backward FROM g")
def reference_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schedule(spark, sf_dir).selectExpr("display", "case when d = 0 then 0L when place = 0 then (g + 1) % 2 when place = 1 then 2L else 3L end slot", "case when d = 0 then 0L when place = 3 then 2L else g % 2 end forward", "case when d = 0 or place = 0 then 0L when place = 2 then 2L else (g + 1) % 2 end backward")


@query(f"{_schedule_sql()}, c AS (SELECT display, period, period * {PERIOD} + CASE WHEN d = 0 THEN 0 ELSE 1 + g * 4 + place END AS coded FROM g) SELECT display, coded, max(coded) OVER (PARTITION BY period ORDER BY display) AS shown_after FROM c")
def display_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coded picture after which each display place can be shown: all up to it are there. Periods are of bounded length."""
    rows = _schedule(spark, sf_dir).selectExpr("display", "period", f"period * {PERIOD} + if(d = 0, 0L, 1 + g * 4 + place) coded")
    return rows.select("display", "coded", F.max("coded").over(Window.partitionBy("period").orderBy("display")).alias("shown_after"))


# ---- containers ---------------------------------------------------------------------------------------------

STREAMS = [container.Stream(container.VIDEO, 320, 240, 30.0), container.Stream(container.AUDIO, sample_rate=RATE, channels=2, bit_depth=16, quality=8)]


def _written(spark: SparkSession, sf_dir: str, by: str | None = None) -> str:
    """Events as packets in a container of part files, by ranges of a column if one is given. The sink writes where its tasks run, into
    the shared folder."""
    spark.dataSource.register(container.ContainerSource)
    at = f"{shared_dir(spark)}/containers/{uuid.uuid4().hex}"
    rows = views.table(spark, sf_dir, "events").selectExpr("cast(if(event_type in ('view', 'click'), 0, 1) as int) stream_id", "cast(if(event_type in ('view', 'click'), 0, 1) as int) stream_type", "unix_micros(cast(ts as timestamp)) ts_us", "cast(concat('p', coalesce(props, '')) as binary) payload")
    rows = rows.repartitionByRange(by).sortWithinPartitions(by) if by else rows
    rows.write.format("packets").option("streams", json.dumps([asdict(s) for s in STREAMS])).mode("append").save(at)
    return at


_EVENTS = "e AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS stream_id, epoch_us(ts) AS ts_us, 'p' || coalesce(props, '') AS payload FROM events)"


@query(f"WITH {_EVENTS} SELECT stream_id, ts_us, md5(payload) AS digest, count(*)::BIGINT AS n FROM e GROUP BY ALL")
def container_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets written by the sink and read back by the source: each with its stream, time and payload."""
    back = spark.read.format("packets").load(_written(spark, sf_dir))
    return back.selectExpr("cast(stream_id as bigint) stream_id", "ts_us", "md5(payload) digest").groupBy("stream_id", "ts_us", "digest").agg(F.count("*").alias("n"))


@query(f"WITH {_EVENTS} SELECT stream_id, count(*)::BIGINT AS n, sum(octet_length(encode(payload)))::BIGINT AS bytes, 0::BIGINT AS gaps FROM e GROUP BY stream_id")
def container_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers alone: sizes by stream, and payloads that don't begin where the packet before ends."""
    index = spark.read.format("packets").option("payload", "false").load(_written(spark, sf_dir)).drop("payload")
    before = Window.partitionBy("file").orderBy("seq")  # a part file: of bounded length
    rows = index.withColumn("gap", F.col("payload_at") - F.coalesce(F.lag(F.col("payload_at") + F.col("size")).over(before), F.lit(container.HEADER.size + len(STREAMS) * container.DESCRIPTOR.size)) != container.PACKET.size)
    return rows.groupBy(F.col("stream_id").cast("long").alias("stream_id")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.count_if("gap").alias("gaps"))


@query(f"SELECT 0::BIGINT AS stream_id, 0::BIGINT AS stream_type, 320::BIGINT AS width, 240::BIGINT AS height, 30::DOUBLE AS frame_rate, 0::BIGINT AS sample_rate, 0::BIGINT AS channels, 0::BIGINT AS bit_depth, 0::BIGINT AS quality UNION ALL SELECT 1, 1, 0, 0, 0, {RATE}, 2, 16, 8")
def container_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams that all part files describe."""
    rows = spark.read.format("packets").option("table", "streams").load(_written(spark, sf_dir)).drop("file").distinct()
    return rows.select(*[F.col(c).cast("double" if c == "frame_rate" else "long").alias(c) for c in rows.columns])


@query(f"WITH {_EVENTS} SELECT stream_id, count(*)::BIGINT AS n, sum(octet_length(encode(payload)))::BIGINT AS bytes, sum(ts_us % 1000003)::BIGINT AS checksum FROM e GROUP BY stream_id")
def container_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part files as a stream, drained once: each packet arrives once."""
    at = _written(spark, sf_dir)
    rows = drained(spark.readStream.format("packets").load(at).selectExpr("cast(stream_id as bigint) stream_id", "size", "ts_us"))
    return rows.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.expr("sum(ts_us % 1000003) checksum"))


@query(f"WITH {_EVENTS}, b AS (SELECT quantile_disc(ts_us, 0.50) AS low, quantile_disc(ts_us, 0.51) AS high FROM e) SELECT stream_id, ts_us, md5(payload) AS digest, count(*)::BIGINT AS n FROM e, b WHERE stream_id = 1 AND ts_us BETWEEN low AND high GROUP BY ALL")
def container_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets of one stream in a hundredth of all time: the source meets the comparisons itself, by its index."""
    at = _written(spark, sf_dir, "ts_us")
    low, high = views.table(spark, sf_dir, "events").selectExpr("unix_micros(cast(ts as timestamp)) t").selectExpr("percentile_disc(0.5) within group (order by t)", "percentile_disc(0.51) within group (order by t)").first()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("packets").option("pushdown", "true").load(at).where((F.col("stream_id") == 1) & F.col("ts_us").between(int(low), int(high)))
    return found.selectExpr("cast(stream_id as bigint) stream_id", "ts_us", "md5(payload) digest").groupBy("stream_id", "ts_us", "digest").agg(F.count("*").alias("n"))


@query(f"WITH {_EVENTS} SELECT stream_id, ts_us, md5(payload) AS digest, count(*)::BIGINT AS n FROM e WHERE (ts_us // 1000000) % 100 = 7 GROUP BY ALL")
def container_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets picked from their headers; then their payloads alone are read, each at its place."""
    index = spark.read.format("packets").option("payload", "false").load(_written(spark, sf_dir)).drop("payload")
    found = container.payloads_at(index.where("ts_us div 1000000 % 100 = 7"))
    return found.selectExpr("cast(stream_id as bigint) stream_id", "ts_us", "md5(payload) digest").groupBy("stream_id", "ts_us", "digest").agg(F.count("*").alias("n"))


@query(f"WITH {_EVENTS} SELECT stream_id, count(*)::BIGINT AS n, sum(octet_length(encode(payload)))::BIGINT AS bytes, sum(ts_us % 1000003)::BIGINT AS checksum FROM e GROUP BY stream_id")
def container_stream_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part files as a stream of bounded batches: two files and a third of the packets at most, and each packet once."""
    n, at = views.table(spark, sf_dir, "events").count(), _written(spark, sf_dir)
    rows = spark.readStream.format("packets").option("maxFilesPerTrigger", 2).option("maxPacketsPerTrigger", max(1, n // 3)).option("progress", f"{at.removeprefix('file://')}/_progress").load(at)
    rows = drained(rows.selectExpr("cast(stream_id as bigint) stream_id", "size", "ts_us"), now=False)
    return rows.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.expr("sum(ts_us % 1000003) checksum"))


@query(f"WITH {duck.PCM} SELECT n // 512 AS frame, octet_length(encode(string_agg(iv, ',' ORDER BY n)))::BIGINT AS size, md5(string_agg(iv, ',' ORDER BY n)) AS digest, {RATE} AS sample_rate, 2 AS channels FROM pcm GROUP BY 1")
def raw_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 512 samples written as raw audio streams and read back; a frame's first sample tells it."""
    spark.dataSource.register(audio.AudioSource)
    at = f"{shared_dir(spark)}/audio/{uuid.uuid4().hex}"
    frames = views.pcm(spark, sf_dir).groupBy(F.expr("n div 512 frame")).agg(F.sort_array(F.collect_list(F.struct("n", "iv"))).alias("s"))
    frames = frames.selectExpr("frame", "array_join(transform(s, x -> cast(x.iv as string)), ',') t")
    frames.selectExpr("cast(concat(frame, ':', t) as binary) payload").write.format("audio_frames").option("sample_rate", RATE).option("channels", 2).mode("append").save(at)
    back = spark.read.format("audio_frames").load(at).selectExpr("split(cast(payload as string), ':') p", "sample_rate", "channels")
    return back.selectExpr("cast(p[0] as bigint) frame", "cast(octet_length(p[1]) as bigint) size", "md5(p[1]) digest", "cast(sample_rate as int) sample_rate", "channels")


def _little(n: str) -> str:
    """Four bytes of an integer, the lowest first, as hexadecimal text."""
    return f"concat_ws('', transform(sequence(0, 3), k -> lpad(hex(shiftright({n}, 8 * k) & 255), 2, '0')))"


def valid_header(header: str, magic: bytes = container.MAGIC) -> str:
    """Whether a binary begins with a container's header: its magic, its version, and the size that its stream count makes."""
    byte = lambda k: f"coalesce(cast(conv(hex(substring({header}, {k + 1}, 1)), 16, 10) as bigint), 0L)"
    size = " + ".join(f"shiftleft({byte(4 + k)}, {8 * k})" for k in range(4))
    head, each = container.HEADER.size, container.DESCRIPTOR.size
    return f"(octet_length({header}) >= {head} and hex(substring({header}, 1, {len(magic)})) = '{magic.hex().upper()}' and {byte(8)} = {container.VERSION} and ({size}) = {head} + {each} * {byte(9)})"


@query("SELECT event_id % 7 AS defect, count(*)::BIGINT AS n, count(*) FILTER (event_id % 7 > 4)::BIGINT AS valid FROM events GROUP BY 1")
def container_header_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of up to 255 streams with a defect each: of magic, size, version, count or length; the predicate finds the whole ones."""
    head, each = container.HEADER.size, container.DESCRIPTOR.size
    rows = views.table(spark, sf_dir, "events").selectExpr("event_id % 7 defect", "event_id % 255 + if(event_id % 7 = 3, 1, 0) streams", "event_id % 255 own")
    size = f"({head} + {each} * own + if(defect = 1, 256, 0))"
    parts = f"if(defect = 0, '58', '{container.MAGIC[:1].hex()}'), '{container.MAGIC[1:].hex()}', {_little(size)}, lpad(hex({container.VERSION} + if(defect = 2, 1, 0)), 2, '0'), if(defect = 4, '', lpad(hex(streams), 2, '0'))"
    rows = rows.selectExpr("defect", f"unhex(concat({parts})) h")
    return rows.groupBy("defect").agg(F.count("*").alias("n"), F.expr(f"count_if({valid_header('h')}) valid"))
