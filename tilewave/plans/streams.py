"""Streaming queries: each drains its source once and returns the table that the stream wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewave.plans.containers import place_of
from tilewave.operators import views
from tilewave.plans.extras import framed_buffers
from tilewave.plans.registry import query
from tilewave.plans.shared import drained, message_log
from tilewave.streaming import buffers, stateful


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # as a pattern, so that a single file is as good a source as a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr("event_id div 1000 part", "event_id seq")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, n: pictures of each part, which tell its last one and the size of its last group."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.expr("event_id div 1000 part")).agg(F.count("*").alias("n"))


_GROUPS = """WITH e AS (SELECT event_id // 1000 AS part, event_id AS seq, event_id % 1000 AS d, count(*) OVER (PARTITION BY event_id // 1000) AS n FROM events),
s AS (SELECT *, (d - 1) // 4 AS g, (d - 1) % 4 AS j, least(4, n - 1 - (d - 1) // 4 * 4) AS size FROM e)"""


@query(f"{_GROUPS} SELECT part, seq, CASE WHEN d = 0 THEN 0 ELSE {place_of('j', 'size', '//')} END AS place, CASE WHEN d = 0 THEN -1 ELSE g END AS grp FROM s")
def stream_gop_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of four, and what is held at a part's end, which a row with the flag "end" flushes."""
    ends = _parts(spark, sf_dir).join(_sizes(spark, sf_dir), "part").selectExpr("part", "seq", "explode(if(seq % 1000 = n - 1, array(null, 'end'), array(cast(null as string)))) flag")
    return drained(buffers.group_buffer(ends))


_FORCED = """WITH e AS (SELECT event_id // 1000 AS part, event_id AS seq, event_id % 1000 AS d FROM events),
k AS (SELECT part, seq, d, max(CASE WHEN d = 0 OR d % 137 = 0 THEN d END) OVER (PARTITION BY part ORDER BY d ROWS UNBOUNDED PRECEDING) AS key FROM e),
n AS (SELECT *, d - key AS j0, count(*) OVER (PARTITION BY part, key) AS n FROM k), s AS (SELECT *, (j0 - 1) // 4 AS g, (j0 - 1) % 4 AS j, least(4, n - 1 - (j0 - 1) // 4 * 4) AS size FROM n)"""


@query(f"{_FORCED} SELECT part, seq, CASE WHEN j0 = 0 THEN 0 ELSE {place_of('j', 'size', '//')} END AS place, CASE WHEN j0 = 0 THEN -1 ELSE g END AS grp FROM s")
def stream_gop_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 137th picture of a part is forced to be a key picture: what is held goes out before it, and groups count anew."""
    flag = "if(seq % 1000 % 137 = 0 and seq % 1000 > 0, 'force', null)"
    rows = _parts(spark, sf_dir).join(_sizes(spark, sf_dir), "part").selectExpr("part", "seq", f"explode(if(seq % 1000 = n - 1, array({flag}, 'last'), array({flag}))) flag")
    # the row that ends a part stands behind its last picture
    return drained(buffers.group_buffer(rows.selectExpr("part", "if(flag = 'last', seq + 1, seq) seq", "if(flag = 'last', 'end', flag) flag")))


@query(f"""{_GROUPS}, c AS (SELECT part, CASE WHEN d = 0 THEN 0 ELSE 4 * g + 1 + {place_of('j', 'size', '//')} END AS coded, d AS display FROM s)
SELECT part, display, max(coded) OVER (PARTITION BY part ORDER BY display) AS after FROM c""")
def stream_reorder_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = events(spark, sf_dir).selectExpr("event_id div 1000 part", "event_id % 1000 coded").join(_sizes(spark, sf_dir), "part")
    rows = coded.selectExpr("part", "coded", "(coded - 1) div 4 g", "(coded - 1) % 4 k", "least(4L, n - 1 - (coded - 1) div 4 * 4) size")
    # the inverse of coding places: the anchor, the middle, then the others in order
    j = "case when k = 0 then size - 1 when k = 1 then (size - 1) div 2 when k - 2 < (size - 1) div 2 then k - 2 else k - 1 end"
    return drained(buffers.reorder_buffer(rows.selectExpr("part", "coded", f"cast(if(coded = 0, 0, 4 * g + 1 + {j}) as bigint) display")))


@query("SELECT part, seq, expected FROM (SELECT event_id // 1000 AS part, event_id AS seq, lag(event_id) OVER (PARTITION BY event_id // 1000 ORDER BY event_id) + 1 AS expected FROM events WHERE event_id % 97 <> 5) WHERE seq <> expected")
def stream_sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(buffers.sequence_check(_parts(spark, sf_dir).where("seq % 97 != 5")))


@query("""WITH e AS (SELECT date_trunc('day', ts) AS d, event_type, floor(value * 100 + 0.5)::BIGINT AS cents FROM events), l AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
SELECT epoch_us(d) AS start_us, event_type, count(*)::BIGINT AS n, sum(cents)::BIGINT AS cents FROM e, l WHERE d + INTERVAL 1 DAY <= mark GROUP BY d, event_type""")
def stream_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows that the watermark has passed."""
    sums = events(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.expr("sum(cast(floor(value * 100 + 0.5) as bigint)) cents"))
    return drained(sums.selectExpr("unix_micros(w.start) start_us", "event_type", "n", "cents"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*)::BIGINT AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = events(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return drained(sums.selectExpr("user_id", "unix_micros(w.start) start_us", "unix_micros(w.end) end_us", "n"))


# ---- typed state --------------------------------------------------------------------------------------------

PIECE, HOP, RESET = 37, 8, 40


@query("SELECT user_id AS part, event_id // 4096 AS chunk, row_number() OVER (PARTITION BY user_id, event_id // 4096 ORDER BY event_id) - 1 AS message, props AS payload FROM events")
def stream_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """framed_split on a stream: each buffer comes cut into pieces that end anywhere, spread over batches in no order. Buffers are short
    and many; those of a chunk, of at most 4,096 events, are a lane."""
    buffers_ = framed_buffers(views.table(spark, sf_dir, "events"))
    pieces = buffers_.selectExpr("part", "chunk", f"posexplode(transform(sequence(1, greatest(length(b), 1), {PIECE}), i -> substring(b, i, {PIECE}))) as (nth, data)")
    stateful.stateful(spark)
    log = message_log(pieces, ["part", "chunk", "nth"])
    return drained(stateful.reassembled(log, ["part", "chunk"], lane=["chunk"]).selectExpr("part", "chunk", "message", "cast(payload as string) payload"))


_LAPPED = f"""WITH e AS (SELECT event_id // 1000 AS part, event_id % 1000 AS n, floor(value * 100 + 0.5)::BIGINT AS iv FROM events),
h AS (SELECT part, n // {HOP} AS frame, n % {HOP} AS i, iv FROM e),
f AS (SELECT part, frame, frame // {RESET} AS epoch, sum(iv)::BIGINT AS first FROM h GROUP BY ALL),
o AS (SELECT h.part, h.frame, i, iv * (i + 1) AS own FROM h),
b AS (SELECT h.part, h.frame + 1 AS frame, i, iv * ({HOP} - i) AS before FROM h)"""


@query(f"""{_LAPPED} SELECT f.part, f.frame, f.first, sum((i + 1) * (own + CASE WHEN f.frame % {RESET} = 0 THEN 0 ELSE coalesce(b.before, 0) END))::BIGINT AS checksum
FROM f JOIN o USING (part, frame) LEFT JOIN b USING (part, frame, i) GROUP BY ALL""")
def stream_overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two hops, windowed up and down, as messages in no order over the batches; the state of a stream is what the frame before
    leaves, and every fortieth frame resets it. The stream equals the batch overlap-add."""
    hops = views.table(spark, sf_dir, "events").selectExpr("event_id div 1000 part", f"event_id % 1000 div {HOP} frame", f"event_id % {HOP} i", "cast(floor(value * 100 + 0.5) as bigint) iv")
    hops = hops.groupBy("part", "frame").agg(F.sum("iv").alias("first"), F.map_from_entries(F.collect_list(F.struct("i", "iv"))).alias("x"))
    at = f"transform(sequence(0L, {HOP - 1}L), i -> coalesce(x[i], 0L) * (i + 1))"
    before = f"transform(sequence(0L, {HOP - 1}L), i -> coalesce(x[i], 0L) * ({HOP} - i))"
    # a frame's halves: the window rises over the hop that it ends with the frame before, and falls over its own
    earlier = hops.selectExpr("part", "frame + 1 frame", "first before")
    frames = hops.join(earlier, ["part", "frame"], "left").selectExpr("part", "frame nth", f"frame % {RESET} = 0 reset", f"first - if(frame % {RESET} = 0, 0L, coalesce(before, 0L)) first", f"concat({at}, {before}) values")
    stateful.stateful(spark)
    out = drained(stateful.overlap_added(message_log(frames, ["part", "nth"]), ["part"], HOP))
    return out.selectExpr("part", "frame", "first", "aggregate(transform(hop, (v, i) -> v * (i + 1)), 0L, (a, v) -> a + v) checksum")
