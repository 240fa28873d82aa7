"""Typed stream state, bounded batches, index seeks and positional reads."""

import io
import json
import os
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from tilewave.sources import container
from tilewave.streaming import stateful


class Counting(io.FileIO):
    total = 0

    def readinto(self, buffer):
        n = super().readinto(buffer)
        Counting.total += n or 0
        return n


@pytest.fixture
def packets(tmp_path):
    """Eight files of 2,000 packets of 500 bytes, in order of time, over three streams."""
    writer = container.ContainerWriter({"path": str(tmp_path / "c"), "streams": json.dumps([{"stream_type": 0}, {"stream_type": 1}, {"stream_type": 0}])}, False)
    row = lambda k: type("R", (), {"stream_id": k % 3, "stream_type": k % 3 % 2, "ts_us": 1000 * k, "payload": struct.pack("<I", k) * 125})
    writer.commit([writer.write(row(k) for k in range(2000 * i, 2000 * i + 2000)) for i in range(8)])
    return str(tmp_path / "c")


def read_all(reader):
    return [r for p in reader.partitions() for r in reader.read(p)]


@pytest.mark.parametrize("indexed", [True, False])
def test_a_hundredth_of_packets_takes_a_hundredth_of_bytes(packets, monkeypatch, indexed):
    if not indexed:
        for f in os.listdir(packets):
            if f.startswith("_index"):
                os.remove(f"{packets}/{f}")
    monkeypatch.setattr(container, "opened", lambda path: io.BufferedReader(Counting(path), 4096))
    size = sum(os.path.getsize(f) for f in container.files_of(packets))
    reader = container.PushdownReader({"path": packets})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, StringContains

    rest = list(reader.pushFilters([GreaterThanOrEqual(("ts_us",), 9_000_000), LessThan(("ts_us",), 9_160_000), EqualTo(("stream_id",), 2), StringContains(("file",), "part")]))
    assert [type(f) for f in rest] == [StringContains]
    Counting.total = 0
    found = read_all(reader)
    assert [r[4] // 1000 for r in found] == [k for k in range(9000, 9160) if k % 3 == 2]
    assert all(r[-1] == struct.pack("<I", r[4] // 1000) * 125 for r in found)
    assert Counting.total < (0.02 if indexed else 1.1) * size


@pytest.mark.parametrize("where", ["ts_us = 77000", "stream_id in (0, 2) and seq < 5", "size > 400 and ts_us between 3990500 and 4010000", "stream_type = 1 and seq >= 1990", "stream_id = 9", "ts_us < 0", "ts_us is not null and seq = 3 or stream_id = 1", "size is null"])
def test_pushdown_changes_no_result(spark, packets, where):
    spark.dataSource.register(container.ContainerSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    columns = ["file", "seq", "stream_id", "ts_us", F.md5("payload").alias("d")]
    plain = spark.read.format("packets").load(packets).where(where).select(*columns)
    pushed = spark.read.format("packets").option("pushdown", "true").load(packets).where(where).select(*columns)
    assert sorted(map(tuple, pushed.collect())) == sorted(map(tuple, plain.collect()))


def test_payloads_are_read_by_place(spark, packets):
    spark.dataSource.register(container.ContainerSource)
    index = spark.read.format("packets").option("payload", "false").load(packets)
    found = container.payloads_at(index.where("ts_us % 100000 = 7000")).select("ts_us", "payload").collect()
    assert len(found) == 160 and all(bytes(r.payload) == struct.pack("<I", r.ts_us // 1000) * 125 for r in found)


def test_overwrite_takes_indexes_along(spark, packets):
    spark.dataSource.register(container.ContainerSource)
    spark.range(5).selectExpr("0 stream_id", "0 stream_type", "id ts_us", "cast('p' as binary) payload").coalesce(1).write.format("packets").option("streams", '[{"stream_type": 0}]').mode("overwrite").save(packets)
    assert len(os.listdir(packets)) == 2 and len(container.files_of(packets)) == 1
    assert container.read_index(container.files_of(packets)[0])[0][2] == 5


@pytest.mark.parametrize("options, most", [({"maxFilesPerTrigger": "3"}, 6000), ({"maxPacketsPerTrigger": "1700"}, 1700), ({"maxFilesPerTrigger": "1", "maxPacketsPerTrigger": "5000"}, 2000)])
def test_batches_are_bounded_and_packets_come_once(spark, packets, tmp_path, options, most):
    spark.dataSource.register(container.ContainerSource)
    seen, batches = [], []

    def take(df, _):
        rows = [r.ts_us for r in df.select("ts_us").collect()]
        seen.extend(rows)
        batches.append(len(rows))

    def run(wait):
        stream = spark.readStream.format("packets").options(**options).option("progress", str(tmp_path / "progress")).load(packets)
        q = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).start()
        wait(q)
        q.stop()

    def some(q):
        end = time.time() + 60
        while len(batches) < 2 and time.time() < end and q.exception() is None:
            time.sleep(0.05)

    run(some)
    run(lambda q: q.processAllAvailable())  # a restarted query goes on where it was
    assert max(batches) <= most
    assert sorted(set(seen)) == [1000 * k for k in range(16_000)]
    # a batch that the stop cut short comes again as a whole
    assert len(seen) - 16_000 <= most


def frames_log(spark, at, batches):
    """A stream that gets one list of rows per batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "part long, nth long, reset boolean, data binary").coalesce(1).write.mode("append").parquet(f"{at}/{k}")
    return [f"{at}/{k}" for k in range(len(batches))]


def run_stream(spark, folders, at, process, wait=0.0):
    """Output rows of each batch; folders come one after another, in one source."""
    os.makedirs(f"{at}/src", exist_ok=True)
    schema = spark.read.parquet(folders[0]).schema
    out, expected = [], 0
    stream = process(spark.readStream.schema(schema).parquet(f"{at}/src"))
    q = stream.writeStream.foreachBatch(lambda df, _: out.append([tuple(r) for r in df.collect()])).option("checkpointLocation", f"{at}/state").start()
    try:
        for k, folder in enumerate(folders):
            for f in os.listdir(folder):
                if f.endswith(".parquet"):
                    os.rename(f"{folder}/{f}", f"{at}/src/{k}-{f}")
            # with timers in force Spark goes on with empty batches, so a stream is never at its end
            expected, end = expected + spark.read.schema(schema).parquet(f"{at}/src").count() - expected, time.time() + 60
            while sum(p["numInputRows"] for p in q.recentProgress) < expected and time.time() < end and q.exception() is None:
                time.sleep(0.1)
            time.sleep(wait)
    finally:
        q.stop()
    return out


def framed(messages):
    return b"".join(struct.pack("<I", len(m)) + m for m in messages)


def test_reassembly_at_every_cut(spark, tmp_path):
    stateful.stateful(spark)
    rng = random.Random(3)
    messages = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 3, 9]))) for _ in range(5)]
    whole = framed(messages)
    # part k is cut at k; the second piece comes first for odd parts, and the first one twice
    early, late = [], []
    for k in range(len(whole) + 1):
        a, b = (k, 0, False, whole[:k]), (k, 1, False, whole[k:])
        early += [b] if k % 2 else [a]
        late += [a, a] if k % 2 else [b]
    out = run_stream(spark, frames_log(spark, str(tmp_path / "in"), [early, late]), str(tmp_path), lambda s: stateful.reassembled(s, ["part"]))
    got = sorted((p, n, bytes(m)) for batch in out for p, n, m in batch)
    assert got == [(k, n, m) for k in range(len(whole) + 1) for n, m in enumerate(messages)]


def test_reset_and_expiry_begin_a_key_anew(spark, tmp_path):
    stateful.stateful(spark)
    half = framed([b"abcd"])[:5]
    batches = [
        [(1, 0, False, framed([b"x"]) + half), (2, 0, False, half)],
        [(1, 1, True, framed([b"after reset"]))],  # what part 1 held is gone; part 2 has no message for long
        [(1, 2, False, framed([b"more"]))],
        [(2, 7, False, framed([b"anew"]))],
    ]
    out = run_stream(spark, frames_log(spark, str(tmp_path / "in"), batches), str(tmp_path), lambda s: stateful.reassembled(s, ["part"], ttl_ms=4000), wait=2.5)
    assert [(p, n, bytes(m)) for batch in out for p, n, m in batch] == [(1, 0, b"x"), (1, 0, b"after reset"), (1, 1, b"more"), (2, 0, b"anew")]


def test_without_expiry_a_key_waits_for_what_is_missing(spark, tmp_path):
    stateful.stateful(spark)
    batches = [[(1, 2, False, b"c")], [(1, 1, False, b"b")], [(1, 0, False, struct.pack("<I", 3) + b"a")], [(1, 1, False, b"again"), (1, 3, False, framed([b"z"]))]]
    out = run_stream(spark, frames_log(spark, str(tmp_path / "in"), batches), str(tmp_path), lambda s: stateful.reassembled(s, ["part"]))
    assert [(n, bytes(m)) for batch in out for _, n, m in batch] == [(0, b"abc"), (1, b"z")]


def test_streams_of_a_lane_share_calls_and_stay_apart(spark, tmp_path):
    """60 streams in two lanes, one of them without a name: two calls a batch, whatever comes early, again or at a reset."""
    stateful.stateful(spark)
    at, wide = str(tmp_path / "calls"), "lane long, part long, nth long, reset boolean, data binary"
    os.makedirs(at)

    class Counted(stateful.Reassembly):
        def handleInputRows(self, key, rows, timerValues):
            with open(f"{at}/{time.time_ns()}-{key[0]}", "w"):
                pass
            return super().handleInputRows(key, rows, timerValues)

    names = [None, *range(1, 60)]
    text = {p: framed([b"%d" % (p or 0) * 5, b"", b"end"]) for p in names}
    piece = lambda p, k: ((p or 0) % 2, p, k, False, text[p][5 * k : 5 * k + 5])
    batches = [[piece(p, k) for p in names for k in (2, 4)], [piece(p, k) for p in names for k in (0, 2, 1)], [piece(p, k) for p in names for k in (1, 3, 5)]]
    batches[2].append((1, 1, 6, True, framed([b"anew"])))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, wide).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    folders = [f"{tmp_path}/in/{k}" for k in range(3)]
    out = run_stream(spark, folders, str(tmp_path), lambda s: stateful.applied(s, ["part", "lane"], Counted(), ["lane"]))
    got = sorted(((p or 0, n, bytes(m)) for batch in out for p, _, n, m in batch))
    assert got == sorted([(p or 0, n, m) for p in names for n, m in enumerate([b"%d" % (p or 0) * 5, b"", b"end"])] + [(1, 0, b"anew")])
    assert {p for batch in out for p, *_ in batch} == set(names) and len(os.listdir(at)) == 6
    with pytest.raises(ValueError):
        stateful.reassembled(spark.createDataFrame(batches[0], wide), ["part", "lane"], ttl_ms=10, lane=["lane"])
