import io
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewave.functions import exprs, tables
from tilewave.operators import arithmetic_coder, audio_coder, picture_coder, quantize, transform
from tilewave.plans.extras import write_metrics
from tilewave.sources import container, generators
from tilewave.streaming.buffers import GroupBuffer


def test_scans_are_permutations_and_inverse():
    assert sorted(tables.ZIGZAG8) == list(range(64))
    assert tables.ZIGZAG8[:6] == [0, 1, 8, 16, 9, 2]
    assert tables.inverse(tables.ZIGZAG8)[8] == 2


def test_bark_bands_are_contiguous():
    for rate in (44_100, 48_000):
        bands = tables.bark_bands(rate)
        assert bands[0][1] == 0 and bands[-1][2] == 512
        assert all(a[2] == b[1] for a, b in zip(bands, bands[1:]))


def test_rounded_division_is_half_away_from_zero(spark):
    rows = spark.createDataFrame([(7, 2), (-7, 2), (5, 3), (-5, 3), (1, 2), (-1, 2)], "n long, d long").selectExpr(f"{exprs.rdiv('n', 'd')} q").collect()
    assert [r.q for r in rows] == [4, -4, 2, -2, 1, -1]


def test_flat_block_has_its_energy_in_dc(spark):
    df = spark.range(1).selectExpr("array_repeat(100L, 64) s")
    row = transform.inverse(transform.forward(df, "s", "c"), "c", "r").first()
    assert row.c[0] > 0 and not any(row.c[1:])
    assert max(abs(a - 100) for a in row.r) <= 3


def test_hadamard_of_a_constant(spark):
    row = spark.range(1).selectExpr("array_repeat(1L, 16) s").selectExpr(f"{transform.hadamard4('s')} h").first()
    assert row.h == [16] + [0] * 15


@pytest.mark.parametrize("quality,qp", [(0, 1), (1, 1), (16, 16), (31, 53)])
def test_quality_to_qp(spark, quality, qp):
    assert spark.range(1).selectExpr(f"{quantize.quality_to_qp(str(quality))} q").first().q == qp


def test_arithmetic_coder_round_trip_and_gain():
    rng = random.Random(3)
    for _ in range(60):
        p = rng.random()
        bits = [int(rng.random() < p) for _ in range(rng.randint(0, 300))]
        contexts = [rng.randrange(3) for _ in bits]
        assert arithmetic_coder.decode(arithmetic_coder.encode(bits, contexts), len(bits), contexts) == bits
    rare = [int(rng.random() < 0.05) for _ in range(90_000)]
    code = arithmetic_coder.encode(rare)
    assert len(code) < 0.35 * len(rare) and arithmetic_coder.decode(code, len(rare)) == rare


def snr(x, y):
    return 10 * np.log10((x**2).sum() / ((x - y) ** 2).sum())


def test_lapped_transform_reconstructs():
    x = 0.5 * np.sin(2 * np.pi * 440 * np.arange(20 * 512 + 100) / 44_100)
    coef = (audio_coder.frames_of(x) * audio_coder.WINDOW) @ audio_coder.BASIS
    y = audio_coder.signal_of(coef / audio_coder.steps(0, 44_100), 0, 44_100, len(x))
    assert np.abs(y - x).max() < 5e-4
    assert np.allclose(audio_coder.WINDOW[:512] ** 2 + audio_coder.WINDOW[512:] ** 2, 1, atol=1e-6)


def test_audio_coder_round_trip_and_trend():
    t = np.arange(12 * 512) / 44_100
    both = 0.5 * np.stack([np.sin(2 * np.pi * 440 * t), np.sin(2 * np.pi * 880 * t)])
    results = []
    for quality in (0, 8, 16):
        packets, levels = audio_coder.encode(both, quality, 44_100)
        back = audio_coder.decode(packets, 2)
        assert (back == levels).all()
        rec = audio_coder.left_right(np.stack([audio_coder.signal_of(x, quality, 44_100, both.shape[1]) for x in back]))
        results.append((min(snr(a, b) for a, b in zip(both, rec)), sum(map(len, packets))))
    assert results[0][0] > 30
    assert results == sorted(results, reverse=True)


def gradient(size, shift=0):
    x, y = np.meshgrid(np.arange(size), np.arange(size))
    return (4 * (x + shift) & 255) // 2 + (4 * y & 255) // 2


def psnr(a, b):
    error = ((a - b) ** 2).mean()
    return 100 if not error else 10 * np.log10(255**2 / error)


@pytest.mark.parametrize("qp,floor", [(1, 35), (8, 25), (28, 20)])
def test_picture_coder_round_trip(qp, floor):
    pictures = [gradient(64, k) for k in range(4)]
    packets, rebuilt = picture_coder.encode_period(pictures, qp)
    assert all((a == b).all() for a, b in zip(rebuilt, picture_coder.decode_period(packets, 64, 64)))
    assert min(psnr(a, b) for a, b in zip(pictures, rebuilt)) > floor
    assert np.mean([len(p) for p in packets[1:]]) < len(packets[0])


def test_picture_coder_of_a_flat_picture_and_rate_order():
    flat = np.full((64, 64), 90)
    packets, rebuilt = picture_coder.encode_period([flat, flat], 1)
    assert psnr(flat, rebuilt[0]) > 30 and len(packets[1]) < 40
    sizes = [len(picture_coder.encode_period([gradient(64)], qp)[0][0]) for qp in (1, 8, 28)]
    assert sizes == sorted(sizes, reverse=True)


def test_directional_predictions():
    recon = np.zeros((48, 48), np.int64)
    recon[15, 16:32] = 10 * np.arange(16)
    recon[16:32, 15] = 10 * np.arange(16)
    made = picture_coder.predictions(recon, 16, 16)
    assert (made[1] == 10 * np.arange(16)).all() and (made[2] == 10 * np.arange(16)[:, None]).all()
    assert all((p == 128).all() for p in picture_coder.predictions(recon, 0, 0))


def test_vector_predictor():
    around = {(0, 1): (1, 9), (1, 0): (5, 3), (2, 0): (7, 1)}
    assert picture_coder.predicted_vector(around, {}, 1, 1) == (5, 3)
    assert picture_coder.predicted_vector({(0, 0): (3, -4)}, {}, 1, 0) == (3, -4)
    assert picture_coder.predicted_vector({(0, 0): (3, -3)}, {(1, 0): (0, 0)}, 1, 0) == (1, -1)
    assert picture_coder.predicted_vector({}, {}, 0, 0) == (0, 0)


def test_container_round_trip(tmp_path):
    streams = [container.Stream(container.VIDEO, 320, 240, 30.0), container.Stream(container.AUDIO, sample_rate=44_100, channels=2, bit_depth=16, quality=8)]
    packets = [(0, 0, 0, b"abc"), (1, 1, 1000, b"xy"), (0, 0, 33_333, b"d"), (1, 1, 34_000, b"efgh")]
    path = tmp_path / "a"
    with open(path, "wb") as f:
        container.write_header(f, streams)
        for p in packets:
            container.write_packet(f, *p)
    with open(path, "rb") as f:
        assert [s for _, s in container.read_streams(f)] == streams
        found = list(container.read_packets(f))
    assert [(r[1], r[2], r[3], r[6]) for r in found] == packets
    assert container.read_payload(str(path), found[3][5], found[3][4]) == b"efgh"
    with pytest.raises(ValueError):
        container.write_packet(io.BytesIO(), 0, 0, 0, b"")
    with pytest.raises(ValueError):
        container.read_streams(io.BytesIO(b"nope" + bytes(20)))


def test_container_source_and_sink(spark, tmp_path):
    spark.dataSource.register(container.ContainerSource)
    rows = spark.range(40).selectExpr("cast(id % 2 as int) stream_id", "cast(id % 2 as int) stream_type", "id * 1000 ts_us", "cast(concat('p', id) as binary) payload")
    at = str(tmp_path / "c")
    rows.repartition(3).write.format("packets").option("streams", '[{"stream_type": 0, "width": 8, "height": 8}, {"stream_type": 1}]').mode("append").save(at)
    back = spark.read.format("packets").load(at)
    assert sorted((r.ts_us, bytes(r.payload)) for r in back.collect()) == sorted((r.ts_us, bytes(r.payload)) for r in rows.collect())
    assert spark.read.format("packets").option("payload", "false").load(at).where("payload is null").count() == 40
    assert spark.read.format("packets").option("table", "streams").load(at).count() == 6


def test_container_stream_takes_each_file_once(spark, tmp_path):
    spark.dataSource.register(container.ContainerSource)
    at, state, out = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "out")
    at.mkdir()
    for name in ("part-b", "part-a"):  # the second one sorts before the first
        with open(at / name, "wb") as f:
            container.write_header(f, [container.Stream(container.VIDEO)])
            container.write_packet(f, 0, 0, 0, name.encode())
        run = spark.readStream.format("packets").load(str(at)).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        run.awaitTermination()
    assert sorted(bytes(r.payload) for r in spark.read.parquet(out).collect()) == [b"part-a", b"part-b"]


def test_container_overwrite_and_append(spark, tmp_path):
    spark.dataSource.register(container.ContainerSource)
    at, about = str(tmp_path / "c"), '[{"stream_type": 0}]'
    rows = spark.range(6).selectExpr("0 stream_id", "0 stream_type", "id ts_us", "cast('p' as binary) payload")
    for mode, want in (("overwrite", 6), ("append", 12), ("overwrite", 6)):
        rows.write.format("packets").option("streams", about).mode(mode).save(at)
        assert spark.read.format("packets").load(at).count() == want
    assert not [p for p in os.listdir(at) if p.startswith(".")]


def test_raw_audio_round_trip():
    out = io.BytesIO()
    container.write_audio(out, 44_100, 2, 16, 8, [b"ab", b"", b"cde"])
    out.seek(0)
    assert container.read_audio(out) == ({"sample_rate": 44_100, "channels": 2, "bit_depth": 16, "quality": 8}, [b"ab", b"", b"cde"])


def test_generators(spark):
    assert generators.pictures(spark, "gradient", 8, 2).where("picture = 1 and x = 1 and y = 2").select("r", "g", "b").first() == (8, 8, 8)
    s = 12345
    want = []
    for _ in range(3):
        s = (s * 1664525 + 1013904223) % 2**32
        want.append(s & 255)
    assert generators.noise(spark, 1, 3).first().v == want
    assert abs(generators.sine(spark, 10).agg(F.max("v")).first()[0]) <= 0.5


def test_group_buffer_orders_flushes_and_forces():
    b = GroupBuffer()
    got = [b.push(i) for i in range(5)]
    assert got[0] == [(0, 0, -1)] and got[1:4] == [[], [], []]
    assert [x[0] for x in got[4]] == [4, 2, 1, 3]
    assert b.push(5) == b.push(6) == []
    assert b.push(9, "force") == [(6, 0, 1), (5, 1, 1), (9, 0, -1)]
    assert b.push(10) == [] and b.push(0, "end") == [(10, 0, 0)] and b.flush() == []


def test_metrics_are_written_as_csv(spark, tmp_path):
    write_metrics(spark.range(3).selectExpr("id picture", "id * 1.5 psnr"), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 3


def test_many_blocks_are_transformed_as_one_by_one():
    rng = np.random.default_rng(17)
    blocks = rng.integers(-255, 256, (40, 8, 8))
    levels = picture_coder.forward8(blocks)
    assert (levels == np.stack([picture_coder.forward8(b) for b in blocks])).all()
    for qp in (8, 20):
        for intra in (False, True):
            q = picture_coder.quantize8(levels, qp, intra)
            d = picture_coder.dequantize8(q, qp, intra)
            for k in range(40):
                one = picture_coder.quantize8(levels[k], qp, intra)
                back = picture_coder.dequantize8(one, qp, intra)
                assert (q[k] == one).all() and (d[k] == back).all()
                assert (picture_coder.inverse8(d)[k] == picture_coder.inverse8(back)).all()
