"""Bit buffers, codes, long counts and damaged containers against brute force."""

import io
import random

import numpy as np
import pytest

from tilewave.functions import bits, exprs
from tilewave.operators import adaptive_counts, arithmetic_coder
from tilewave.sources import container


def words_of(text):
    return [int(text[k : k + 32].ljust(32, "0")[::-1], 2) for k in range(0, len(text), 32)]


def test_buffers_are_cut_and_pasted_at_any_bit(spark):
    rng = random.Random(1)
    rows = []
    for k in range(400):
        src, dst = ("".join(rng.choice("01") for _ in range(32 * rng.randint(1, 4))) for _ in range(2))
        n = rng.choice([1, 31, 32, 33, rng.randint(1, min(len(src), len(dst)))])
        n = min(n, len(src), len(dst))
        rows.append((k, src, dst, words_of(src), words_of(dst), rng.randint(0, len(src) - n), rng.randint(0, len(dst) - n), n))
    df = spark.createDataFrame(rows, "k long, s string, d string, src array<long>, dst array<long>, a long, b long, n long")
    out = df.selectExpr("*", f"{bits.shifted('src', 'a', 'n')} cut", f"{bits.pasted('dst', 'b', 'src', 'a', 'n')} whole", f"{bits.read('src', 'a', 'least(n, 32L)')} got")
    for r in out.collect():
        part = r.s[r.a : r.a + r.n]
        assert r.cut == words_of(part)
        assert r.whole == words_of(r.d[: r.b] + part + r.d[r.b + r.n :])
        assert r.got == words_of(part[:32])[0]


def test_codes_are_packed_and_read_back(spark):
    rng = random.Random(2)
    values = [[rng.choice([0, 0, 1, -1, rng.randint(-40_000, 40_000)]) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "v array<long>").selectExpr("v", f"array_join(transform(v, x -> {bits.golomb(exprs.signed_code('x'))}), '') code")
    step = f"named_struct('at', {bits.golomb_stop('c', 'a.at')}, 'out', concat(a.out, array({bits.signed_of(bits.golomb_value('c', 'a.at'))})))"
    back = exprs.let("code", "c", f"aggregate(v, named_struct('at', 1, 'out', cast(array() as array<bigint>)), (a, i) -> {step}).out")
    for r in df.selectExpr("v", "code", f"{back} back", f"{bits.packed_hex('code')} hex").collect():
        assert r.back == r.v
        assert arithmetic_coder.pack([int(x) for x in r.code]).hex() == r.hex


@pytest.mark.parametrize("limit", [4, 7, 50, 65536])
def test_long_counts_equal_the_coders(limit, monkeypatch):
    monkeypatch.setattr(arithmetic_coder, "LIMIT", limit)
    symbols = (np.random.default_rng(limit).random(3 * min(limit, 40_000) + 60) < 0.3).astype(int)
    coder = arithmetic_coder.Encoder()
    want, bits_ = [], 0.0
    for bit in symbols.tolist():
        coder.middle(0)
        n = coder.counts[0]
        want.append(n[1])
        bits_ -= np.log2(n[bit] / sum(n))
        coder.narrow(bit, 0)
        coder.low, coder.high = 0, arithmetic_coder.TOP
    found = adaptive_counts.cost(symbols, limit)
    assert found.ones.tolist() == want and abs(found.bits - bits_) < 1e-6 * bits_
    assert found.halvings > 0


def test_damage_is_named_and_reading_goes_on():
    rng = random.Random(5)
    for trial in range(60):
        out = io.BytesIO()
        container.write_header(out, [container.Stream(container.VIDEO), container.Stream(container.AUDIO)])
        places = []
        for k in range(30):
            at = out.tell()
            container.write_packet(out, k % 2, k % 2, 1000 * k, bytes(rng.randrange(97, 123) for _ in range(rng.randint(1, 40))))
            places.append((at, out.tell()))
        data = bytearray(out.getvalue())
        hurt = sorted(rng.sample(range(30), rng.randint(0, 8)))
        for k in hurt:
            at = places[k][0]
            how = rng.randrange(3)
            if how == 0:
                data[at : at + 2] = b"\x00\x00"
            elif how == 1:
                data[at + 2] = 9  # a stream that isn't described
            else:
                data[at + 12 : at + 16] = b"\xff\xff\xff\xff"  # longer than the file
        src = io.BytesIO(bytes(data))
        container.read_streams(src)
        rows = list(container.read_damaged(src, len(data), {0: 0, 1: 1}, piece=rng.choice([2, 3, 17, 1 << 16])))
        good = [r for r in rows if r[1] >= 0]
        assert [r[3] // 1000 for r in good] == [k for k in range(30) if k not in hurt]
        assert [r[0] for r in good] == list(range(len(good)))
        lost = sum(b - a for k, (a, b) in enumerate(places) if k in hurt)
        assert sum(r[4] for r in rows if r[1] < 0) == lost
        assert all(r[6] is not None for r in good)
    # a file that is cut off inside its last packet
    src = io.BytesIO(out.getvalue()[:-1])
    container.read_streams(src)
    rows = list(container.read_damaged(src, len(out.getvalue()) - 1, {0: 0, 1: 1}))
    assert len(rows) == 30 and rows[-1][1] == -1 and rows[-1][5] == places[-1][0]


def test_blocks_of_a_stream_hand_on_their_counts(spark):
    """Blocks anywhere between two halvings, and no task holds more of a stream than one of them."""
    from tilewave.plans import bitstreams

    rng = np.random.default_rng(11)
    lines = [(s, int(k), int(v), 0, 0.5) for s, n in ((1, 25_000), (2, 7)) for k, v in enumerate(rng.integers(0, 1 << 14, n) & rng.integers(0, 1 << 14, n))]
    shuffled = [lines[i] for i in rng.permutation(len(lines))]
    got = bitstreams.counted(spark, spark.createDataFrame(shuffled, "stream long, a long, b long, c long, d double"), 997).toPandas()
    assert got["n"].max() <= 100_000 and (got["stream"] == 1).sum() >= 3
    for stream in (1, 2):
        want = adaptive_counts.cost(adaptive_counts.low_bits(np.array([b for s, _, b, _, _ in lines if s == stream]), 10), 997)
        own = got[got["stream"] == stream]
        assert (own["n"].sum(), own["halvings"].sum(), own["checksum"].sum()) == (want.n, want.halvings, (want.ones % 9973).sum())
        assert abs(own["cost"].sum() - want.bits) < 1e-6


@pytest.mark.parametrize("limit", [65536, 40])
def test_sequences_side_by_side_are_coded_as_one_by_one(monkeypatch, limit):
    import time

    from tilewave.plans import codes

    monkeypatch.setattr(arithmetic_coder, "LIMIT", limit)
    rng = np.random.default_rng(limit)
    counts = np.r_[1, 0, 400, rng.integers(1, 8, 3000)]
    values = np.where(rng.random(counts.sum()) < 0.02, rng.integers(0, 1 << 50, counts.sum()), rng.integers(0, 51, counts.sum()) * (rng.random(counts.sum()) < 0.7))
    want = codes._one_by_one(values, counts)
    got = codes._side_by_side(values, counts)
    assert got[0] == want[0] and (got[1] == values).all() and (want[1] == values).all()
    assert codes._side_by_side(values[:0], counts[:0])[0] == []
    short = np.full(20_000, 4)
    began = time.process_time()
    codes._side_by_side(rng.integers(1, 51, short.sum()), short)
    assert time.process_time() - began < 4  # 12 one by one
