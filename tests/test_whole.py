"""Queries that do the whole job where a query with SQL does a part, against brute force."""

import duckdb
import numpy as np

from tilewave.plans.catalogue import QUERIES


def test_all_coefficients_are_quantized_and_come_back(spark, sf_dir):
    from tilewave.operators import audio_coder

    rows = duckdb.sql(f"SELECT event_id, value / 500 FROM '{sf_dir}/events.parquet'").fetchall()
    x = np.zeros(max(n for n, _ in rows) + 1)
    for n, v in rows:
        x[n] = v
    want = audio_coder.levels_of(x, 8, 44_100)
    got = QUERIES["audio_quantize"](spark, sf_dir).toPandas()
    assert len(got) == want.size and (want[got["frame"], got["k"]] == got["level"]).all()
    assert (got.loc[got["k"] >= 16, "level"] != 0).any()
    back = QUERIES["mdct_inverse"](spark, sf_dir).toPandas()
    assert len(back) == len(rows) and np.allclose(back["rec"], audio_coder.signal_of(want, 8, 44_100, len(x))[back["n"]], atol=1e-5)


def moved_pictures():
    now = np.random.default_rng(3).integers(0, 256, (64, 64))
    return now, np.roll(now, (13, -22), (0, 1))


def test_wide_searches_find_far_moves():
    from tilewave.operators import block_search, picture_coder

    now, before = moved_pictures()
    assert block_search.full(block_search.sads(now[16:32, 32:48], before), 32, 16, 4) == (-22, 13, 4 * 36)
    sizes = [len(picture_coder.encode_period([before, now], 8, radius)[0][1]) for radius in (2, 16)]
    assert sizes[1] < 0.85 * sizes[0]


def test_ring_search_finds_what_a_full_search_finds():
    from tilewave.operators import block_search

    rng = np.random.default_rng(5)
    now = rng.integers(0, 256, (5, 64, 64)).astype(np.int16)
    ref = np.stack([np.roll(now[0], (13, -22), (0, 1)), now[1], np.full((64, 64), 128), rng.integers(0, 2, (64, 64)), now[4] // 2]).astype(np.int16)
    now[3] = ref[3].T
    dx, dy, cost, compared = block_search.ring_search(now, ref, 4)
    for k in range(5):
        for m in range(16):
            x, y = m % 4 * 16, m // 4 * 16
            assert (dx[k, m], dy[k, m], cost[k, m]) == block_search.full(block_search.sads(now[k, y : y + 16, x : x + 16].astype(int), ref[k].astype(int)), x, y, 4)
    assert compared[1].max() == 1  # no motion: the bound rules all else out


def test_pruning_spares_most_places_of_smooth_pictures():
    from tilewave.operators import block_search

    y, x = np.mgrid[0:64, 0:64]
    now = np.stack([(x * 3 + y) % 256, 120 + 100 * np.sin(x / 9) * np.cos(y / 7)]).astype(np.int16)
    _, _, _, compared = block_search.ring_search(now, np.roll(now, (2, 3), (1, 2)), 4)
    assert compared.mean() < 0.2 * 33 * 33


def test_subsample_search_equals_brute_force():
    from tilewave.operators import block_search

    rng = np.random.default_rng(7)
    ref = rng.integers(0, 256, (64, 64))
    at = lambda x, y: int(ref[min(max(y, 0), 63), min(max(x, 0), 63)])
    tap = lambda f: (sum(w * f(o) for w, o in zip((1, -5, 20, 20, -5, 1), range(-2, 4))) + 16) >> 5

    def half(x, y, u, v):
        if not v:
            return tap(lambda o: at(x + min(u, 0) + o, y))
        if not u:
            return tap(lambda o: at(x, y + min(v, 0) + o))
        return tap(lambda o: tap(lambda i: at(x + min(u, 0) + i, y + min(v, 0) + o)))

    now = np.array([[half(x, y, -1, 1) for x in range(64)] for y in range(64)])
    now[:16, :16] = [[(at(x, y) + half(x, y, 1, 0) + 1) >> 1 for x in range(16)] for y in range(16)]
    now[48:, 48:] = ref[48:, 48:]
    zero = np.zeros((1, 16), int)
    place, sad, made = block_search.subsample_search(now[None].astype(np.int16), ref[None].astype(np.int16), zero, zero)
    for m in range(16):
        x0, y0 = m % 4 * 16, m // 4 * 16
        best = (np.abs(now - ref)[y0 : y0 + 16, x0 : x0 + 16].sum(), -1)
        for k, (u, v) in enumerate([(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]):
            if 0 <= x0 + u <= 48 and 0 <= y0 + v <= 48:
                block = np.array([[half(x, y, u, v) for x in range(x0, x0 + 16)] for y in range(y0, y0 + 16)])
                for q, b in ((0, block), (1, (ref[y0 : y0 + 16, x0 : x0 + 16] + block + 1) >> 1)):
                    best = min(best, (np.abs(now[y0 : y0 + 16, x0 : x0 + 16] - b).sum(), 2 * k + q))
        assert (sad[0, m], place[0, m]) == best
        assert np.abs(now[y0 : y0 + 16, x0 : x0 + 16] - made[0, m]).sum() == sad[0, m]
    assert place[0, 0] == 9 and place[0, 15] == -1 and sad[0, 5] == 0


def test_slots_hold_what_was_put_there_last(spark):
    from tilewave.plans.searches import slot_contents

    rows = [(0, 0, 0, 0, 0, 0), (0, 4, 1, 1, 0, 0), (0, 2, 2, 2, 0, 1), (0, 1, 3, 3, 0, 2), (0, 8, 5, 0, 1, 1), (0, 6, 6, 2, 1, 0), (1, 9, 7, 0, 0, 0), (1, 10, 8, 1, 0, 0)]
    out = slot_contents(spark.createDataFrame(rows, "period long, display long, coded long, slot long, forward long, backward long"))
    got = {r.display: (r.forward_picture, r.backward_picture) for r in out.collect()}
    # those whose slots are empty in their period are left out
    assert got == {4: (0, 0), 2: (0, 4), 1: (0, 2), 8: (4, 4), 6: (4, 8), 10: (9, 9)}


def test_short_chunks_are_resampled(spark, sf_dir, tmp_path):
    duckdb.sql(f"COPY (SELECT * FROM '{sf_dir}/events.parquet' WHERE event_id < 10) TO '{tmp_path}/events.parquet'")
    iv = [v for (v,) in duckdb.sql(f"SELECT CAST(floor(value * 100 + 0.5) AS BIGINT) FROM '{tmp_path}/events.parquet' ORDER BY event_id").fetchall()]
    rows = QUERIES["linear_resample"](spark, str(tmp_path)).collect()
    got = [r.v for r in sorted(rows, key=lambda r: r.n)]
    assert len(iv) == 10 and np.allclose(got, np.interp(np.arange(8) * 4 / 3, np.arange(10), iv), atol=1e-3)


def test_frames_around_a_groups_edges_and_gaps(spark, sf_dir, tmp_path):
    """Samples over three groups of hops, with a gap and one place twice: transform, levels and inverse equal their SQL."""
    from compare import connection, rows_of, sql_rows
    from tilewave.plans.catalogue import SQL
    from tilewave.plans.signals import HOP, SPAN

    edge = SPAN * HOP
    places = f"(SELECT unnest([x.n, x.n + {edge - 2 * HOP}, x.n + {2 * edge - HOP}]) AS n, x.value FROM (SELECT event_id * 3 AS n, value FROM '{sf_dir}/events.parquet') x)"
    duckdb.sql(f"COPY (SELECT n AS event_id, TIMESTAMP '2024-01-01' AS ts, 1::BIGINT AS user_id, 'a' AS event_type, value, 'p' AS props FROM {places} UNION ALL SELECT 6, TIMESTAMP '2024-01-01', 1, 'a', 10.0, 'p') TO '{tmp_path}/events.parquet'")
    con = connection(str(tmp_path))
    for name in ("mdct_low_bands", "audio_frame_code", "mdct_inverse", "bark_bands"):
        assert rows_of(QUERIES[name](spark, str(tmp_path))) == sql_rows(con, SQL[name]), name


def test_no_frame_looks_its_samples_up_one_by_one(spark, sf_dir):
    """A map that the optimizer moves into a lambda is built anew for each element."""
    for name in ("mdct_low_bands", "bark_bands", "audio_frame_code", "mdct_inverse"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "map_from_entries" not in plan, name
