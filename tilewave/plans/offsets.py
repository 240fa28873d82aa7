"""The offsets found for each block, applied to its three planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewave.operators import sample_offsets, views
from tilewave.plans.filters import _CPICS, _OFFSET, _STEPS, RATE, chroma_planes
from tilewave.plans.registry import query

_PLANES = f"""WITH {_CPICS}, pl AS (
 SELECT a.f, 0 AS kind, 0 AS plane, a.x, a.y, a.m, a.p AS s, b.p AS r, 64 AS side FROM pix a JOIN pix b ON b.f + 1 = a.f AND b.x = a.x AND b.y = a.y
 UNION ALL SELECT a.f, 1, k, a.x, a.y, a.y // 8 * 4 + a.x // 8, CASE k WHEN 0 THEN a.u ELSE 255 - a.u END, CASE k WHEN 0 THEN b.u ELSE 255 - b.u END, 32 FROM cpix a JOIN cpix b ON b.f + 1 = a.f AND b.x = a.x AND b.y = a.y, range(0, 2) t(k)),
st AS (SELECT unnest([0, 1, 2, 3]) AS class, unnest([{', '.join(str(x) for x, _ in _STEPS)}]) AS dx, unnest([{', '.join(str(y) for _, y in _STEPS)}]) AS dy),
e AS (SELECT c.*, class, CASE WHEN n.r IS NOT NULL AND o.r IS NOT NULL THEN sign(n.r - c.r) + sign(o.r - c.r) ELSE 0 END::BIGINT AS category
 FROM (SELECT * FROM pl, st) c LEFT JOIN pl n ON n.f = c.f AND n.kind = c.kind AND n.plane = c.plane AND n.x = c.x - dx AND n.y = c.y - dy LEFT JOIN pl o ON o.f = c.f AND o.kind = c.kind AND o.plane = c.plane AND o.x = c.x + dx AND o.y = c.y + dy),
cells AS (SELECT f, kind, m, 'band' AS how, r // 8 AS slot, -1 AS class, sum(s - r)::BIGINT AS err, count(*)::BIGINT AS n FROM pl GROUP BY ALL
 UNION ALL SELECT f, kind, m, 'edge', category, class, sum(s - r)::BIGINT, count(*)::BIGINT FROM e WHERE category <> 0 GROUP BY ALL),
offs AS (SELECT *, {_OFFSET.format(div='//')} AS off FROM cells),
gain AS (SELECT *, 2 * off * err - n * off * off AS gain, CASE WHEN off = 0 THEN 1 ELSE 4 END AS bits FROM offs),
cand AS (SELECT f, kind, m, 0 AS seq, 0 AS gain, 2 AS bits FROM (SELECT DISTINCT f, kind, m FROM offs)
 UNION ALL SELECT g.f, g.kind, g.m, 1 + s, sum(gain), 7 + 4 - count(*) + sum(bits) FROM gain g, range(0, 29) o(s) WHERE how = 'band' AND slot BETWEEN s AND s + 3 GROUP BY g.f, g.kind, g.m, s HAVING max(abs(off)) > 0
 UNION ALL SELECT f, kind, m, 30 + class, sum(gain), 4 + 4 - count(*) + sum(bits) FROM gain WHERE how = 'edge' GROUP BY f, kind, m, class HAVING max(abs(off)) > 0),
best AS (SELECT f, kind, m, arg_min(seq, struct_pack(c := {RATE} * bits - gain, s := seq))::BIGINT AS choice, min({RATE} * bits - gain)::BIGINT AS cost FROM cand GROUP BY f, kind, m),
made AS (SELECT p.*, choice, cost, least(greatest(p.r + coalesce(bo.off, eo.off, 0), 0), 255) AS o FROM pl p JOIN best USING (f, kind, m)
 LEFT JOIN offs bo ON bo.f = p.f AND bo.kind = p.kind AND bo.m = p.m AND bo.how = 'band' AND bo.slot = p.r // 8 AND choice BETWEEN 1 AND 29 AND bo.slot BETWEEN choice - 1 AND choice + 2
 LEFT JOIN e ON choice >= 30 AND e.f = p.f AND e.kind = p.kind AND e.plane = p.plane AND e.x = p.x AND e.y = p.y AND e.class = choice - 30
 LEFT JOIN offs eo ON eo.f = p.f AND eo.kind = p.kind AND eo.m = p.m AND eo.how = 'edge' AND eo.class = e.class AND eo.slot = e.category)"""


@query(f"""{_PLANES} SELECT f, kind, m, any_value(choice) AS choice, any_value(cost) AS cost, sum((s - r) * (s - r))::BIGINT AS before, sum((s - o) * (s - o))::BIGINT AS after, sum(o * (y * side + x + 1) * (plane + 1))::BIGINT AS checksum FROM made GROUP BY f, kind, m""")
def offset_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By block, kind 0 luma and 1 chroma: the offsets of least cost, and the squared error before and after they are applied. Both
    chroma planes count for their choice, and take it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                a, b, ca, cb = (c.flatten().to_numpy().astype(np.int64) for c in part.columns[1:])
                n, out = part.num_rows, []
                for kind, planes in ((0, [(a.reshape(n, 64, 64), b.reshape(n, 64, 64))]), (1, [(x, y) for x, y in zip(ca.reshape(n, 2, 32, 32).swapaxes(0, 1), cb.reshape(n, 2, 32, 32).swapaxes(0, 1))])):
                    stats = [sample_offsets.statistics(x, y) for x, y in planes]
                    c = sample_offsets.chosen(sum(s[0] for s in stats), sum(s[1] for s in stats), RATE)
                    sums = np.zeros((3, n * 16), np.int64)
                    for k, (x, y) in enumerate(planes):
                        o, side = sample_offsets.applied(y, c), y.shape[1]
                        at = (np.arange(n)[:, None, None] * 16 + sample_offsets.block_of(side)).ravel()
                        weight = (np.arange(side * side).reshape(side, side) + 1) * (k + 1)
                        for j, v in enumerate(((x - y) ** 2, (x - o) ** 2, o * weight)):
                            sums[j] += np.bincount(at, v.ravel(), n * 16).astype(np.int64)
                    f = np.repeat(part.column(0).to_numpy(), 16)
                    out.append([f, np.full(n * 16, kind), np.tile(np.arange(16), n), c.choice.ravel(), c.cost.ravel(), *sums])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], ["f", "kind", "m", "choice", "cost", "before", "after", "checksum"])

    pictures = views.pictures(spark, sf_dir)
    chroma = chroma_planes(spark, sf_dir).groupBy(F.expr("f div 2 f")).agg(F.sort_array(F.collect_list(F.struct("f", "pic"))).alias("s")).selectExpr("f", "concat(s[0].pic, s[1].pic) c")
    whole = pictures.join(chroma, "f")
    pairs = whole.selectExpr("f", "pic a", "c ca").join(whole.selectExpr("f + 1 f", "pic b", "c cb"), "f")
    narrow = pairs.selectExpr("f", *[f"cast({c} as array<smallint>) {c}" for c in ("a", "b", "ca", "cb")])
    return narrow.mapInArrow(run, ", ".join(f"{c} long" for c in ("f", "kind", "m", "choice", "cost", "before", "after", "checksum")))
