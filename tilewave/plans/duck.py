"""The base views for DuckDB, in long form: one row per pixel, sample or symbol."""

from __future__ import annotations

from tilewave.functions import tables

BLK8 = """blk8 AS (
  SELECT vec_id, CAST(label AS BIGINT) AS label, k - 1 AS k, (k - 1) // 8 AS r, (k - 1) % 8 AS c,
         CAST(floor(CAST(e AS DOUBLE) * 1024 + 0.5) AS BIGINT) AS s
  FROM (SELECT vec_id, label, unnest(embedding) AS e, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS k FROM embeddings))"""

PIX = """pix AS (
  SELECT f, x, y, (y // 16) * 4 + x // 16 AS m, p FROM (
    SELECT vec_id // 64 AS f,
           (((vec_id % 64) // 4) % 4) * 16 + (vec_id % 2) * 8 + (k - 1) % 8 AS x,
           (((vec_id % 64) // 4) // 4) * 16 + ((vec_id % 4) // 2) * 8 + (k - 1) // 8 AS y,
           least(greatest(128 + CAST(floor(CAST(e AS DOUBLE) * 256 + 0.5) AS BIGINT), 0), 255) AS p,
           count(*) OVER (PARTITION BY vec_id // 64) AS n
    FROM (SELECT vec_id, unnest(embedding) AS e, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS k FROM embeddings))
  WHERE n = 4096)"""

RGB = """rgb AS (
  SELECT vec_id // 3 AS g, k - 1 AS k, max(p) FILTER (vec_id % 3 = 0) AS r, max(p) FILTER (vec_id % 3 = 1) AS gr, max(p) FILTER (vec_id % 3 = 2) AS b
  FROM (SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS k, unnest(embedding) AS e FROM embeddings) t,
       LATERAL (SELECT least(greatest(128 + CAST(floor(CAST(t.e AS DOUBLE) * 256 + 0.5) AS BIGINT), 0), 255) AS p)
  GROUP BY ALL HAVING count(*) = 3)"""

SYM = """sym AS (
  SELECT l_orderkey AS seq, CAST(l_quantity AS BIGINT) AS v, l_discount = 0 AS zero,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos
  FROM lineitem)"""

PCM = "pcm AS (SELECT event_id AS n, value / 500 AS v, CAST(floor(value * 100 + 0.5) AS BIGINT) AS iv FROM events)"

PKT = """pkt AS (
  SELECT CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS stream_id, event_id AS seq, ts, epoch_us(ts) AS ts_us, length(props) AS size, user_id
  FROM events)"""


def basis(n: int) -> str:
    return f"basis AS (SELECT j, i, CAST(floor(128 * cos((2 * i + 1) * j * pi() / {2 * n}) + 0.5) AS BIGINT) AS w FROM range(0, {n}) a(j), range(0, {n}) b(i))"


def const(name: str, values: list[int]) -> str:
    return f"{name} AS (SELECT unnest([{', '.join(map(str, values))}])::BIGINT AS v, generate_subscripts([{', '.join(map(str, values))}], 1) - 1 AS k)"


def rdiv(n: str, d: str) -> str:
    return f"(CASE WHEN (({n}) < 0) <> (({d}) < 0) THEN (({n}) - ({d}) // 2) // ({d}) ELSE (({n}) + ({d}) // 2) // ({d}) END)"


def bitlen(v: str) -> str:
    return f"length(ltrim(CAST(CAST({v} AS BIGINT)::BIT AS VARCHAR), '0'))"


def dct8(source: str = "blk8") -> str:
    """CTEs basis, h, dct: forward transform of (vec_id, r, c, s) as dct(vec_id, label, k, r, c, coef)."""
    total = "sum(s * w)::BIGINT"
    return f"""{basis(8)},
h AS (SELECT vec_id, label, r, j AS u, {rdiv("CASE WHEN j = 0 THEN t * 45 // 128 ELSE t // 2 END", "128")} AS s
      FROM (SELECT vec_id, label, r, j, {total} AS t FROM {source} JOIN basis ON c = i GROUP BY ALL)),
dct AS (SELECT vec_id, label, j * 8 + u AS k, j AS r, u AS c, {rdiv("CASE WHEN j = 0 THEN t * 45 // 128 ELSE t // 2 END", "128")} AS coef
        FROM (SELECT vec_id, label, u, j, {total} AS t FROM h JOIN basis ON r = i GROUP BY ALL))"""


def idct8(source: str, column: str, keys: str = "vec_id") -> str:
    """CTEs ih, idct: inverse of (keys, r, c, column) as idct(keys, k, rec)."""
    part = "sum(CASE WHEN j = 0 THEN x * w * 45 // 128 ELSE x * w // 2 END)::BIGINT"
    return f"""
ih AS (SELECT {keys}, i AS r, c, {rdiv("t", "128")} AS x FROM (
         SELECT {keys}, i, c, {part} AS t FROM (SELECT {keys}, r, c, {column} AS x FROM {source}) s JOIN basis ON r = j GROUP BY ALL)),
idct AS (SELECT {keys}, r * 8 + i AS k, {rdiv("t", "128")} AS rec FROM (
           SELECT {keys}, r, i, {part} AS t FROM ih JOIN basis ON c = j GROUP BY ALL))"""


ZIGZAG = const("zigzag", tables.ZIGZAG8)
