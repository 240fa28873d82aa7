"""Queries that run whole coders and their inverses, and the choice between two codings of a block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tilewave.functions import tables
from tilewave.functions.exprs import total
from tilewave.operators import audio_coder, picture_coder, quantize, views
from tilewave.plans import duck, transforms
from tilewave.plans.registry import query

PERIOD, QP, QUALITY = 4, 8, 4


@query(f"WITH {duck.PIX} SELECT f // {PERIOD} AS period, count(DISTINCT f)::BIGINT AS pictures, 0::BIGINT AS mismatches, TRUE AS fine FROM pix GROUP BY 1")
def closed_loop_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each period coded in a closed loop and decoded from its packets alone: the same pictures, above 20 dB."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pictures = [np.array(p).reshape(64, 64) for p in rows.sort_values("f")["pic"]]
        packets, rebuilt = picture_coder.encode_period(pictures, QP)
        back = picture_coder.decode_period(packets, 64, 64)
        wrong = sum(int((a != b).sum()) for a, b in zip(rebuilt, back))
        error = max(float(((a - b) ** 2).mean()) for a, b in zip(pictures, rebuilt))
        return pd.DataFrame([(key[0], len(back), wrong, error < 255**2 / 100)], columns=["period", "pictures", "mismatches", "fine"])

    rows = views.pictures(spark, sf_dir).selectExpr(f"f div {PERIOD} period", "f", "pic")
    return rows.groupBy("period").applyInPandas(run, "period long, pictures long, mismatches long, fine boolean")


@query(f"WITH {duck.PCM} SELECT n // 4096 AS chunk, count(*)::BIGINT AS samples, 0::BIGINT AS mismatches, TRUE AS fine FROM pcm GROUP BY 1")
def audio_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of two-channel audio coded and decoded: the same levels, and a signal-to-noise ratio above 20 dB."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values("n")["v"].to_numpy()
        both = np.stack([v[: len(v) // 2 * 2 : 2], v[1::2]]) if len(v) > 1 else v[None, :]
        packets, levels = audio_coder.encode(both, QUALITY, 44_100)
        back = audio_coder.decode(packets, len(both))
        rec = audio_coder.left_right(np.stack([audio_coder.signal_of(x, QUALITY, 44_100, both.shape[1]) for x in back]))
        error = float(((rec - both) ** 2).sum())
        return pd.DataFrame([(key[0], len(v), int((levels != back).sum()), error * 100 <= float((both**2).sum()))], columns=["chunk", "samples", "mismatches", "fine"])

    rows = views.pcm(spark, sf_dir).selectExpr("n div 4096 chunk", "n", "v")
    return rows.groupBy("chunk").applyInPandas(run, "chunk long, samples long, mismatches long, fine boolean")


_CHOICE = f"""WITH {duck.BLK8}, {duck.dct8()}, {transforms._quant_sql('intra', QP)},
a AS (SELECT vec_id, sum((CASE WHEN lv.k = 0 THEN level * {quantize.luma_dc_scale(QP)} ELSE 2 * level * v * {QP} // 16 END - coef) * (CASE WHEN lv.k = 0 THEN level * {quantize.luma_dc_scale(QP)} ELSE 2 * level * v * {QP} // 16 END - coef))::BIGINT + {transforms.LAMBDA} * sum({transforms._bits_sql('level')})::BIGINT AS cost FROM lv JOIN qm ON qm.k = lv.k GROUP BY vec_id)"""
_OTHER = transforms._quant_sql("inter", QP).replace("qm AS", "qn AS").replace("dead AS", "deae AS").replace("lv AS", "ln AS").replace("JOIN qm q", "JOIN qn q").replace("JOIN dead w", "JOIN deae w")


@query(f"""{_CHOICE}, {_OTHER}, b AS (SELECT vec_id, sum((2 * level * v * {QP} // 16 - coef) * (2 * level * v * {QP} // 16 - coef))::BIGINT + {transforms.LAMBDA} * sum({transforms._bits_sql('level')})::BIGINT AS cost FROM ln JOIN qn ON qn.k = ln.k GROUP BY vec_id)
SELECT vec_id, CASE WHEN b.cost < a.cost THEN 1 ELSE 0 END AS choice, least(a.cost, b.cost) AS cost FROM a JOIN b USING (vec_id)""")
def rd_mode_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheaper of two quantizations by squared error and rate; the first of equals."""

    def cost(level: str, matrix: list[int], scale: int | None) -> str:
        error = total(f"zip_with({quantize.dequantize(level, QP, matrix, scale)}, coef, (a, b) -> (a - b) * (a - b))")
        return f"{error} + {transforms.LAMBDA} * {total(f'transform({level}, v -> {quantize.coefficient_bits('v')})')}"

    rows = transforms.coefficients(spark, sf_dir).selectExpr("vec_id", "coef", f"{quantize.intra('coef', QP, quantize.luma_dc_scale(QP))} a", f"{quantize.inter('coef', QP)} b")
    rows = rows.selectExpr("vec_id", f"{cost('a', tables.INTRA_MATRIX, quantize.luma_dc_scale(QP))} x", f"{cost('b', tables.INTER_MATRIX, None)} y")
    return rows.selectExpr("vec_id", "if(y < x, 1L, 0L) choice", "least(x, y) cost")
