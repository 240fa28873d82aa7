"""Quantization of 8x8 coefficient blocks, and rate-distortion trimming. SQL text of array expressions."""

from __future__ import annotations

from tilewave.functions import tables
from tilewave.functions.exprs import array, bit_length, clip, floor_log2, let, rdiv


def luma_dc_scale(qp: int) -> int:
    return max(2 * qp, 2) if qp < 9 else qp + 8 if qp < 25 else 2 * qp - 16


def chroma_dc_scale(qp: int) -> int:
    return max(2 * qp, 2) if qp < 5 else (qp + 13) >> 1 if qp < 25 else qp - 6


def chroma_qp(qp: int) -> int:
    return min(qp + 2, 63)


def quality_to_qp(quality: str) -> str:
    q = clip(quality, 1, 31)
    return f"least(case when {q} <= 16 then {q} else {q} + ({q} - 16) * ({q} - 16) div 10 end, 63)"


def quality_lambda(q: str) -> str:
    return f"0.85D * pow(2D, (({q}) - 12) / 3D)"


def intra(a: str, qp: int, dc_scale: int) -> str:
    qm, weight = array(tables.INTRA_MATRIX), array(tables.INTRA_DEADZONE)
    f = rdiv("src[k] * 16", f"{qm}[k]")
    if qp >= 16:
        f = let(f, "g", f"g - shiftright(cast(sign(g) as bigint) * {qp} * {weight}[k], 1)")
    level = let(f, "g", rdiv("g", str(2 * qp)))
    return let(a, "src", f"transform(sequence(0, 63), k -> case when k = 0 then {rdiv('src[0]', str(dc_scale))} else {level} end)")


def inter(a: str, qp: int) -> str:
    qm = array(tables.INTER_MATRIX)
    weight = array([min(w + 1, 6) if qp >= 16 else w for w in tables.INTER_DEADZONE])
    f = rdiv("src[k] * 16", f"{qm}[k]")
    level = let(f, "g", rdiv(f"g - shiftright(cast(sign(g) as bigint) * {qp} * {weight}[k], 1)", str(2 * qp)))
    return let(a, "src", f"transform(sequence(0, 63), k -> {level})")


def linear(a: str, qp: int, dc_scale: int | None) -> str:
    """The plain variant without matrices; dc_scale for intra blocks."""
    ac = f"cast(sign(src[k]) as bigint) * {rdiv(f'abs(src[k]) - {qp >> 1}', str(2 * qp))}"
    if dc_scale is not None:
        ac = f"case when k = 0 then {rdiv('src[0]', str(dc_scale))} else {rdiv('src[k]', str(2 * qp))} end"
    return let(a, "src", f"transform(sequence(0, 63), k -> {ac})")


def dequantize(a: str, qp: int, matrix: list[int], dc_scale: int | None) -> str:
    value = f"2 * src[k] * {array(matrix)}[k] * {qp} div 16"
    if dc_scale is not None:
        value = f"case when k = 0 then src[0] * {dc_scale} else {value} end"
    return let(a, "src", f"transform(sequence(0, 63), k -> {value})")


def adaptive_qp(variance: str, quality: int) -> str:
    index = clip(f"{floor_log2(variance)} div 2", 1, 63)
    return clip(f"{quality} + {clip(f'shiftright({index} - {quality}, 1)', -6, 6)}", 1, 63)


def coefficient_bits(v: str) -> str:
    a = f"least(abs({v}), 255)"
    return f"(case when {a} = 0 then 1L when {a} = 1 then 3L when {a} = 2 then 4L else 4 + 2 * {bit_length(f'greatest({a} - 2, 1)')} end)"
