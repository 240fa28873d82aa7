"""Closed-loop picture coding: every block is predicted from what a decoder has already rebuilt.

Serial within an intra period, so it runs in a grouped function keyed by stream and period; state starts anew with
each period. Per 16x16 block: a directional prediction or a motion-compensated one, chosen by squared error and rate; the
residual's four 8x8 blocks are transformed, quantized, trimmed and coded as significance maps with adaptive
contexts. Decisions are coded against their neighbours: modes by the two most probable ones, vectors by the
median of neighbours, quantizers by difference. Encoder and decoder run the same block walk, with a coder that puts or gets.
"""

from __future__ import annotations

import numpy as np

from tilewave.functions import tables
from tilewave.operators import arithmetic_coder as ac
from tilewave.operators import block_search
from tilewave.operators.quantize import luma_dc_scale

BLOCK, NONE = 16, 7
_BASIS = np.array(tables.basis(8), np.int64).reshape(8, 8)
_INTRA, _INTER = (np.array(t, np.int64).reshape(8, 8) for t in (tables.INTRA_MATRIX, tables.INTER_MATRIX))
_INTRA_DEAD, _INTER_DEAD = (np.array(t, np.int64).reshape(8, 8) for t in (tables.INTRA_DEADZONE, tables.INTER_DEADZONE))
_SCANS = {1: tables.HORIZONTAL8, 5: tables.HORIZONTAL8, 2: tables.VERTICAL8, 6: tables.VERTICAL8}
# contexts beside those of coefficients: 0 to 87 intra, 88 to 175 inter
C_INTER, C_COPY, C_MPM, C_INDEX, C_MODE, C_MVD, C_QP, C_SIGN = range(176, 184)


def trunc(n, d):
    """Quotient towards zero."""
    return np.sign(n) * (np.abs(n) // d)


def rdiv(n, d):
    return np.sign(n) * ((np.abs(n) + d // 2) // d)


def _turned(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(x, -1, -2)


def forward8(block: np.ndarray) -> np.ndarray:
    """A block's coefficients, or those of many; so with all that follow."""

    def line(x: np.ndarray) -> np.ndarray:  # over the last axis
        t = x @ _BASIS.T
        return rdiv(np.concatenate([trunc(t[..., :1] * 45, 128), trunc(t[..., 1:], 2)], -1), 128)

    return _turned(line(_turned(line(block))))


def inverse8(coef: np.ndarray) -> np.ndarray:
    def line(x: np.ndarray) -> np.ndarray:
        terms = x[..., :, None] * _BASIS
        terms = np.concatenate([trunc(terms[..., :1, :] * 45, 128), trunc(terms[..., 1:, :], 2)], -2)
        return rdiv(terms.sum(-2), 128)

    return line(_turned(line(_turned(coef))))


def quantize8(coef: np.ndarray, qp: int, intra: bool) -> np.ndarray:
    f = rdiv(coef * 16, _INTRA if intra else _INTER)
    dead = (_INTRA_DEAD if qp >= 16 else 0 * _INTRA_DEAD) if intra else np.minimum(_INTER_DEAD + 1, 6) if qp >= 16 else _INTER_DEAD
    level = rdiv(f - ((np.sign(f) * qp * dead) >> 1), 2 * qp)
    if intra:
        level[..., 0, 0] = rdiv(coef[..., 0, 0], luma_dc_scale(qp))
    return level


def dequantize8(level: np.ndarray, qp: int, intra: bool) -> np.ndarray:
    out = trunc(2 * level * (_INTRA if intra else _INTER) * qp, 16)
    if intra:
        out[..., 0, 0] = level[..., 0, 0] * luma_dc_scale(qp)
    return out


def level_bits(v: int) -> int:
    a = min(abs(v), 255)
    return (1, 3, 4)[a] if a < 3 else 4 + 2 * (a - 2).bit_length()


def trim8(coef: np.ndarray, level: np.ndarray, qp: int, intra: bool, scan: list[int], rate: float) -> np.ndarray:
    """Zeroes the tail while zero is no dearer, then lowers levels by one where that is cheaper. The first is left alone."""
    flat, c = level.ravel().copy(), coef.ravel()

    def cost(p: int, v: int) -> float:
        one = np.zeros((8, 8), np.int64)
        one.flat[p] = v
        return float((c[p] - dequantize8(one, qp, intra).flat[p]) ** 2) + rate * level_bits(v)

    last = max((i for i, p in enumerate(scan) if flat[p]), default=0)
    while last > 0:
        p = scan[last]
        if flat[p] and cost(p, 0) > cost(p, int(flat[p])):
            break
        flat[p] = 0
        last -= 1
    for p in scan[1 : last + 1]:
        v = int(flat[p])
        if v and cost(p, v - (1 if v > 0 else -1)) < cost(p, v):
            flat[p] = v - (1 if v > 0 else -1)
    return flat.reshape(8, 8)


def predictions(recon: np.ndarray, x: int, y: int) -> list[np.ndarray]:
    """The seven directional predictions of a block from its rebuilt neighbours; 128 where there are none."""
    n = BLOCK
    top = recon[y - 1, x : x + n] if y else np.full(n, 128, np.int64)
    left = recon[y : y + n, x - 1] if x else np.full(n, 128, np.int64)
    corner = recon[y - 1, x - 1] if x and y else top[0] if y else left[0] if x else 128
    known = np.r_[top if y else [], left if x else []].astype(np.int64)
    dc = (known.sum() + len(known) // 2) // len(known) if len(known) else 128
    ref = np.r_[left[::-1], corner, top].astype(np.int64)
    cols, rows = np.meshgrid(np.arange(n), np.arange(n))
    three = lambda d: (ref[d - 1] + 2 * ref[d] + ref[d + 1] + 2) >> 2
    two = lambda d: (ref[d] + ref[d + 1] + 1) >> 1
    i = [np.minimum(cols + rows + k, n - 1) for k in range(3)]
    d5, d6 = (np.clip(d, 1, 2 * n - 1) for d in (cols - (rows >> 1) + n, (cols >> 1) - rows + n))
    return [
        np.full((n, n), dc), np.tile(top, (n, 1)), np.tile(left[:, None], (1, n)), (top[i[0]] + 2 * top[i[1]] + top[i[2]] + 2) >> 2,
        three(cols - rows + n), np.where(rows % 2 == 1, three(d5), two(d5)), np.where(cols % 2 == 1, three(d6), two(d6)),
    ]


def probable_modes(left: int | None, top: int | None) -> tuple[int, int]:
    a, b = (0 if m is None or m == NONE else m for m in (left, top))
    return (a, b) if a != b else (0, 1) if a == 0 else (a, 0)


def predicted_vector(vectors: dict, before: dict, bx: int, by: int) -> tuple[int, int]:
    near = [vectors.get((bx - 1, by)), vectors.get((bx, by - 1)), vectors.get((bx + 1, by - 1)) or vectors.get((bx - 1, by - 1))]
    near = [v for v in near if v is not None]
    if len(near) < 3 and (bx, by) in before:
        near.append(before[bx, by])
    if not near:
        return 0, 0
    if len(near) == 1:
        return near[0]
    if len(near) == 2:
        return tuple(int(trunc(a + b, 2)) for a, b in zip(*near))
    return tuple(sorted(v)[1] for v in zip(*near))


class Walk:
    """State of a period: the rebuilt picture before, and the decisions of this and the last picture."""

    def __init__(self, height: int, width: int, qp: int, radius: int = block_search.RADIUS):
        self.height, self.width, self.qp, self.radius = height, width, qp, radius
        self.before: np.ndarray | None = None
        self.last_vectors: dict = {}

    def picture(self, source: np.ndarray | None, coder) -> np.ndarray:
        """Codes source into an Encoder, or rebuilds from a Decoder if source is None."""
        recon = np.zeros((self.height, self.width), np.int64)
        vectors, modes, last_qp = {}, {}, 0
        for y in range(0, self.height, BLOCK):
            for x in range(0, self.width, BLOCK):
                bx, by = x // BLOCK, y // BLOCK
                guess = predicted_vector(vectors, self.last_vectors, bx, by)
                probable = probable_modes(modes.get((bx - 1, by)), modes.get((bx, by - 1)))
                if source is not None:
                    choice = self._choose(source[y : y + BLOCK, x : x + BLOCK], recon, x, y)
                    self._put(coder, choice, guess, probable, last_qp)
                else:
                    choice = self._get(coder, guess, probable, last_qp)
                if not choice["copy"]:
                    last_qp = choice["qp"]
                recon[y : y + BLOCK, x : x + BLOCK] = self._rebuild(recon, x, y, choice)
                modes[bx, by] = choice["mode"]
                if choice["inter"]:
                    vectors[bx, by] = choice["vector"]
        self.before, self.last_vectors = recon, vectors
        return recon

    def _residual(self, block: np.ndarray, prediction: np.ndarray, inter: bool, mode: int) -> tuple[np.ndarray, np.ndarray]:
        """Levels of the four 8x8 blocks, and the rebuilt block."""
        rate = 0.85 * 2 ** ((self.qp - 12) / 3)
        scan = _SCANS.get(mode, tables.ZIGZAG8)
        levels, out = np.zeros((4, 8, 8), np.int64), prediction.copy()
        for q in range(4):
            at = np.s_[q // 2 * 8 : q // 2 * 8 + 8, q % 2 * 8 : q % 2 * 8 + 8]
            coef = forward8((block - prediction)[at])
            levels[q] = trim8(coef, quantize8(coef, self.qp, not inter), self.qp, not inter, scan, rate)
            out[at] += inverse8(dequantize8(levels[q], self.qp, not inter))
        return levels, np.clip(out, 0, 255)

    def _choose(self, block: np.ndarray, recon: np.ndarray, x: int, y: int) -> dict:
        made = predictions(recon, x, y)
        mode = min(range(7), key=lambda k: (np.abs(block - made[k]).sum(), k))
        found = [(False, mode, (0, 0), made[mode])]
        if self.before is not None:
            vector = block_search.full(block_search.sads(block, self.before), x, y, 1, self.radius)[:2]
            found.append((True, NONE, vector, self._moved(x, y, vector)))
        best = None
        for inter, m, vector, prediction in found:
            copy = inter and np.abs(block - prediction).max() < (self.qp >> 2) + 1
            levels, out = (np.zeros((4, 8, 8), np.int64), prediction) if copy else self._residual(block, prediction, inter, m)
            bits = sum(level_bits(int(v)) for v in levels.ravel()) if not copy else 1
            score = float(((block - out) ** 2).sum()) + 0.85 * 2 ** ((self.qp - 12) / 3) * bits
            if best is None or score < best[0]:
                best = (score, {"inter": inter, "copy": copy, "mode": m, "vector": vector, "qp": self.qp, "levels": levels})
        return best[1]

    def _moved(self, x: int, y: int, vector: tuple[int, int]) -> np.ndarray:
        return self.before[y + vector[1] : y + vector[1] + BLOCK, x + vector[0] : x + vector[0] + BLOCK]

    def _rebuild(self, recon: np.ndarray, x: int, y: int, c: dict) -> np.ndarray:
        out = (self._moved(x, y, c["vector"]) if c["inter"] else predictions(recon, x, y)[c["mode"]]).copy()
        if c["copy"]:
            return out
        for q in range(4):
            out[q // 2 * 8 : q // 2 * 8 + 8, q % 2 * 8 : q % 2 * 8 + 8] += inverse8(dequantize8(c["levels"][q], c["qp"], not c["inter"]))
        return np.clip(out, 0, 255)

    def _put(self, coder: ac.Encoder, c: dict, guess: tuple, probable: tuple, last_qp: int) -> None:
        coder.put(int(c["inter"]), C_INTER)
        if c["inter"]:
            coder.put(int(c["copy"]), C_COPY)
            for k in range(2):
                ac.put_signed(coder, c["vector"][k] - guess[k], C_MVD)
        else:
            coder.put(int(c["mode"] in probable), C_MPM)
            if c["mode"] in probable:
                coder.put(probable.index(c["mode"]), C_INDEX)
            else:
                for k in (2, 1, 0):
                    coder.put(c["mode"] >> k & 1, C_MODE)
        if not c["copy"]:
            ac.put_signed(coder, c["qp"] - last_qp, C_QP)
            for level in c["levels"]:
                put_levels(coder, level.ravel()[_SCANS.get(c["mode"], tables.ZIGZAG8)], 88 * c["inter"])

    def _get(self, coder: ac.Decoder, guess: tuple, probable: tuple, last_qp: int) -> dict:
        inter = bool(coder.get(C_INTER))
        c = {"inter": inter, "copy": False, "mode": NONE, "vector": (0, 0), "qp": last_qp, "levels": np.zeros((4, 8, 8), np.int64)}
        if inter:
            c["copy"] = bool(coder.get(C_COPY))
            c["vector"] = tuple(guess[k] + ac.get_signed(coder, C_MVD) for k in range(2))
        elif coder.get(C_MPM):
            c["mode"] = probable[coder.get(C_INDEX)]
        else:
            c["mode"] = sum(coder.get(C_MODE) << k for k in (2, 1, 0))
        if not c["copy"]:
            c["qp"] = last_qp + ac.get_signed(coder, C_QP)
            for level in c["levels"]:
                level.flat[_SCANS.get(c["mode"], tables.ZIGZAG8)] = get_levels(coder, 88 * inter)
        return c


def _group(pos: int) -> int:
    return 0 if pos == 0 else 1 if pos <= 10 else 2 if pos <= 40 else 3


def put_levels(coder: ac.Encoder, scanned: np.ndarray, base: int) -> None:
    """Last place plus one, flags of the places before it, then each level's size in steps, and its sign."""
    places = np.flatnonzero(scanned)
    last = int(places[-1]) if len(places) else -1
    ac.put_golomb(coder, last + 1, base + 64)
    for pos in range(last):
        coder.put(int(scanned[pos] != 0), base + pos)
    seen = 0
    for pos in map(int, places):
        size, g = abs(int(scanned[pos])), _group(pos)
        coder.put(int(size > 1), base + 68 + 2 * g + seen)
        if size > 1:
            coder.put(int(size > 2), base + 76 + 2 * g + seen)
            if size > 2:
                ac.put_golomb(coder, size - 3, base + 84 + g)
            seen = 1
        coder.put(int(scanned[pos] < 0), C_SIGN)


def get_levels(coder: ac.Decoder, base: int) -> np.ndarray:
    out = np.zeros(64, np.int64)
    last = ac.get_golomb(coder, base + 64) - 1
    if last < 0:
        return out
    places = [pos for pos in range(last) if coder.get(base + pos)] + [last]
    seen = 0
    for pos in places:
        size, g = 1, _group(pos)
        if coder.get(base + 68 + 2 * g + seen):
            size = 2
            if coder.get(base + 76 + 2 * g + seen):
                size = 3 + ac.get_golomb(coder, base + 84 + g)
            seen = 1
        out[pos] = -size if coder.get(C_SIGN) else size
    return out


def encode_period(pictures: list[np.ndarray], qp: int, radius: int = block_search.RADIUS) -> tuple[list[bytes], list[np.ndarray]]:
    """A packet per picture, the first a key picture, and the pictures as a decoder rebuilds them."""
    walk, packets, rebuilt = Walk(*pictures[0].shape, qp, radius), [], []
    for p in pictures:
        coder = ac.Encoder()
        rebuilt.append(walk.picture(p.astype(np.int64), coder))
        packets.append(ac.pack(coder.finish()))
    return packets, rebuilt


def decode_period(packets: list[bytes], height: int, width: int) -> list[np.ndarray]:
    walk = Walk(height, width, 0)
    return [walk.picture(None, ac.Decoder(ac.unpack(data))) for data in packets]
