"""Audio coding: mid and side, lapped transform, band-weighted quantization, adaptive context coding.

The first coefficient of a frame is coded as its difference to the frame before; the others in seven bands of
contexts. Contexts, last first coefficients and the overlap last as long as the stream, so a stream is one group.
"""

from __future__ import annotations

import numpy as np

from tilewave.functions import tables
from tilewave.operators import arithmetic_coder as ac

HOP, SIZE = 512, 1024
_N, _K = np.arange(SIZE), np.arange(HOP)
WINDOW = np.sin(np.pi * (_N + 0.5) / SIZE)
BASIS = np.cos(np.pi / SIZE * np.outer(_N + 0.5 + HOP // 2, 2 * _K + 1))
#: Context of each coefficient: 0 for the first, then one per band.
CONTEXTS = [0] + [1 + sum(k > end for end in tables.COEFFICIENT_BAND_ENDS) for k in range(1, HOP)]


def steps(quality: int, rate: int) -> np.ndarray:
    weights = np.empty(HOP)
    for b, first, end in tables.bark_bands(rate):
        weights[first:end] = 1 + (b / 24) ** 2
    return 0.02 * 2 ** (min(quality, 31) / 3) * weights


def frames_of(signal: np.ndarray) -> np.ndarray:
    """(frames, 1024): each hop with the one before it, the first after silence, and one more to complete the last."""
    hops = -(-len(signal) // HOP)
    x = np.concatenate([np.zeros(HOP), signal, np.zeros(hops * HOP - len(signal) + HOP)])
    return np.stack([x[f * HOP : f * HOP + SIZE] for f in range(hops + 1)])


def levels_of(signal: np.ndarray, quality: int, rate: int) -> np.ndarray:
    coef = (frames_of(signal) * WINDOW) @ BASIS / steps(quality, rate)
    return np.clip(np.sign(coef) * np.floor(np.abs(coef) + 0.5), -32768, 32767).astype(np.int64)


def signal_of(levels: np.ndarray, quality: int, rate: int, samples: int) -> np.ndarray:
    back = (levels * steps(quality, rate)) @ BASIS.T * (4 / SIZE) * WINDOW
    out = np.zeros((len(levels) + 1) * HOP)
    for f, part in enumerate(back):
        out[f * HOP : f * HOP + SIZE] += part
    return out[HOP : HOP + samples]


def mid_side(signal: np.ndarray) -> np.ndarray:
    """(channels, samples): two channels become half sum and half difference."""
    return signal if len(signal) == 1 else np.stack([(signal[0] + signal[1]) / 2, (signal[0] - signal[1]) / 2])


def left_right(signal: np.ndarray) -> np.ndarray:
    return signal if len(signal) == 1 else np.stack([signal[0] + signal[1], signal[0] - signal[1]])


def encode(signal: np.ndarray, quality: int, rate: int) -> tuple[list[bytes], np.ndarray]:
    """A packet per frame, and the levels (channels, frames, 512)."""
    levels = np.stack([levels_of(c, quality, rate) for c in mid_side(np.atleast_2d(signal))])
    packets, counts = [], {}
    last = [0] * len(levels)
    for f in range(levels.shape[1]):
        coder = ac.Encoder()
        coder.counts = counts  # contexts go on from frame to frame
        for c in range(len(levels)):
            row = levels[c, f].tolist()
            end = max((k for k in range(HOP) if row[k]), default=-1)
            ac.put_golomb(coder, end + 1, 16 * c + 9)
            for k in range(end + 1):
                ac.put_signed(coder, row[k] - (last[c] if k == 0 else 0), 16 * c + CONTEXTS[k])
            last[c] = row[0] if end >= 0 else last[c]
        packets.append(ac.pack(coder.finish()))
    return packets, levels


def decode(packets: list[bytes], channels: int) -> np.ndarray:
    levels = np.zeros((channels, len(packets), HOP), np.int64)
    counts: dict = {}
    last = [0] * channels
    for f, data in enumerate(packets):
        coder = ac.Decoder(ac.unpack(data))
        coder.counts = counts
        for c in range(channels):
            end = ac.get_golomb(coder, 16 * c + 9) - 1
            for k in range(end + 1):
                levels[c, f, k] = ac.get_signed(coder, 16 * c + CONTEXTS[k]) + (last[c] if k == 0 else 0)
            last[c] = int(levels[c, f, 0]) if end >= 0 else last[c]
    return levels
