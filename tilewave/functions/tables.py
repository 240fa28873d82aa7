"""Constant tables. Those with a closed form are computed from it."""

from __future__ import annotations

import math


def basis(n: int) -> list[int]:
    """Cosine basis of n points in 1/128, entry j*n + i for frequency j and sample i."""
    return [math.floor(128 * math.cos((2 * i + 1) * j * math.pi / (2 * n)) + 0.5) for j in range(n) for i in range(n)]


def zigzag(n: int) -> list[int]:
    """Raster place of each scan place: antidiagonals, alternately up and down."""
    order = sorted(((r, c) for r in range(n) for c in range(n)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return [r * n + c for r, c in order]


def inverse(scan: list[int]) -> list[int]:
    out = [0] * len(scan)
    for place, raster in enumerate(scan):
        out[raster] = place
    return out


ZIGZAG8 = zigzag(8)
HORIZONTAL8 = list(range(64))
VERTICAL8 = [r * 8 + c for c in range(8) for r in range(8)]

# They must equal these for right results.
INTRA_MATRIX = [
    8, 10, 12, 15, 19, 23, 25, 27,
    10, 12, 14, 17, 21, 25, 27, 28,
    12, 14, 18, 21, 24, 26, 28, 30,
    15, 17, 21, 24, 26, 28, 30, 32,
    19, 21, 24, 26, 28, 30, 32, 35,
    23, 25, 26, 28, 30, 32, 35, 38,
    25, 27, 28, 30, 32, 35, 38, 41,
    27, 28, 30, 32, 35, 38, 41, 45,
]
INTER_MATRIX = [
    16, 17, 18, 19, 20, 21, 22, 23,
    17, 18, 19, 20, 21, 22, 23, 24,
    18, 19, 20, 21, 22, 23, 24, 25,
    19, 20, 21, 22, 23, 24, 26, 27,
    20, 21, 22, 23, 25, 26, 27, 28,
    21, 22, 23, 24, 26, 27, 28, 30,
    22, 23, 24, 26, 27, 28, 30, 31,
    23, 24, 25, 27, 28, 30, 31, 33,
]
INTRA_DEADZONE = [
    0, 1, 1, 1, 1, 1, 2, 2,
    1, 1, 1, 1, 1, 2, 2, 2,
    1, 1, 1, 1, 2, 2, 2, 2,
    1, 1, 1, 2, 2, 2, 2, 3,
    1, 1, 2, 2, 2, 2, 3, 3,
    1, 2, 2, 2, 2, 3, 3, 3,
    2, 2, 2, 2, 3, 3, 3, 3,
    2, 2, 2, 3, 3, 3, 3, 3,
]
INTER_DEADZONE = [
    2, 2, 2, 3, 3, 3, 4, 4,
    2, 2, 3, 3, 3, 4, 4, 4,
    2, 3, 3, 3, 4, 4, 4, 4,
    3, 3, 3, 4, 4, 4, 4, 4,
    3, 3, 4, 4, 4, 4, 4, 4,
    3, 4, 4, 4, 4, 4, 4, 4,
    4, 4, 4, 4, 4, 4, 4, 4,
    4, 4, 4, 4, 4, 4, 4, 4,
]
EDGE_ALPHA = [
    0, 0, 0, 0, 0, 0, 0, 1,
    1, 1, 2, 2, 3, 3, 4, 5,
    6, 7, 8, 9, 10, 12, 14, 16,
    18, 20, 22, 24, 26, 29, 32, 35,
    38, 42, 46, 50, 54, 59, 64, 70,
    76, 82, 89, 96, 104, 112, 120, 128,
    138, 148, 158, 170, 182, 196, 210, 224,
    240, 255, 255, 255, 255, 255, 255, 255,
]
EDGE_BETA = [
    0, 0, 0, 0, 0, 0, 0, 0,
    1, 1, 1, 1, 2, 2, 2, 3,
    3, 3, 4, 4, 4, 5, 5, 6,
    6, 7, 7, 8, 8, 9, 10, 11,
    12, 13, 14, 15, 16, 17, 18, 18,
    18, 18, 18, 18, 18, 18, 18, 18,
    18, 18, 18, 18, 18, 18, 18, 18,
    18, 18, 18, 18, 18, 18, 18, 18,
]
BARK_EDGES_HZ = [
    0, 100, 200, 300, 400, 510, 630, 770, 920, 1080, 1270, 1480, 1720,
    2000, 2320, 2700, 3150, 3700, 4400, 5300, 6400, 7700, 9500, 12000, 15500, 24000,
]
COEFFICIENT_BAND_ENDS = [8, 24, 56, 112, 192, 320]


def bark_bands(sample_rate: int, bins: int = 512) -> list[tuple[int, int, int]]:
    """(band, first bin, end bin) of the 25 critical bands."""
    nyquist = sample_rate / 2
    width = nyquist / bins
    out = []
    for b, (low, high) in enumerate(zip(BARK_EDGES_HZ, BARK_EDGES_HZ[1:])):
        first, end = int(min(low, nyquist) / width), int(min(high, nyquist) / width)
        first = min(first, bins - 1)
        end = min(max(end, first + 1), bins)
        out.append((b, first, end))
    return out[:-1] + [(24, out[-1][1], bins)]
