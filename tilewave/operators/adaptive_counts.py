"""Adaptive counts of zeros and ones that are halved whenever they reach a limit together.

Between two halvings the counts are prefix sums, so that a stream of n symbols takes n / 32,768 steps of whole arrays: what one
stretch leaves to the next is two numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LIMIT = 65536


@dataclass
class Cost:
    """bits: what an ideal adaptive coder needs; ones: the count of ones before each symbol; counts: of zeros and ones after the last."""

    n: int
    halvings: int
    bits: float
    ones: np.ndarray
    counts: tuple[int, int]


def low_bits(values: np.ndarray, n: int) -> np.ndarray:
    """The n lowest bits of each value, lowest first."""
    return ((values[:, None] >> np.arange(n)) & 1).ravel()


def advance(bits: np.ndarray, counts: tuple[int, int], limit: int = LIMIT) -> tuple[int, int]:
    """The counts of zeros and ones after a block of symbols; all that the next block needs of it."""
    (n0, n1), at = counts, 0
    while at < len(bits):
        stop = min(len(bits), at + limit - n0 - n1)
        more = int(np.count_nonzero(bits[at:stop]))
        n0, n1, at = n0 + stop - at - more, n1 + more, stop
        if n0 + n1 >= limit:
            n0, n1 = n0 >> 1 | 1, n1 >> 1 | 1
    return n0, n1


def cost(bits: np.ndarray, limit: int = LIMIT, counts: tuple[int, int] = (1, 1)) -> Cost:
    """counts: of zeros and ones before the first symbol."""
    sums = np.r_[0, np.cumsum(bits)]
    ones, total = np.empty(len(bits), np.int64), np.empty(len(bits), np.int64)
    at, (n0, n1), halvings = 0, counts, 0
    while at < len(bits):
        stop = min(len(bits), at + limit - n0 - n1)
        ones[at:stop] = n1 + sums[at:stop] - sums[at]
        total[at:stop] = n0 + n1 + np.arange(stop - at)
        n1, n0 = n1 + int(sums[stop] - sums[at]), n0 + stop - at - int(sums[stop] - sums[at])
        if n0 + n1 >= limit:
            n0, n1, halvings = n0 >> 1 | 1, n1 >> 1 | 1, halvings + 1
        at = stop
    own = np.where(bits == 1, ones, total - ones)
    return Cost(len(bits), halvings, float(-np.log2(own / total).sum()), ones, (n0, n1))
