"""Block searches over whole windows: sums of absolute differences of a 16x16 block at every place of a picture.

Radius 16 halved to 1 moves a block by up to 31. ring_search takes places from the middle outwards and leaves out those that can't
win: the differences of the sums of a block's quarters are a lower bound of its difference. It takes whole batches of pictures.
"""

from __future__ import annotations

import numpy as np

BLOCK, RADIUS = 16, 16


def sads(block: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """At [y, x], the difference of the block to the picture's block there."""
    return np.abs(np.lib.stride_tricks.sliding_window_view(ref, (BLOCK, BLOCK)) - block).sum((2, 3))


def full(at: np.ndarray, x: int, y: int, rate: int, radius: int = RADIUS, reach: int | None = None) -> tuple[int, int, int]:
    """(dx, dy, cost) of the cheapest displacement up to `reach`, else of all that steps from the radius down to 1 can reach; of equals the shortest."""
    reach = 2 * radius - 1 if reach is None else reach
    top, left = max(y - reach, 0), max(x - reach, 0)
    near = at[top : y + reach + 1, left : x + reach + 1]
    dy, dx = np.mgrid[top - y : top - y + near.shape[0], left - x : left - x + near.shape[1]]
    cost = near + rate * (np.abs(dx) + np.abs(dy) + 1)
    i = np.lexsort(((dx**2 + dy**2).ravel(), cost.ravel()))[0]
    return int(dx.flat[i]), int(dy.flat[i]), int(cost.flat[i])


TAPS = (1, -5, 20, 20, -5, 1)
#: Directions of sub-samples, in the order they are tried; each by a half, then by a quarter.
DIRECTIONS = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]


def blocks_of(pictures: np.ndarray) -> np.ndarray:
    """(pictures, 16 blocks, 16, 16) of 64x64 pictures."""
    n = len(pictures)
    return pictures.reshape(n, 4, BLOCK, 4, BLOCK).swapaxes(2, 3).reshape(n, 16, BLOCK, BLOCK)


def windows_of(pictures: np.ndarray) -> np.ndarray:
    """[picture, y, x]: the block that begins there, as a view."""
    return np.lib.stride_tricks.sliding_window_view(pictures, (BLOCK, BLOCK), axis=(1, 2))


def ring_search(now: np.ndarray, ref: np.ndarray, rate: int, reach: int = 2 * RADIUS - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dx, dy, cost, places compared) of every block: the cheapest displacement up to reach; of equals the shortest, then the first by
    rows. A ring's places are compared if their bound isn't above the best of the rings inside it."""
    n, side = len(now), now.shape[1] - BLOCK
    blocks, at = blocks_of(now).astype(np.int32), windows_of(ref)
    quarters = blocks.reshape(n, 16, 2, 8, 2, 8).sum((3, 5))
    total = np.pad(ref.astype(np.int64).cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
    eight = total[:, 8:, 8:] - total[:, :-8, 8:] - total[:, 8:, :-8] + total[:, :-8, :-8]
    best, compared = np.full((n, 16), np.iinfo(np.int64).max), np.zeros((n, 16), np.int64)
    m = np.arange(16)
    for ring in range(reach + 1):
        d = np.array([(x, y) for y in range(-ring, ring + 1) for x in range(-ring, ring + 1) if max(abs(x), abs(y)) == ring])
        x, y = m[:, None] % 4 * BLOCK + d[:, 0], m[:, None] // 4 * BLOCK + d[:, 1]
        who, which = np.nonzero((x >= 0) & (x <= side) & (y >= 0) & (y <= side))
        if not len(who):
            continue
        x, y, (dx, dy) = x[who, which], y[who, which], d[which].T
        bits = rate * (np.abs(dx) + np.abs(dy) + 1)
        bound = sum(np.abs(quarters[:, who, i, j] - eight[:, y + 8 * i, x + 8 * j]) for i in (0, 1) for j in (0, 1)) + bits
        pic, place = np.nonzero(bound <= best[:, who] >> 24)
        np.add.at(compared, (pic, who[place]), 1)
        for k in range(0, len(pic), 1 << 14):
            p, q = pic[k : k + (1 << 14)], place[k : k + (1 << 14)]
            sad = np.abs(blocks[p, who[q]] - at[p, y[q], x[q]]).sum((1, 2), dtype=np.int64)
            key = (sad + bits[q]) << 24 | (dx[q] ** 2 + dy[q] ** 2) << 12 | (dy[q] + reach) * (2 * reach + 1) + dx[q] + reach
            np.minimum.at(best, (p, who[q]), key)
    seq = best & 4095
    return seq % (2 * reach + 1) - reach, seq // (2 * reach + 1) - reach, best >> 24, compared


def six_taps(pictures: np.ndarray, axis: int) -> np.ndarray:
    """Between each sample and the next along an axis; beyond the edge the last sample stands in."""
    pad = [(0, 0)] * 3
    pad[axis] = (2, 3)
    wide, n = np.pad(pictures.astype(np.int32), pad, mode="edge"), pictures.shape[axis]
    return (sum(w * wide.take(range(k, k + n), axis) for k, w in enumerate(TAPS)) + 16) >> 5


def subsample_search(now: np.ndarray, ref: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, difference, prediction) of every block around its whole-sample displacement: half and quarter samples in eight directions,
    of equals the first. Place is 2 * direction + quarter, or -1 if none is closer than the whole-sample block."""
    n, side = len(now), now.shape[1] - BLOCK
    blocks, m = blocks_of(now).astype(np.int32), np.arange(16)
    across, down = six_taps(ref, 2), six_taps(ref, 1)
    phase = {(1, 0): windows_of(across), (0, 1): windows_of(down), (1, 1): windows_of(six_taps(across, 1))}
    x, y, pic = m % 4 * BLOCK + dx, m // 4 * BLOCK + dy, np.arange(n)[:, None]
    made = windows_of(ref)[pic, y, x].astype(np.int32)
    whole = made.copy()
    sad, place = np.abs(blocks - made).sum((2, 3)), np.full((n, 16), -1)
    for k, (u, v) in enumerate(DIRECTIONS):
        inside = (x + u >= 0) & (x + u <= side) & (y + v >= 0) & (y + v <= side)
        half = phase[abs(u), abs(v)][pic, np.where(inside, y + min(v, 0), 0), np.where(inside, x + min(u, 0), 0)]
        for quarter, block in ((0, half), (1, (whole + half + 1) >> 1)):
            own = np.abs(blocks - block).sum((2, 3))
            closer = inside & (own < sad)
            sad, place = np.where(closer, own, sad), np.where(closer, 2 * k + quarter, place)
            made = np.where(closer[..., None, None], block, made)
    return place, sad, made
