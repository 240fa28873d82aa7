"""Sample offsets of blocks, for planes of any size: statistics, the choice by cost, and its application, over whole batches of pictures.

A block's error is added up by band of eight values and, for four directions, by how a pixel stands to its two neighbours. Offsets are
rounded mean errors, up to 7. The choice is among none, four bands in a row, and a direction. Chroma planes share a choice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEPS = [(1, 0), (0, 1), (1, 1), (1, -1)]
CATEGORIES = [-2, -1, 1, 2]
BANDS, MOST = 32, 7
PER_BLOCK = BANDS + len(STEPS) * len(CATEGORIES)
POSITIONS = BANDS - 3


def categories(made: np.ndarray, step: tuple[int, int]) -> np.ndarray:
    """How each pixel of pictures (n, y, x) stands to its two neighbours in a direction; 0 where one is outside."""
    dx, dy = step
    side = made.shape[1]
    y, x = np.mgrid[:side, :side]
    inside = (x >= abs(dx)) & (x < side - abs(dx)) & (y >= abs(dy)) & (y < side - abs(dy))
    around = np.sign(np.roll(made, (dy, dx), (1, 2)) - made) + np.sign(np.roll(made, (-dy, -dx), (1, 2)) - made)
    return np.where(inside, around, 0)


def cells(made: np.ndarray) -> list[np.ndarray]:
    """For each kind of cell, that of every pixel, -1 if none: bands, then the directions."""
    place = np.array([0, 1, -1 - BANDS, 2, 3])  # by category + 2
    return [made // 8, *(np.where((c := categories(made, s)) != 0, BANDS + 4 * k + place[c + 2], -1) for k, s in enumerate(STEPS))]


@dataclass
class Choice:
    """By picture and block: 0 none, 1 + first band, or 30 + direction; its cost; and the offsets of all cells."""

    choice: np.ndarray
    cost: np.ndarray
    offsets: np.ndarray


def block_of(side: int) -> np.ndarray:
    y, x = np.mgrid[:side, :side]
    return y // (side // 4) * 4 + x // (side // 4)


def statistics(source: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(error sums, counts) as (n, 16 blocks, cells)."""
    n, total = len(made), len(made) * 16 * PER_BLOCK
    base = (np.arange(n)[:, None, None] * 16 + block_of(made.shape[1])) * PER_BLOCK
    err, count = np.zeros(total), np.zeros(total, np.int64)
    for cell in cells(made):
        at = cell >= 0
        key = (base + cell)[at]
        err += np.bincount(key, (source - made)[at], total)
        count += np.bincount(key, minlength=total)
    return err.astype(np.int64).reshape(n, 16, PER_BLOCK), count.reshape(n, 16, PER_BLOCK)


def chosen(err: np.ndarray, count: np.ndarray, rate: int) -> Choice:
    size = np.maximum(count, 1)
    off = np.sign(err) * np.minimum((np.abs(err) + count // 2) // size, MOST)
    gain, bits = 2 * off * err - count * off * off, 3 * (off != 0)
    never = np.iinfo(np.int64).max
    costs = [np.full(err.shape[:2], 2 * rate)]
    spans = [(s, s + 4, 11) for s in range(POSITIONS)] + [(BANDS + 4 * k, BANDS + 4 * k + 4, 8) for k in range(len(STEPS))]
    for a, b, head in spans:
        cost = rate * (head + bits[..., a:b].sum(-1)) - gain[..., a:b].sum(-1)
        costs.append(np.where((off[..., a:b] != 0).any(-1), cost, never))
    costs = np.stack(costs, -1)
    choice = costs.argmin(-1)
    return Choice(choice, costs.min(-1), off)


def applied(made: np.ndarray, c: Choice) -> np.ndarray:
    """Pictures with the chosen offsets added, from 0 to 255."""
    n, block = len(made), block_of(made.shape[1])
    choice = c.choice[:, block]
    pic, out = np.arange(n)[:, None, None], made.copy()
    for k, cell in enumerate(cells(made)):
        own = (choice > 0) & (choice <= POSITIONS) & (cell >= choice - 1) & (cell <= choice + 2) if k == 0 else (choice == POSITIONS + k) & (cell >= 0)
        out = np.where(own, made + c.offsets[pic, block, np.maximum(cell, 0)], out)
    return np.clip(out, 0, 255)
