"""A compressed FM-index over the words of many pieces of text, and matching statistics by backward search.

The pieces are laid one after another, each ended by a separator of its own. The Burrows-Wheeler transform of that sequence is kept
as a wavelet matrix: a plane of bits for each bit of a word's number, with counts for every 64 bits. A backward step counts a word
before two places of the transform, which is one walk down the planes for each.

Matching statistics are taken from the right end of a piece to its left: while the interval of the words matched so far can be
extended to the left it is, and else it is widened to its parent, the interval of the longest prefix with more occurrences, from the
common prefixes of neighbouring suffixes. An interval counts only if one of its suffixes is of a piece that is owned by someone
smaller than the piece at hand. Many pieces are searched together, one step of each at a time.
"""

from __future__ import annotations

import numpy as np


def suffixes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix with the suffix before); symbols that are 0 are separators, each unlike all others."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(ends) - 1
    rank[ends] = np.arange(len(ends))
    sa = np.argsort(rank, kind="stable")
    by = rank[sa]
    begin = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
    length = np.diff(np.r_[begin, n])
    rank[sa] = np.repeat(begin, length)
    open_ = np.repeat(length > 1, length)
    levels, step = [rank.copy()], 1
    while open_.any():
        slots = np.flatnonzero(open_)
        who = sa[slots]
        pair = rank[who] * n + rank[who + step]  # a suffix that isn't alone has no separator in its first step symbols
        order = np.argsort(pair, kind="stable")
        who, pair = who[order], pair[order]
        sa[slots] = who
        begin = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        length = np.diff(np.r_[begin, len(who)])
        rank[who] = np.repeat(slots[begin], length)
        levels.append(rank.copy())
        open_[slots] = np.repeat(length > 1, length)
        step *= 2
    common = np.zeros(n, np.int64)
    x, y = sa[:-1].copy(), sa[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][x] == levels[k][y]
        common[1:][same] += 1 << k
        x[same] += 1 << k
        y[same] += 1 << k
    return sa, common


def smaller_neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the nearest place before, and behind, of a smaller value. The first and the last value are the smallest."""
    before, behind = np.zeros(len(values), np.int64), np.full(len(values), len(values) - 1, np.int64)
    stack: list[int] = []
    lefts, rights = before.tolist(), behind.tolist()
    own = values.tolist()
    for i, v in enumerate(own):
        while stack and own[stack[-1]] > v:
            rights[stack.pop()] = i
        # of equal values, the one before has the same smaller neighbour
        lefts[i] = 0 if not stack else stack[-1] if own[stack[-1]] < v else lefts[stack[-1]]
        stack.append(i)
    return np.array(lefts), np.array(rights)


class WaveletMatrix:
    """Counts of numbers before places of a sequence."""

    def __init__(self, values: np.ndarray, most: int):
        self.depth = max(1, int(most).bit_length())
        self.planes: list[tuple[np.ndarray, np.ndarray, int]] = []
        own = values.astype(np.int64)
        for level in range(self.depth - 1, -1, -1):
            bit = ((own >> level) & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]
            self.planes.append((words, before, int(len(bit) - bit.sum())))
            own = np.r_[own[~bit], own[bit]]
        self.first = self._down(np.arange(most + 1), np.zeros(most + 1, np.int64))

    def _down(self, value: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k, (words, before, zeros) in enumerate(self.planes):
            at = place >> 6
            ones = before[at] + np.bitwise_count(words[at] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
            place = np.where((value >> (self.depth - 1 - k)) & 1, zeros + ones, place - ones)
        return place

    def rank(self, value: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often value stands before place."""
        return self._down(value, place) - self.first[value]


class FMIndex:
    """Pieces (lists of word numbers from 1 on, one after another), each with an owner."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, owners: np.ndarray):
        self.sizes = sizes
        self.begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        self.symbols = np.zeros(len(words) + len(sizes), np.int64)
        self.symbols[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = words
        n = len(self.symbols)
        sa, common = suffixes(self.symbols)
        most = int(words.max())
        self.wavelet = WaveletMatrix(self.symbols[sa - 1], most)
        self.below = np.r_[0, np.cumsum(np.bincount(self.symbols, minlength=most + 1))]
        self.common = np.r_[-1, common[1:], -1]
        self.before, self.behind = smaller_neighbours(self.common)
        self.owners = owners
        # the smallest owner of any interval, from those of intervals of powers of two
        own = owners[np.repeat(np.arange(len(sizes)), sizes + 1)][sa]
        self.least = [own]
        while 2 << len(self.least) - 1 <= n:
            half = 1 << len(self.least) - 1
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def smallest_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.owners.dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k)])
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word of each piece: how many words from it on, to the piece's end at most, also stand in a piece of a smaller owner;
        and where the pieces begin in that."""
        out = np.zeros(len(self.symbols), np.int64)
        n = len(self.symbols)
        lane = np.arange(len(self.sizes))
        at = self.begin + self.sizes - 1  # the word to take next
        low, high, size = np.zeros(len(lane), np.int64), np.full(len(lane), n, np.int64), np.zeros(len(lane), np.int64)
        live = np.flatnonzero(self.sizes > 0)
        lane, at, low, high, size = lane[live], at[live], low[live], high[live], size[live]
        while len(lane):
            word = self.symbols[at]
            both = self.wavelet.rank(np.r_[word, word], np.r_[low, high])
            to_low, to_high = self.below[word] + both[: len(lane)], self.below[word] + both[len(lane) :]
            some = np.flatnonzero(to_high > to_low)
            good = np.zeros(len(lane), bool)
            good[some] = self.smallest_owner(to_low[some], to_high[some]) < self.owners[lane[some]]
            out[at[good]] = size[good] + 1
            # the rest: widen to the parent, or give the word up if nothing is matched
            wide = ~good & (size > 0)
            left, right = self.common[low], self.common[high]
            edge = np.where(left >= right, low, high)
            height = np.maximum(left, right)
            low = np.where(good, to_low, np.where(wide, self.before[edge], low))
            high = np.where(good, to_high, np.where(wide, self.behind[edge], high))
            size = np.where(good, size + 1, np.where(wide, height, 0))
            root = wide & (height <= 0)
            low[root], high[root], size[root] = 0, n, 0
            at = at - ~wide
            live = np.flatnonzero(at >= self.begin[lane])
            if len(live) < len(lane):
                lane, at, low, high, size = lane[live], at[live], low[live], high[live], size[live]
        return out, self.begin
