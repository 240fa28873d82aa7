"""Adaptive binary arithmetic coding: inherently serial within a sequence, so it runs in a grouped function per sequence.

A 32-bit interval is split by the counts of zeros and ones of a context, which start at one each and are halved when
they reach 65536 together. Many short sequences go side by side, a symbol of each at a time (encode_many, golomb_many).
"""

from __future__ import annotations

import numpy as np

TOP = (1 << 32) - 1
HALF = TOP >> 1
QUARTER = HALF >> 1
LIMIT = 65536


class Interval:
    """What encoder and decoder share: the interval and the contexts' counts."""

    def __init__(self):
        self.low, self.high, self.counts = 0, TOP, {}

    def narrow(self, bit: int, context: int) -> None:
        n = self.counts[context]
        middle = self.low + (self.high - self.low) * n[0] // (n[0] + n[1])
        if bit:
            self.low = middle + 1
        else:
            self.high = middle
        n[bit] += 1
        if n[0] + n[1] >= LIMIT:
            n[:] = [(x >> 1) | 1 for x in n]

    def middle(self, context: int) -> int:
        n = self.counts.setdefault(context, [1, 1])
        return self.low + (self.high - self.low) * n[0] // (n[0] + n[1])

    def settled(self) -> bool:
        return (self.low ^ self.high) >> 31 == 0

    def straddles(self) -> bool:
        return self.low > QUARTER and self.high <= 3 * QUARTER

    def shift(self, less: int = 0) -> None:
        self.low, self.high = ((self.low - less) << 1) & TOP, (((self.high - less) << 1) & TOP) | 1


class Encoder(Interval):
    def __init__(self):
        super().__init__()
        self.out: list[int] = []
        self.pending = 0

    def _emit(self, bit: int) -> None:
        self.out.append(bit)
        self.out += [1 - bit] * self.pending
        self.pending = 0

    def put(self, bit: int, context: int = 0) -> None:
        self.middle(context)
        self.narrow(bit, context)
        while True:
            if self.settled():
                self._emit(self.low >> 31)
                self.shift()
            elif self.straddles():
                self.pending += 1
                self.shift(QUARTER + 1)
            else:
                return

    def finish(self) -> list[int]:
        self.pending += 1
        self._emit(0 if self.low < QUARTER else 1)
        return self.out


class Decoder(Interval):
    """Beyond the end of the code, zeros are read."""

    def __init__(self, code: list[int]):
        super().__init__()
        self.code, self.place = code, 32
        self.value = int("".join(map(str, (code + [0] * 32)[:32])), 2)

    def _read(self) -> int:
        bit = self.code[self.place] if self.place < len(self.code) else 0
        self.place += 1
        return bit

    def get(self, context: int = 0) -> int:
        bit = int(self.value > self.middle(context))
        self.narrow(bit, context)
        while True:
            less = 0
            if not self.settled():
                if not self.straddles():
                    return bit
                less = QUARTER + 1
            self.value = (((self.value - less) << 1) & TOP) | self._read()
            self.shift(less)


def encode(bits: list[int], contexts: list[int] | None = None) -> list[int]:
    coder = Encoder()
    for i, bit in enumerate(bits):
        coder.put(bit, contexts[i] if contexts else 0)
    return coder.finish()


def decode(code: list[int], n: int, contexts: list[int] | None = None) -> list[int]:
    coder = Decoder(code)
    return [coder.get(contexts[i] if contexts else 0) for i in range(n)]


def put_golomb(coder: Encoder, value: int, context: int) -> None:
    """Unsigned Exp-Golomb: zeros, one fewer than the bits of value + 1, then value + 1."""
    text = bin(value + 1)[2:]
    for bit in "0" * (len(text) - 1) + text:
        coder.put(int(bit), context)


def get_golomb(coder: Decoder, context: int) -> int:
    zeros = 0
    while not coder.get(context):
        zeros += 1
    value = 1
    for _ in range(zeros):
        value = value * 2 + coder.get(context)
    return value - 1


def put_signed(coder: Encoder, value: int, context: int) -> None:
    put_golomb(coder, 0 if value == 0 else 2 * abs(value) + (value < 0) - 1, context)


def get_signed(coder: Decoder, context: int) -> int:
    m = get_golomb(coder, context) + 1
    return 0 if m == 1 else -(m // 2) if m % 2 else m // 2


def pack(bits: list[int]) -> bytes:
    """Bits to bytes, the first bit lowest."""
    padded = bits + [0] * (-len(bits) % 8)
    return bytes(sum(b << k for k, b in enumerate(padded[i : i + 8])) for i in range(0, len(padded), 8))


def unpack(data: bytes) -> list[int]:
    return [(byte >> k) & 1 for byte in data for k in range(8)]


# ---- many sequences -----------------------------------------------------------------------------------------


class Intervals:
    """The intervals and counts of many sequences. Methods take the places of those that go on."""

    def __init__(self, n: int, contexts: int):
        self.low, self.high = np.zeros(n, np.int64), np.full(n, TOP, np.int64)
        self.counts = np.ones((n, contexts, 2), np.int64)

    def middle(self, at: np.ndarray, context: np.ndarray) -> np.ndarray:
        n0, n1 = self.counts[at, context].T
        return self.low[at] + (self.high[at] - self.low[at]) * n0 // (n0 + n1)

    def narrow(self, at: np.ndarray, bit: np.ndarray, context: np.ndarray, middle: np.ndarray) -> None:
        one = bit == 1
        self.low[at[one]], self.high[at[~one]] = middle[one] + 1, middle[~one]
        self.counts[at, context, bit] += 1
        full = self.counts[at, context].sum(1) >= LIMIT
        if full.any():
            self.counts[at[full], context[full]] = self.counts[at[full], context[full]] >> 1 | 1

    def settled(self, at: np.ndarray) -> np.ndarray:
        """How many of the highest bits low and high have in common."""
        return 32 - np.frexp((self.low[at] ^ self.high[at]).astype(float))[1].astype(np.int64)

    def straddling(self, at: np.ndarray) -> np.ndarray:
        return at[(self.low[at] > QUARTER) & (self.high[at] <= 3 * QUARTER)]

    def shift(self, at: np.ndarray, n: np.ndarray | int, less: int = 0) -> None:
        self.low[at], self.high[at] = ((self.low[at] - less) << n) & TOP, (((self.high[at] - less) << n) & TOP) | ((1 << n) - 1)


def encode_many(bits: np.ndarray, contexts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences' bits and contexts, one after another -> a row of code for each, zeros behind its end, and the codes' lengths."""
    n = len(lengths)
    state, starts = Intervals(n, int(contexts.max(initial=0)) + 1), np.cumsum(lengths) - lengths
    out, ends, pending = np.zeros((n, 64), np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def put(at: np.ndarray, bit: np.ndarray) -> None:
        out[at, ends[at]] = bit
        ends[at] += 1

    def emit(at: np.ndarray, bit: np.ndarray) -> None:
        """A bit, and its opposite for each that is pending."""
        nonlocal out
        while int((ends[at] + pending[at]).max(initial=0)) + 34 > out.shape[1]:
            out = np.pad(out, ((0, 0), (0, out.shape[1])))
        put(at, bit)
        while len(at):
            more = pending[at] > 0
            at, bit = at[more], bit[more]
            put(at, 1 - bit)
            pending[at] -= 1

    for t in range(int(lengths.max(initial=0))):
        at = np.flatnonzero(lengths > t)
        bit, context = bits[starts[at] + t], contexts[starts[at] + t]
        state.narrow(at, bit, context, state.middle(at, context))
        same = state.settled(at)
        some, same = at[same > 0], same[same > 0]
        emit(some, state.low[some] >> 31)
        for k in range(1, int(same.max(initial=0))):
            own = some[same > k]
            put(own, state.low[own] >> (31 - k) & 1)
        state.shift(some, same)
        while len(at := state.straddling(at)):
            pending[at] += 1
            state.shift(at, 1, QUARTER + 1)
    pending += 1
    emit(np.arange(n), (state.low >= QUARTER).astype(np.int64))
    return out, ends


def golomb_many(code: np.ndarray, counts: np.ndarray, contexts: int) -> np.ndarray:
    """The values, `counts` of each, whose Exp-Golomb codes went to these rows of code; a value's context is its place modulo contexts."""
    n, code = len(counts), np.pad(code, ((0, 0), (0, 33)))
    state, starts, out = Intervals(n, contexts), np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.int64)
    value, place = code[:, :32].astype(np.int64) @ (1 << np.arange(31, -1, -1)), np.full(n, 32)
    nth, zeros, left, own = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1), np.ones(n, np.int64)

    def read(at: np.ndarray, less: int = 0) -> None:
        value[at] = (((value[at] - less) << 1) & TOP) | code[at, np.minimum(place[at], code.shape[1] - 1)]
        place[at] += 1

    while len(at := np.flatnonzero(nth < counts)):
        context = nth[at] % contexts
        middle = state.middle(at, context)
        bit = (value[at] > middle).astype(np.int64)
        state.narrow(at, bit, context, middle)
        same = state.settled(at)
        for k in range(int(same.max())):
            read(at[same > k])
        state.shift(at, same)
        on = at
        while len(on := state.straddling(on)):
            read(on, QUARTER + 1)
            state.shift(on, 1, QUARTER + 1)
        # zeros are counted up to the first one; as many bits follow it
        counting, one = left[at] < 0, bit == 1
        zeros[at[counting & ~one]] += 1
        first, later = at[counting & one], at[~counting]
        left[first], own[first] = zeros[first], 1
        own[later] = own[later] * 2 + bit[~counting]
        left[later] -= 1
        done = at[left[at] == 0]
        out[starts[done] + nth[done]] = own[done] - 1
        nth[done] += 1
        zeros[done], left[done] = 0, -1
    return out


def golomb_bits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Exp-Golomb codes of unsigned values, one after another, and the length of each."""
    z = values.astype(np.int64) + 1
    width = np.searchsorted(1 << np.arange(1, 63), z, "right") + 1
    size = 2 * width - 1
    k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    down = np.repeat(size, size) - 1 - k
    return np.where(down < np.repeat(width, size), np.repeat(z, size) >> np.minimum(down, 62) & 1, 0), size
