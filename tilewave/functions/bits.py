"""Bits as SQL text for Spark: codes as text of 0 and 1 in the order they are written, and buffers of 32-bit words, lowest bit first."""

from __future__ import annotations

from tilewave.functions.exprs import let


def golomb(m: str) -> str:
    """The Exp-Golomb code of m from 1 on: zeros, one fewer than its bits, then its bits."""
    return f"concat(repeat('0', length(bin({m})) - 1), bin({m}))"


def golomb_stop(code: str, at: str) -> str:
    """Where the code that begins at `at` (from 1) ends: its first 1 is as far from there as from its last bit."""
    return f"(2 * locate('1', {code}, {at}) - {at} + 1)"


def golomb_value(code: str, at: str) -> str:
    """The m whose code begins at `at`."""
    return f"cast(conv(substring({code}, locate('1', {code}, {at}), locate('1', {code}, {at}) - {at} + 1), 2, 10) as bigint)"


def unsigned_of(m: str) -> str:
    return f"({m} - 1)"


def signed_of(m: str) -> str:
    return f"(case when {m} = 1 then 0L when {m} % 2 = 1 then -({m} div 2) else {m} div 2 end)"


def packed_hex(code: str) -> str:
    """The bytes of a code as hexadecimal text: eight bits each, the first lowest, zeros at the end."""
    byte = "lpad(lower(hex(cast(conv(reverse(rpad(substring(c, 8 * k + 1, 8), 8, '0')), 2, 10) as bigint))), 2, '0')"
    return let(code, "c", f"array_join(transform(filter(sequence(0, greatest((length(c) + 7) div 8 - 1, 0)), k -> 8 * k < length(c)), k -> {byte}), '')")


# ---- buffers of words ---------------------------------------------------------------------------------------

_ALL = "4294967295L"


def read(words: str, offset: str, n: str) -> str:
    """n bits (1 to 32) of a buffer at any bit offset; beyond its end are zeros."""
    low = f"shiftrightunsigned(coalesce(get({words}, int({offset} div 32)), 0L), int({offset} % 32))"
    high = f"shiftleft(coalesce(get({words}, int({offset} div 32 + 1)), 0L), int(32 - {offset} % 32))"
    return f"((({low}) | ({high})) & (shiftleft(1L, int({n})) - 1))"


def shifted(words: str, offset: str, n: str) -> str:
    """n bits from an offset on, as a buffer of their own: each word from the two that it lies over."""
    count = f"(({n} + 31) div 32)"
    word = read("w", f"({offset} + 32 * k)", f"least(32L, {n} - 32 * k)")
    return let(words, "w", f"transform(filter(sequence(0L, greatest({count} - 1, 0L)), k -> 32 * k < {n}), k -> {word})")


def pasted(target: str, place: str, source: str, offset: str, n: str) -> str:
    """target with n bits of source, from an offset on, at any place; the bits around them stay."""
    begin, end = "(32 * k)", "(32 * k + 32)"
    first, last = f"greatest({place}, {begin})", f"least({place} + {n}, {end})"
    mask = f"shiftleft(shiftleft(1L, int({last} - {first})) - 1, int({first} - {begin}))"
    bits = f"shiftleft({read('s', f'({offset} + {first} - {place})', f'({last} - {first})')}, int({first} - {begin}))"
    word = f"if({first} < {last}, (x & ({_ALL} ^ ({mask}))) | ({bits}), x)"
    return let(source, "s", f"transform({target}, (x, k) -> {word})")
