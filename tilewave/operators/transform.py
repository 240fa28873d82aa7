"""Integer block transforms on arrays, in one row: no shuffle. All take and return SQL text of array expressions."""

from __future__ import annotations

from tilewave.functions.exprs import array, let, rdiv
from tilewave.functions.tables import basis


def _pass(source: str, n: int, at: str, weight: str, scale: str, late: bool) -> str:
    """One direction over n*n values: at and weight are places in the source and the basis, for term t of output i."""
    table = array(basis(n))
    term = f"src[int({at})] * {table}[int({weight})]"
    if late:  # scaled after the sum
        inner = f"aggregate(sequence(0, {n - 1}), 0L, (a, t) -> a + {term}, a -> {scale.format(x='a')})"
    else:  # each term is scaled
        inner = f"aggregate(sequence(0, {n - 1}), 0L, (a, t) -> a + {scale.format(x=f'({term})')})"
    return let(source, "src", f"transform(sequence(0, {n * n - 1}), i -> {let(inner, 'q', rdiv('q', '128'))})")


# scales of the zero frequency and of the others
SCALE8 = ("{x} * 45 div 128", "{x} div 2")
SCALE4 = ("shiftright({x}, 1)", "shiftright({x} * 2896, 12)")


def _scale(n: int, zero: str) -> str:
    first, other = SCALE8 if n == 8 else SCALE4
    return f"case when {zero} = 0 then {first} else {other} end"


def forward_rows(a: str, n: int = 8) -> str:
    return _pass(a, n, f"(i div {n}) * {n} + t", f"(i % {n}) * {n} + t", _scale(n, f"i % {n}"), True)


def forward_columns(a: str, n: int = 8) -> str:
    return _pass(a, n, f"t * {n} + i % {n}", f"(i div {n}) * {n} + t", _scale(n, f"i div {n}"), True)


def inverse_columns(a: str, n: int = 8) -> str:
    return _pass(a, n, f"t * {n} + i % {n}", f"t * {n} + i div {n}", _scale(n, "t"), False)


def inverse_rows(a: str, n: int = 8) -> str:
    return _pass(a, n, f"(i div {n}) * {n} + t", f"t * {n} + i % {n}", _scale(n, "t"), False)


def forward(df, column: str, out: str, n: int = 8):
    return df.selectExpr("*", f"{forward_columns(forward_rows(column, n), n)} {out}")


def inverse(df, column: str, out: str, n: int = 8):
    return df.selectExpr("*", f"{inverse_rows(inverse_columns(column, n), n)} {out}")


def quadrant(a: str, q: str, side: int = 16, n: int = 8) -> str:
    """The q-th n*n tile of a side*side array, by rows of tiles."""
    return let(a, "src", f"transform(sequence(0, {n * n - 1}), i -> src[int((({q}) div {side // n} * {n} + i div {n}) * {side} + ({q}) % {side // n} * {n} + i % {n})])")


def hadamard4(a: str) -> str:
    """4x4 butterflies in both directions: signs of row u and column v are (-1)**(number of common bits) in Gray-free order."""
    sign = "case when bit_count({u} & {k}) % 2 = 0 then 1L else -1L end"
    su, sv = sign.format(u="(i div 4)", k="(t div 4)"), sign.format(u="(i % 4)", k="(t % 4)")
    return let(a, "src", f"transform(sequence(0, 15), i -> aggregate(sequence(0, 15), 0L, (acc, t) -> acc + src[t] * ({su}) * ({sv})))")
