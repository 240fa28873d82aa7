"""Integer formulas as SQL text, for Spark expressions. Division truncates, as `div` does."""

from __future__ import annotations


def array(values: list[int]) -> str:
    return "array(" + ", ".join(f"{v}L" for v in values) + ")"


def rdiv(n: str, d: str) -> str:
    """Quotient rounded half away from zero."""
    return f"(case when (({n}) < 0) != (({d}) < 0) then (({n}) - ({d}) div 2) div ({d}) else (({n}) + ({d}) div 2) div ({d}) end)"


def clip(v: str, low: int | str, high: int | str) -> str:
    return f"least(greatest({v}, {low}), {high})"


def bit_length(v: str) -> str:
    """Bits of a positive integer."""
    return f"cast(length(bin({v})) as bigint)"


def floor_log2(v: str) -> str:
    """Floor of log2; 0 for 0."""
    return f"(case when ({v}) > 0 then {bit_length(v)} - 1 else 0L end)"


def let(value: str, name: str, body: str) -> str:
    """body with `name` bound to value. A lambda evaluates what stands in it for each element, and the optimizer moves
    a column's expression into the lambda that names it; a value bound outside is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def total(array_: str) -> str:
    return f"aggregate({array_}, 0L, (a, x) -> a + x)"


def signed_code(v: str) -> str:
    """The number whose Exp-Golomb code a signed value takes: 1 for 0, else twice its size, plus 1 if negative."""
    return f"(case when ({v}) = 0 then 1L else abs({v}) * 2 + (case when ({v}) < 0 then 1 else 0 end) end)"
