"""Stateful stream operators: group buffer, presentation reorder, sequence check. State is kept per key and stays small."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

GROUP = 4


def _stateful(rows: DataFrame, function, output: str, state: str) -> DataFrame:
    return rows.groupBy("part").applyInPandasWithState(function, output, state, "append", GroupStateTimeout.NoTimeout)


def group_order(n: int) -> list[int]:
    """Places of a group of n pictures in coding order: the last is the anchor, then the middle, then the others."""
    middle = [(n - 1) // 2] if n > 1 else []
    return [n - 1] + middle + [i for i in range(n - 1) if i not in middle]


class GroupBuffer:
    """Holds pictures until a group is whole. flag: "force" makes a picture a key picture, "end" flushes what is held."""

    def __init__(self, started: bool = False, held: list[int] | None = None, groups: int = 0):
        self.started, self.held, self.groups = started, list(held or []), groups

    def flush(self) -> list[tuple[int, int, int]]:
        out = [(self.held[i], place, self.groups) for place, i in enumerate(group_order(len(self.held)))] if self.held else []
        self.groups += bool(self.held)
        self.held = []
        return out

    def push(self, seq: int, flag: str | None = None) -> list[tuple[int, int, int]]:
        """(seq, place, group) of what can be coded now; a key picture has group -1."""
        if flag == "end":
            return self.flush()
        if not self.started or flag == "force":
            out = self.flush()
            self.started, self.groups = True, 0
            return out + [(seq, 0, -1)]
        self.held.append(seq)
        return self.flush() if len(self.held) == GROUP else []


def group_buffer(rows: DataFrame) -> DataFrame:
    """rows (part, seq, and perhaps flag): the first picture goes at once; each four after it are held, then put out in coding order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        buffer = GroupBuffer(*state.get) if state.exists else GroupBuffer()
        out: list[tuple] = []
        b = pd.concat(list(batches))
        for b in [b.sort_values(["seq", "flag"], na_position="first") if "flag" in b else b.sort_values("seq")]:
            for seq, flag in zip(b["seq"], b["flag"] if "flag" in b else [None] * len(b)):
                out += [(key[0], *x) for x in buffer.push(int(seq), flag)]
        state.update((buffer.started, buffer.held, buffer.groups))
        yield pd.DataFrame(out, columns=["part", "seq", "place", "grp"])

    return _stateful(rows, run, "part long, seq long, place long, grp long", "started boolean, held array<long>, groups int")


def reorder_buffer(rows: DataFrame) -> DataFrame:
    """rows (part, coded, display): each is put out as soon as all displays before it are; after: the coded place then."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        expected, held = (int(state.get[0]), list(state.get[1])) if state.exists else (0, [])
        waiting, out = set(held), []
        for coded, display in sorted((c, d) for b in batches for c, d in zip(b["coded"], b["display"])):
            waiting.add(int(display))
            while expected in waiting:
                waiting.remove(expected)
                out.append((key[0], expected, int(coded)))
                expected += 1
        state.update((expected, sorted(waiting)))
        yield pd.DataFrame(out, columns=["part", "display", "after"])

    return _stateful(rows, run, "part long, display long, after long", "expected long, held array<long>")


def sequence_check(rows: DataFrame) -> DataFrame:
    """rows (part, seq): those whose number isn't the one expected, with it; the count then goes on from there."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        expected = int(state.get[0]) if state.exists else None
        out = []
        for seq in sorted(s for b in batches for s in b["seq"]):
            if expected is not None and seq != expected:
                out.append((key[0], int(seq), expected))
            expected = int(seq) + 1
        if expected is not None:
            state.update((expected,))
        yield pd.DataFrame(out, columns=["part", "seq", "expected"])

    return _stateful(rows, run, "part long, seq long, expected long", "expected long")
