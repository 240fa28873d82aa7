"""Stream operators with typed state that ends: message framing and overlapping frames, in the order of the messages' numbers.

A key's messages are numbered from 0. Those that come early wait in a list until the ones before them are there, whatever batch brings
them; those that come again are left out. The row `reset` true begins the key's state anew with that message. With `ttl_ms`, a timer
forgets a key that has had no message for that long: its next message, of whatever number, then begins anew.

State is kept by transformWithState, in RocksDB: run with stateful() in force. A call and its trips to the state store cost far more than
a short message, so that many short streams go faster in lanes: the streams that agree in the key's `lane` columns are handled in
one call, and their state is read and written together. A lane's streams must fit in memory.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stateful(spark: SparkSession) -> None:
    """The state store that typed state needs, for the queries started from now on."""
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ordered(StatefulProcessor):
    """Takes the rows of a key by their number, column `nth`. Subclasses say what state they keep and what a row makes of it."""

    #: Columns of a row besides the key, nth and reset; state besides the number that is due; output besides the key.
    columns: dict[str, str] = {}
    state: dict[str, str] = {}
    output: dict[str, str] = {}

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def fresh(self) -> list:
        raise NotImplementedError

    def step(self, state: list, nth: int, row: tuple) -> tuple[list, list[tuple]]:
        """(state, output rows) after a row."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a column of state is one array, as a lane's rows are read and written together
        ddl = lambda fields: ", ".join(f"{k} array<{v}>" for k, v in fields.items())
        own = dict.fromkeys(self.own, "string")
        self.handle = handle
        self.held = handle.getValueState("held", ddl({**own, "due": "long", "waits": "array<long>", **self.state}))
        self.early = handle.getListState("early", ddl({**own, "nth": "long", "reset": "boolean", **self.columns}))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names, k = [*self.own, "nth", "reset", *self.columns], len(self.own)
        plain = lambda x: x.tolist() if isinstance(x, np.ndarray) else x
        arrays = lambda rows: tuple(map(list, zip(*rows)))
        came: dict[tuple, dict] = {}
        for batch in rows:
            for r in zip(*(batch[c].tolist() for c in names)):
                came.setdefault(r[:k], {})[r[k]] = tuple(map(plain, r[k + 1 :]))
        held = {tuple(r[:k]): list(r[k:]) for r in zip(*(self.held.get() or ()))}
        for stream, new in came.items():
            # a key that was forgotten begins with what comes
            held.setdefault(stream, [min(new) if self.ttl_ms else 0, [], *self.fresh()])
        # what waits is read only where a stream can go on to it
        read = any(held[stream][1] and held[stream][0] in new for stream, new in came.items())
        early = {tuple(r[: k + 1]): tuple(r[k + 1 :]) for part in self.early.get() for r in zip(*part)} if read else {}
        out, added = [], []
        for stream, new in came.items():
            due, waits, *state = held[stream]
            waits = set(waits)
            while due in new or due in waits:
                waited = early.pop((*stream, due)) if due in waits else None
                waits.discard(due)
                row = new.pop(due, waited)
                if row[0]:
                    state = self.fresh()
                state, made = self.step(list(state), due, row[1:])
                out += [(*stream, *x) for x in made]
                due += 1
            more = {nth: row for nth, row in new.items() if nth > due and nth not in waits}
            added += [(*stream, nth, *row) for nth, row in more.items()]
            held[stream] = [due, sorted(waits.union(more)), *state]
        self.held.update(arrays((*stream, *x) for stream, x in held.items()))
        if read:
            left = [(*at, *row) for at, row in early.items()] + added
            self.early.put([arrays(left)]) if left else self.early.clear()
        elif added:
            self.early.appendValue(arrays(added))
        if self.ttl_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        yield self.made([(*key, *x) for x in out])

    def made(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self.lane, *self.own, *self.output])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.early.clear()
        yield self.made([])

    def close(self) -> None:
        pass


def applied(rows: DataFrame, keys: list[str], processor: Ordered, lane: list[str] | None = None) -> DataFrame:
    """rows (keys, nth, the processor's columns, and perhaps reset) -> keys and the processor's output. lane: those of the keys whose
    streams share a call; all keys, if left out. The other keys go through Python as text, which knows null."""
    if lane is not None and processor.ttl_ms:
        raise ValueError("a timer forgets a lane as a whole: streams that expire need a lane each")
    processor.lane = keys if lane is None else lane
    processor.own = [k for k in keys if k not in processor.lane]
    types = dict(rows.dtypes)
    own = [f"cast({k} as string) {k}" for k in processor.own]
    rows = rows.selectExpr(*processor.lane, *own, "cast(nth as long) nth", "coalesce(reset, false) reset" if "reset" in types else "false reset", *processor.columns)
    schema = ", ".join([f"{k} {types[k]}" for k in processor.lane] + [f"{k} string" for k in processor.own] + [f"{k} {v}" for k, v in processor.output.items()])
    out = rows.groupBy(*processor.lane).transformWithStateInPandas(processor, schema, "append", "ProcessingTime" if processor.ttl_ms else "None")
    return out.selectExpr(*[f"cast({k} as {types[k]}) {k}" for k in keys], *processor.output)


class Reassembly(Ordered):
    """Pieces of a byte stream of length-prefixed messages, cut anywhere -> the messages, numbered from 0 since the last reset.
    What is held is less than a message."""

    columns = {"data": "binary"}
    state = {"tail": "binary", "messages": "long"}
    output = {"message": "long", "payload": "binary"}

    def fresh(self) -> list:
        return [b"", 0]

    def step(self, state: list, nth: int, row: tuple) -> tuple[list, list[tuple]]:
        data, n, at, out = bytes(state[0]) + bytes(row[0]), state[1], 0, []
        while len(data) - at >= 4:
            (size,) = struct.unpack_from("<I", data, at)
            if len(data) - at - 4 < size:
                break
            out.append((n, data[at + 4 : at + 4 + size]))
            n, at = n + 1, at + 4 + size
        return [data[at:], n], out


class OverlapAdd(Ordered):
    """Frames of two hops each, every one's first hop lying over the second hop of the one before -> a hop for each frame. The first
    value of a frame is coded as its difference to that of the frame before."""

    columns = {"first": "long", "values": "array<long>"}
    state = {"last": "long", "tail": "array<long>"}
    output = {"frame": "long", "first": "long", "hop": "array<long>"}

    def __init__(self, hop: int, ttl_ms: int | None = None):
        super().__init__(ttl_ms)
        self.hop = hop

    def fresh(self) -> list:
        return [0, [0] * self.hop]

    def step(self, state: list, nth: int, row: tuple) -> tuple[list, list[tuple]]:
        first, values = state[0] + row[0], list(row[1])
        return [first, values[self.hop :]], [(nth, first, [a + b for a, b in zip(values[: self.hop], state[1])])]


def reassembled(pieces: DataFrame, keys: list[str], ttl_ms: int | None = None, lane: list[str] | None = None) -> DataFrame:
    """pieces (keys, nth, data, and perhaps reset) -> (keys, message, payload)."""
    return applied(pieces, keys, Reassembly(ttl_ms), lane)


def overlap_added(frames: DataFrame, keys: list[str], hop: int, ttl_ms: int | None = None) -> DataFrame:
    """frames (keys, nth, first, values, and perhaps reset) -> (keys, frame, first, hop)."""
    return applied(frames, keys, OverlapAdd(hop, ttl_ms))
