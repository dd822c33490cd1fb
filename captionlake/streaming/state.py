"""Custom state: a gate for versions, a resequencer with holes, timers and a cap, and ordered folds as streams.

Rows of a key within a micro-batch are put in order before they are processed; a micro-batch is bounded by its source.
State is what the rule keeps and no more: held numbers are entries of a map, and a fold's state is bounded by its rule.
Every stream can begin from a table of states (``initial``), so it goes on where a batch job or a stopped stream ended.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> list:
    """The rows of a key in a micro-batch, as named tuples."""
    return sorted((r for frame in rows for r in frame.itertuples(index=False)), key=lambda r: tuple(getattr(r, c) for c in order))


class VersionGate(StatefulProcessor):
    """Per caption id: rows of a version above all before pass, with a cursor; a delete (event_type 'error') lets nothing pass after it. A state that nothing touches for ``ttl_ms`` is forgotten, if that is set."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", "version long, cursor long, dead boolean", self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.state.update((int(r["version"]), int(r["cursor"]), bool(r["dead"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, cursor, dead = self.state.get() if self.state.exists() else (-1, 0, False)
        out = []
        for r in in_order(rows, ["ts", "event_id"]):
            if dead or pd.isna(r.k) or r.k <= version:
                continue
            version, cursor, dead = int(r.k), cursor + 1, r.event_type == "error"
            out.append((key[0], r.event_id, version, cursor))
        self.state.update((version, cursor, dead))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "version", "cursor"]).astype("int64")

    def close(self) -> None:
        pass


class Resequencer(StatefulProcessor):
    """Per session: numbers are released in order.

    One that is held waits for the hole before it. A hole is given up as missing once ``wait_ms`` of event time pass after the first
    number was held behind it (if that is set), or as soon as more than ``cap`` numbers are held; numbers below the next one are retries and pass at
    once. Whether a hole timed out is told by the times of later rows, and where none come by a timer on the watermark, so
    results don't hang on how rows fall into micro-batches. Each held number is an entry of a map.
    """

    def __init__(self, wait_ms: int | None = 3000, cap: int = 32):
        self.wait_ms, self.cap = wait_ms, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, held long, due long")
        self.held = handle.getMapState("held", "k long", "event_id long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows of next, and of the numbers that are held (k, event_id; null where none is)."""
        held = initialState.dropna(subset=["k"])
        for r in held.itertuples():
            self.held.updateValue((int(r.k),), (int(r.event_id),))
        self.at.update((int(initialState["next"].iloc[0]), len(held), 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.next, self.n, due = self.at.get() if self.at.exists() else (0, 0, 0)
        before, self.out = due, []
        for r in in_order(rows, ["ts", "event_id"]):
            now, k = int(r.ts.timestamp() * 1000), int(r.k)
            while due and due <= now:
                due = self.settle(key, due, give_up=True)
            if k < self.next:
                self.out.append((key[0], k, int(r.event_id), "retry"))
                continue
            if not self.held.containsKey((k,)):
                self.n += 1
            self.held.updateValue((k,), (int(r.event_id),))
            due = self.settle(key, due, give_up=False, now=now)
        yield from self.end(before, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.next, self.n, due = self.at.get()
        self.out, before = [], due
        while due and due <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()):
            due = self.settle(key, due, give_up=True)
        yield from self.end(0 if before == expiredTimerInfo.getExpiryTimeInMs() else before, due)

    def settle(self, key, due: int, give_up: bool, now: int | None = None) -> int:
        """Release what can be; return when the hole that is left is given up (0: none). A hole given up by time lets those behind it go together; the next hole waits from there on."""
        first = self.next
        while self.n:
            if self.held.containsKey((self.next,)):
                self.out.append((key[0], self.next, self.held.getValue((self.next,))[0], "released"))
                self.held.removeKey((self.next,))
                self.n -= 1
                give_up = False
            elif give_up or self.n > self.cap:
                self.out.append((key[0], self.next, None, "missing"))
            else:
                break
            self.next += 1
        if not self.n or self.wait_ms is None:
            return 0
        return due if due and first == self.next else (due if now is None else now) + self.wait_ms

    def end(self, before: int, due: int) -> Iterator[pd.DataFrame]:
        if before != due:
            if before:
                self.handle.deleteTimer(before)
            if due:
                self.handle.registerTimer(due)
        self.at.update((self.next, self.n, due))
        if self.out:
            yield pd.DataFrame(self.out, columns=["user_id", "k", "event_id", "status"]).astype({"user_id": "int64", "k": "int64", "event_id": "Int64"})

    def close(self) -> None:
        pass


class OrderedFold(StatefulProcessor):
    """A fold of operators/folds.py over a stream: the same step on a state that is kept between micro-batches, for ``ttl_ms`` after its last row if that is set."""

    def __init__(self, order: list[str], columns: list[str], start: Callable, step: Callable, ttl_ms: int | None = None):
        self.order, self.columns, self.start, self.step, self.ttl_ms = order, columns, start, step, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "data binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else self.start()
        out = []
        for r in in_order(rows, self.order):
            out += self.step(state, r)
        self.state.update((pickle.dumps(state),))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def clock(ttl_ms: int | None) -> str:
    """Times to live are told by the wall clock, so results then hang on when rows come. Such a query runs batches without rows too, to forget states: with the
    trigger availableNow it ends only where spark.sql.streaming.noDataMicroBatches.enabled is false."""
    return "None" if ttl_ms is None else "ProcessingTime"


def gated(events: DataFrame, initial: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The gate over a stream. ``initial`` (user_id, version, cursor, dead): states to begin from. ``ttl_ms``: how long a state lives after its last row (None: for good)."""
    begin = None if initial is None else initial.groupBy("user_id")
    return events.groupBy("user_id").transformWithStateInPandas(VersionGate(ttl_ms), "user_id long, event_id long, version long, cursor long", "Append", clock(ttl_ms), begin)


def gate_states(events: DataFrame) -> DataFrame:
    """The gate's states after a table of its output rows (user_id, event_id, version, cursor) and their event types: user_id, version, cursor, dead."""
    last = F.max_by(F.struct("version", "cursor", (F.col("event_type") == "error").alias("dead")), "cursor")
    return events.groupBy("user_id").agg(last.alias("s")).select("user_id", "s.*")


def resequenced(events: DataFrame, wait_ms: int | None = 3000, cap: int = 32, initial: DataFrame | None = None) -> DataFrame:
    """The resequencer over a stream of (user_id, k, event_id, ts), with a watermark where holes time out. ``initial`` (user_id, next, k, event_id): states to begin from, a row for each held number."""
    begin = None if initial is None else initial.groupBy("user_id")
    mode = "None" if wait_ms is None else "EventTime"
    return events.filter("k IS NOT NULL").groupBy("user_id").transformWithStateInPandas(Resequencer(wait_ms, cap), "user_id long, k long, event_id long, status string", "Append", mode, begin)


def folded(lines: DataFrame, fold: tuple, ttl_ms: int | None = None) -> DataFrame:
    """A stream of (key, ...) through one of the folds of operators/folds.py: (order, schema, start, step). ``ttl_ms``: how long a key's state lives after its last row (None: for good)."""
    order, schema, start, step = fold
    columns = [c.split()[0] for c in schema.split(", ")]
    return lines.groupBy("key").transformWithStateInPandas(OrderedFold(order, columns, start, step, ttl_ms), schema, "Append", clock(ttl_ms))
