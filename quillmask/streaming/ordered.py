"""Streams of numbered rows, put in order and read one after the other, with timers for those that stall or end.

A row that comes before its predecessors waits in state until they are there.  What is missing for `stall` seconds is given up:
`gap` says so, and the stream goes on behind it.  Rows that come twice, or after they were given up, are left out.  No row of one
stream fails or holds back another.  After `idle` minutes without rows a stream gives up its state; a row that comes later
begins it anew.  Timers run with micro-batches, also with those without data unless Spark is told not to make such.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from quillmask.functions import fixed

SECOND, MINUTE = 1_000, 60_000
#: rows of a stream that wait for a missing one at most; beyond, it is given up at once
WAITING = 10_000


class Ordered(StatefulProcessor):
    """One stream after the other; subclasses read rows by `take`.

    payload: schema of what a row carries beside its number; first: the first number; columns: of the output, the key first.
    """

    payload, first, columns, order = "", 0, (), ""
    #: whether numbers go on one by one; where they do not, rows are read in their order within a micro-batch
    gapless = True
    #: set by take where something that was begun is finished
    renewed = False

    def __init__(self, stall: float = fixed.STALL_SECONDS, idle: float = fixed.IDLE_MINUTES):
        self.stall, self.idle = int(stall * SECOND), int(idle * MINUTE)

    # what a stream does with its rows
    def open(self, handle) -> None:
        """Makes its state."""

    def take(self, key, number: int, *values) -> Iterator[tuple]:
        """Output of the next row."""
        return iter(())

    def gap(self, key, number: int) -> Iterator[tuple]:
        """Output where rows before this number are given up."""
        return iter(())

    def unfinished(self) -> bool:
        """Whether something is begun that should not take long."""
        return False

    def stalled(self, key) -> Iterator[tuple]:
        """Output where what is begun has taken too long."""
        return iter(())

    def end(self, key) -> Iterator[tuple]:
        """Output when the stream gives up its state, which is cleared here."""
        return iter(())

    # order and timers
    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, since long, active long")
        self.ahead = handle.getMapState("ahead", "number long", self.payload)
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        clock = timerValues.getCurrentProcessingTimeInMs()
        number, since, _ = self.at.get() if self.at.exists() else (self.first, -1, clock)
        names, out, begun, self.renewed = [f.split()[0] for f in self.payload.split(", ")], [], number, False
        came = sorted((r for pdf in rows for r in pdf[[self.order, *names]].itertuples(index=False, name=None)), key=lambda r: r[0])
        waiting = {k[0] for k in self.ahead.keys()}
        for n, *values in came:
            if not self.gapless:
                out += self.take(key, n, *values)
            elif n == number:
                out += self.take(key, n, *values)
                number += 1
                while number in waiting:
                    out += self._next(key, number, waiting)
                    number += 1
            elif n > number and n not in waiting:
                self.ahead.updateValue((n,), tuple(values))
                waiting.add(n)
        while len(waiting) > WAITING:
            number = self._skip(key, waiting, out)
        since = self._since(-1 if self.renewed or (waiting and number != begun) else since, waiting, clock)
        self._keep(number, since, clock, clock)
        yield from self._given(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        clock = timerValues.getCurrentProcessingTimeInMs()
        if not self.at.exists():
            return
        number, since, active = self.at.get()
        out, waiting = [], {k[0] for k in self.ahead.keys()}
        if since >= 0 and clock >= since + self.stall:
            if waiting:
                number = self._skip(key, waiting, out)
            else:
                out += self.stalled(key)
            since = self._since(-1, waiting, clock)
        if clock >= active + self.idle:
            out += self.end(key)
            self._timers()
            self.at.clear()
            self.ahead.clear()
        else:
            self._keep(number, since, active, clock)
        yield from self._given(out)

    def _next(self, key, number: int, waiting: set) -> list:
        values = self.ahead.getValue((number,))
        self.ahead.removeKey((number,))
        waiting.discard(number)
        return list(self.take(key, number, *values))

    def _skip(self, key, waiting: set, out: list) -> int:
        """Goes on with the first row that waits; gives the number after those that follow it."""
        number = min(waiting)
        out += self.gap(key, number)
        while number in waiting:
            out += self._next(key, number, waiting)
            number += 1
        return number

    def _since(self, since: int, waiting: set, clock: int) -> int:
        """When what is unfinished began, -1 if nothing is."""
        return (since if since >= 0 else clock) if waiting or self.unfinished() else -1

    def _timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _keep(self, number: int, since: int, active: int, clock: int) -> None:
        self.at.update((number, since, active))
        self._timers()
        due = active + self.idle
        self.handle.registerTimer(max(clock + 1, min(due, since + self.stall) if since >= 0 else due))

    def _given(self, out: list) -> Iterator:
        import pandas as pd

        if out:
            yield pd.DataFrame(out, columns=list(self.columns))

    def close(self) -> None:
        pass


def rocks(spark: SparkSession) -> None:
    """State with timers and several variables needs this provider; it is set for the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ordered(rows: DataFrame, key: str, order: str, reader: Ordered, schema: str, first: int | None = None) -> DataFrame:
    """The output of a reader for each stream (key) of rows numbered by order."""
    rocks(rows.sparkSession)
    reader.order, reader.columns = order, [f.split()[0] for f in schema.split(", ")]
    names = [f.split()[0] for f in reader.payload.split(", ")]
    reader.first = reader.first if first is None else first
    return rows.select(key, order, *names).groupBy(key).transformWithStateInPandas(reader, schema, "Append", "processingTime")
