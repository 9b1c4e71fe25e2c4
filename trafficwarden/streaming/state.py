"""Stateful jobs on typed state and timers: sustained breaches of a signal, holds that time out.

State lies in the RocksDB store, so the keys of a partition need not fit in memory, and can be read
from outside (``spark.read.format("statestore")``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks(spark: SparkSession) -> None:
    """New streams of the session keep their state in RocksDB; streams with a checkpoint stay with the store named there."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKS)


class Breaches(StatefulProcessor):
    """For each signal: the run of breaches up to the last settled window, and the windows after it that wait for earlier ones."""

    def __init__(self, threshold: float, sustained: int, wait: int, forget: int | None):
        self.threshold, self.sustained, self.wait, self.forget = threshold, sustained, wait, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.settled = handle.getValueState("settled", "last long, newest long, run long, fired boolean", self.forget)
        self.waiting = handle.getMapState("waiting", "window long", "breach boolean", self.forget)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, newest, run, fired = self.settled.get() or (None, None, 0, False)
        for part in rows:
            part = part[part["window"].notna()]
            for w, v in zip(part["window"].astype("int64").tolist(), part["psi"].tolist()):
                newest = w if newest is None else max(newest, w)
                if (last is None or w > last) and not self.waiting.containsKey((w,)):
                    self.waiting.updateValue((w,), (bool(v >= self.threshold),))
        if newest is None:
            return
        out = []
        for w, breach in sorted((k[0], v[0]) for k, v in self.waiting.iterator()):
            if w > newest - self.wait:
                break
            self.waiting.removeKey((w,))
            last, run = w, run + 1 if breach else 0
            if run >= self.sustained and not fired:
                fired = True
                out.append((key[0], w))
        self.settled.update((last, newest, run, fired))
        yield pd.DataFrame(out, columns=["signal", "window"])


def sustained_breaches(signals: DataFrame, threshold: float = 0.2, sustained: int = 2, wait: int = 0, forget: int | None = None) -> DataFrame:
    """signal, window at which so many breaches in a row are reached (once).

    signals: window, signal, psi. A window is settled when one ``wait`` or more later has come, so
    windows that are late by less than that still count in their place; later ones, and a window that
    comes again, are left out (of equal ones in a batch the first counts). A null psi is no breach, a null
    window is left out. A signal keeps one row and the windows it waits for. With ``forget`` (milliseconds
    of the clock) a signal that is silent so long starts anew.
    """
    use_rocks(signals.sparkSession)
    mode = "None" if forget is None else "ProcessingTime"
    rows = signals.select("signal", F.col("window").cast("long").alias("window"), F.col("psi").cast("double").alias("psi"))
    return rows.groupBy("signal").transformWithStateInPandas(Breaches(threshold, sustained, wait, forget), "signal string, window long", "append", mode)


class Holds(StatefulProcessor):
    """For the ids of a group: when each one's hold is due, then, for as long again, that it has its outcome.

    A group has one list and one timer, at the first of its times: calls to the state server are a few
    for each group and batch, not for each id. The list holds what waits, or came in the last batch.
    """

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.holds = handle.getListState("holds", "id string, at long, settled boolean")
        self.timer = handle.getValueState("timer", "at long")

    def _held(self) -> dict[str | None, tuple[int, bool]]:
        return {i: (at, settled) for i, at, settled in self.holds.get()}

    def _remember(self, held: dict[str | None, tuple[int, bool]], expired: int | None = None, least: int | None = None) -> None:
        """Keep the list and set the timer, not before least; an expired one is gone by itself."""
        if held:
            self.holds.put([(i, at, settled) for i, (at, settled) in held.items()])
        else:
            self.holds.clear()
        before = self.timer.get()
        before, due = before[0] if before else None, min((at for at, _ in held.values()), default=None)
        due = max(due, least) if due is not None and least is not None else due
        if before == due and before != expired:
            return
        if before is not None and before != expired:
            self.handle.deleteTimer(before)
        if due is None:
            self.timer.clear()
        else:
            self.timer.update((due,))
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came: dict[str | None, dict[bool, tuple[int, str]]] = {}  # the first of the holds and of the decisions of each id
        for part in rows:
            for i, at, kind in zip(part["id"].tolist(), part["ms"].tolist(), part["kind"].tolist()):
                first = came.setdefault(i, {})
                first[kind == "hold"] = min((at, kind), first.get(kind == "hold", (at, kind)))
        held, out = self._held(), []
        for i, first in came.items():
            at, settled = held.get(i, (None, False))
            if settled:
                continue
            due = at if at is not None else first[True][0] + self.wait if True in first else None
            if False in first:
                when, kind = first[False]
                held[i] = (when + self.wait, True)
                out.append((i, "deny" if due is not None and when > due else kind))
            elif at is None:
                held[i] = (due, False)
        self._remember(held)
        if out:
            yield pd.DataFrame(out, columns=["id", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held, out = timerValues.getCurrentWatermarkInMs(), {}, []
        for i, (at, settled) in self._held().items():
            if at > now:
                held[i] = (at, settled)
            elif not settled:
                held[i] = (at + self.wait, True)
                out.append((i, "deny"))
        self._remember(held, expiredTimerInfo.getExpiryTimeInMs(), now + 1)
        if out:
            yield pd.DataFrame(out, columns=["id", "outcome"])


#: Groups of ids that share a list and a timer.
GROUPS = 1024


def hold_timeouts(stream: DataFrame, seconds: int = 300, late: str = "1 minute") -> DataFrame:
    """id, outcome, once for an id: its first decision, or deny where none came in time after its first hold.

    stream: id, ts, kind (hold or a decision). An outcome is remembered as long again, so that what
    comes after it gives no second one. Of decisions at one time the first in alphabetical order
    counts; rows of a null ts or kind are left out.
    """
    use_rocks(stream.sparkSession)
    # milliseconds come from Spark: times in Python have no zone
    rows = stream.filter("ts is not null and kind is not null").withWatermark("ts", late).select(F.pmod(F.xxhash64("id"), F.lit(GROUPS)).alias("of"), F.col("id").cast("string").alias("id"), "ts", "kind", F.unix_millis("ts").alias("ms"))
    found = rows.groupBy("of").transformWithStateInPandas(Holds(seconds * 1000), "id string, outcome string", "append", "EventTime")
    return found.select(F.col("id").cast("long").alias("id"), "outcome")
