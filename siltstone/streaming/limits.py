"""The request limiter and request metrics, for batches and for streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def admit(times, held: deque, limit: int, seconds: float) -> list[bool]:
    """Greedy sliding window: a request is let in if fewer than `limit` admitted ones are at most `seconds` old."""
    out = []
    for t in times:
        while held and t - held[0] > seconds:
            held.popleft()
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out


def limit_batch(log: DataFrame, limit: int = 20, seconds: float = 60.0, ceiling: int | None = None) -> DataFrame:
    """log (event_id, key, at) with allowed, in the order of (at, event_id) within a key.

    Only the first `ceiling` requests of all keys can be let in, and later ones take no place of their key. Acceptance
    depends on earlier acceptances, so a key is one sequence. It streams through its task in sorted batches; only the
    last `limit` admitted times are held, however many rows a key has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, deque()
        for b in batches:
            allowed = np.zeros(len(b), bool)
            keys, at, under = b["key"].to_numpy(), b["at"].to_numpy(), b["under"].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1]) if len(b) else []
            for a, z in zip(starts, [*starts[1:], len(b)]):
                if keys[a] != key:
                    key, held = keys[a], deque()
                own = a + np.flatnonzero(under[a:z])
                allowed[own] = admit(at[own].tolist(), held, limit, seconds)
            yield b.drop(columns="under").assign(allowed=allowed)

    rows = log.select("event_id", "key", "at")
    under = F.lit(True)
    if ceiling is not None:  # the last of the first `ceiling` requests
        last = rows.orderBy("at", "event_id").limit(ceiling).agg(F.max(F.struct("at", "event_id")).alias("last"))
        rows, under = rows.crossJoin(F.broadcast(last)), F.coalesce(F.struct("at", "event_id") <= F.col("last"), F.lit(False))
    rows = rows.select("event_id", "key", "at", under.alias("under")).repartition("key").sortWithinPartitions("key", "at", "event_id")
    return rows.mapInPandas(run, "event_id long, key long, at double, allowed boolean")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TAKEN = "event_id long, key long, at double, seen timestamp, under boolean"


class Ceiling(StatefulProcessor):
    """Marks the first `ceiling` requests of all keys, by (at, event_id) within a micro-batch. State: how many were marked.

    Only as many rows as are left under the ceiling are held; every other row goes on as soon as it is displaced.
    """

    def __init__(self, ceiling: int):
        self.ceiling = ceiling

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marked = handle.getValueState("marked", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.marked.get()[0] if self.marked.exists() else 0
        left, held = self.ceiling - before, None
        for frame in rows:
            if left > 0:
                held = (frame if held is None else pd.concat([held, frame])).sort_values(["at", "event_id"])
                held, frame = held.iloc[:left], held.iloc[left:]
            if len(frame):
                yield frame[["event_id", "key", "at", "seen"]].assign(under=False)
        if held is not None and len(held):
            self.marked.update((before + len(held),))
            yield held[["event_id", "key", "at", "seen"]].assign(under=True)

    def close(self) -> None:
        pass


class KeyedWindow(StatefulProcessor):
    """The sliding window of a key, over a micro-batch's rows in the order of (at, event_id). State: its last admitted
    times, at most `limit`; a timer drops them once no later request can meet them."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"])  # a key's rows of one micro-batch
        held = deque(self.held.get()[0]) if self.held.exists() else deque()
        under = frame["under"].to_numpy()
        allowed = np.zeros(len(frame), bool)
        allowed[under] = admit(frame["at"].to_numpy()[under].tolist(), held, self.limit, self.seconds)
        if held:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.held.update((list(held),))
            self.handle.registerTimer(int((held[-1] + self.seconds + 2) * 1000) + 1)
        yield frame[["event_id", "key", "at"]].assign(allowed=allowed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "key": pd.Series(dtype="int64"), "at": pd.Series(dtype="float64"), "allowed": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def limit_stream(log: DataFrame, limit: int = 20, seconds: float = 60.0, late: str = "10 minutes", ceiling: int | None = None) -> DataFrame:
    """The same over a stream whose micro-batches follow each other in time; within one, rows come in any order. `at` counts seconds since the epoch.

    A key's state goes once the watermark has passed its last admitted request by `seconds`. Requests over `late` behind the newest are dropped.
    The ceiling counts the requests of all keys, so it is one sequence: a micro-batch passes one task for it, which holds no more rows
    than are left under the ceiling. State is kept in RocksDB: this sets the session's state store provider, which a query reads when it starts.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # a second on, since the watermark begins at the epoch and takes rows at it for late
    rows = log.select("event_id", "key", "at", F.timestamp_seconds(F.col("at") + 1).alias("seen")).withWatermark("seen", late)
    if ceiling is None:
        rows = rows.withColumn("under", F.lit(True))
    else:
        rows = rows.withColumn("all", F.lit(0)).groupBy("all").transformWithStateInPandas(Ceiling(ceiling), TAKEN, "Append", "EventTime", eventTimeColumnName="seen")
    return rows.groupBy("key").transformWithStateInPandas(KeyedWindow(limit, seconds), "event_id long, key long, at double, allowed boolean", "Append", "EventTime")


def metrics_stream(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: request counts and mean durations by window and path. log (ts, path, status, ms)."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "path").agg(F.count("*").alias("requests"), F.avg("ms").alias("mean_ms")).select("window.start", "path", "requests", "mean_ms")
