"""Online calibration by a stateful processor: a key's adaptive level and trailing scores as named state, with event-time
timers that let idle keys go, messages that start a key anew, and late rows that are counted and shown.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isfinite

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from calibrant.operators.segments import quantile

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MADE = ("w", "s", "thr", "alpha_t", "late")


class AdaptiveLevel(StatefulProcessor):
    """ACI of one key. State: level (alpha_t, the last step, the timer, the number of late rows) and scores (the last `size`).

    Rows of a micro-batch are taken in order of step; a row whose step isn't after the last one is late: it is counted,
    shown with the count in `late`, and leaves the state as it is. A row with reset starts the key anew, with its own score.
    A key without rows for `idle_ms` of event time is dropped, and starts anew if it comes back."""

    def __init__(self, keys: list[str], alpha: float, gamma: float, size: int, test_from: int, idle_ms: int):
        self.keys, self.alpha, self.gamma, self.size, self.test_from, self.idle_ms = keys, alpha, gamma, size, test_from, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", "alpha_t double, last bigint, timer bigint, late bigint")
        self.scores = handle.getListState("scores", "s double")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        a, last, timer, late = self.level.get() if self.level.exists() else (self.alpha, -(1 << 62), 0, 0)
        recent = [r[0] for r in self.scores.get()] if self.scores.exists() else []
        given = pd.concat(list(rows)).sort_values("w")
        made, changed = [], False
        if timer and timerValues.getCurrentWatermarkInMs() >= timer:  # due, but a micro-batch's rows come before its timers
            a, last, recent, changed, late = self.alpha, -(1 << 62), [], True, 0
        for w, s, reset in zip(given["w"].tolist(), given["s"].tolist(), given["reset"].tolist()):
            if reset:
                a, last, recent, changed = self.alpha, -(1 << 62), [], True
            if w <= last:
                late += 1
                made.append((*key, w, s, None, None, late))
                continue
            last = w
            s = float(s) if s is not None and isfinite(s) else None
            if w >= self.test_from:
                q = quantile(sorted(recent), a)
                made.append((*key, w, s, q, a, 0))
                if s is not None:
                    a = min(max(a + self.gamma * (self.alpha - (1.0 if s > q else 0.0)), 0.0), 1.0)
            if s is not None:
                recent, changed = [*recent, s][-self.size :], True
        due = int(given["at"].max().timestamp() * 1000) + self.idle_ms
        if due > timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.level.update((a, int(last), timer, late))
        if changed:
            if recent:
                self.scores.put([(x,) for x in recent])
            else:
                self.scores.clear()
        if made:
            yield pd.DataFrame(made, columns=[*self.keys, *MADE])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.level.clear()
        self.scores.clear()
        return iter(())


def adaptive_levels(rows: DataFrame, keys: list[str], alpha: float, gamma: float = 0.005, size: int = 100, test_from: int = 0, idle: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """A streaming frame of keys, w, s, thr, alpha_t and late for one of keys, w, s, at (event time) and reset. Rows behind
    the watermark (`delay` after the latest event time) don't arrive; idle is in seconds of event time."""
    types = dict(rows.dtypes)
    out = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", w bigint, s double, thr double, alpha_t double, late bigint"
    processor = AdaptiveLevel(keys, alpha, gamma, size, test_from, idle * 1000)
    return rows.withWatermark("at", delay).groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "EventTime")


def run_files(made: DataFrame, to: str, checkpoint: str) -> DataFrame:
    """Run the stream over the files there are, write it to a Parquet table exactly once, and read that back. State is kept
    in RocksDB, which named state needs; the session's own choice is put back."""
    spark = made.sparkSession
    kept = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = made.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if kept is None else spark.conf.set(PROVIDER, kept)
    return spark.read.schema(made.schema).parquet(to)


def levels_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The named state `level` as it was left, read by the state data source: a row a key."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "level").load()
    return rows.select("key.*", "value.*")
