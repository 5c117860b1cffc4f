"""A rate limiter's state, a key at a time, on a stream.

Each rejected request doubles the key's cooldown up to a limit, each accepted
one ends the run; a cooldown never shrinks. The state of a key is one row. A
timer drops it once the key has been idle for long.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "user_id long, event_id long, run int, delay double, wait double"
#: Seconds of the first cooldown and of the longest.
BASE, MOST = 1.0, 60.0


class Limiter(StatefulProcessor):
    """``run``: rejections in a row; ``delay``: the cooldown after a rejection; ``wait``: what a request had to wait."""

    def __init__(self, base: float = BASE, most: float = MOST, idle_ms: int = 7 * 86_400_000) -> None:
        self.base, self.most, self.idle_ms = base, most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("limiter", "run int, until_us long, seen_us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run, until, seen = self.state.get() if self.state.exists() else (0, 0, 0)
        pdf = pd.concat(list(rows)).sort_values(["us", "event_id"])  # of one key and batch
        out = []
        for us, event, rejected in zip(pdf["us"].tolist(), pdf["event_id"].tolist(), pdf["rejected"].tolist(), strict=True):
            wait = max(0, until - us) / 1e6
            run = run + 1 if rejected else 0
            delay = min(self.most, self.base * 2 ** (run - 1)) if rejected else 0.0
            until, seen = max(until, us + int(delay * 1e6)) if rejected else until, max(seen, us)
            out.append((key[0], event, run, delay, wait))
        self.state.update((run, until, seen))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(seen // 1000 + self.idle_ms)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "run", "delay", "wait"]).astype({"run": "int32"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited(events: DataFrame, processor: Limiter | None = None, late: str = "1 day") -> DataFrame:
    """Each event of a stream (``event_id, ts, user_id, event_type``; ``error`` is a rejection) with its run, cooldown and wait.

    Events of a key are taken in order of time within a batch. The state lives in RocksDB: the session must name that
    provider (``rocksdb_state``).
    """
    e = events.select("event_id", "user_id", (F.col("event_type") == "error").alias("rejected"), F.col("ts").cast("timestamp").alias("ts")).withColumn("us", F.unix_micros("ts"))
    return e.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(statefulProcessor=processor or Limiter(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def rocksdb_state(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
