"""Alert damping over streams that come out of order (T2): rows wait in state until the watermark has passed them, then they are folded in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on local disk, with checkpoints in the shared folder: what ``stream_dampen_alerts`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def fold(rows: list[tuple], streak: int, wait: int, required: int, cooldown: int) -> tuple[list, int, int]:
    """(alert times, streak, wait) after ``rows`` of (time, order, flag) in order; rows in a cool-down are skipped."""
    alerts = []
    for at, _, flag in rows:
        if wait > 0:
            streak, wait = 0, wait - 1
            continue
        streak = streak + 1 if flag else 0
        if streak >= required:
            alerts.append(at)
            streak, wait = 0, cooldown
    return alerts, streak, wait


class Damping(StatefulProcessor):
    """State of a series: its rows that the watermark hasn't passed, and two counters.

    A timer fires when the watermark passes the first waiting row; the rows behind it are folded by (time, seq), and the timer moves on. Counters of zero
    are as good as none and are dropped at once; others go when nothing has come for ``idle_ms`` of event time, so dead series leave nothing.
    """

    def __init__(self, required: int, cooldown: int, idle_ms: int):
        self.required, self.cooldown, self.idle_ms = required, cooldown, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "streak int, wait int, last bigint")
        self.waiting = handle.getListState("waiting", "at bigint, seq bigint, flag boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(at), int(seq), bool(flag)) for pdf in rows for at, seq, flag in zip(pdf["at"], pdf["seq"], pdf["flag"], strict=True)]
        if came:
            self.waiting.appendList(came)
            self.handle.registerTimer(min(came)[0] // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] // 1000 <= passed], [r for r in rows if r[0] // 1000 > passed]
        streak, wait, last = self.counters.get() if self.counters.exists() else (0, 0, 0)
        alerts, streak, wait = fold(ready, streak, wait, self.required, self.cooldown)
        last = ready[-1][0] // 1000 if ready else last
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(later[0][0] // 1000)
        dead = not later and last + self.idle_ms <= passed
        if (streak, wait) == (0, 0) or dead:
            self.counters.clear()
        else:
            self.counters.update((streak, wait, last))
            if not later:
                self.handle.registerTimer(last + self.idle_ms)
        if alerts:
            yield pd.DataFrame({"entity": key[0], "metric": key[1], "at": alerts})

    def close(self) -> None:
        pass


def stream_dampen_alerts(flags: DataFrame, required: int = 3, cooldown: int = 6, delay: str = "10 minutes", idle_days: int = 7) -> DataFrame:
    """Hard alerts ``entity, metric, ts`` of a stream of ``entity, metric, ts, is_anomaly`` and, if it has one, ``seq``, as D17 raises them.

    Rows may come in any order within ``delay``; each is folded once the watermark has passed it, equal times by ``seq``, so that the result doesn't depend on batches. Rows behind the
    watermark are dropped, and the query's progress counts them. After ``idle_days`` without a row a series starts anew. Needs ``use_rocksdb``.
    """
    seq = F.col("seq").cast("long") if "seq" in flags.columns else F.lit(0).cast("long")
    ts = F.col("ts").cast("timestamp")
    rows = flags.select("entity", "metric", ts.alias("ts"), F.unix_micros(ts).alias("at"), seq.alias("seq"), F.coalesce("is_anomaly", F.lit(False)).alias("flag"))
    got = (
        rows.withWatermark("ts", delay)
        .groupBy("entity", "metric")
        .transformWithStateInPandas(Damping(required, cooldown, idle_days * 86_400_000), "entity string, metric string, at bigint", "append", "EventTime")
    )
    return got.select("entity", "metric", F.timestamp_micros("at").alias("ts"))


def late_rows(query) -> int:
    """How many rows of a stream came behind its watermark and were dropped, as far as its progress goes back."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p.get("stateOperators", []))
