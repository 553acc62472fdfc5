"""Streaming form of the detector, and the hand-off of alerts to investigations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.metrics import error_count
from ..operators import detector, history
from ..operators.findings import alert_evidence, findings_from, investigation_history
from ..session import materialize, scratch_scope

ALERT_SCHEMA = T.StructType([
    T.StructField("tick", T.TimestampType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("trigger", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("error_rate", T.DoubleType()),
    T.StructField("avg_latency", T.DoubleType()),
])


def stream_window_stats(events: DataFrame, delay: str = "60 seconds") -> DataFrame:
    """``window_stats`` on a stream. Rows are summed into 5 s slots first, so slots, not rows,
    are copied into their twelve windows. Rows later than ``delay`` are dropped, which the
    query progress counts (``numRowsDroppedByWatermark``); windows leave the state once the
    watermark has passed them."""
    tick = f"{detector.TICK_SECONDS} seconds"
    slots = (events.withColumn("_at", detector.just_before(F.col("timestamp")))
             .withWatermark("_at", delay)
             .groupBy("customer_id", F.window("_at", tick).alias("slot"))
             .agg(F.count(F.lit(1)).alias("samples"), error_count().alias("errors"),
                  F.sum("latency_ms").alias("total_latency")))
    windows = slots.groupBy("customer_id", F.window(
        F.window_time("slot"), f"{detector.WINDOW_SECONDS} seconds", tick)).agg(
            *[F.sum(c).alias(c) for c in ("samples", "errors", "total_latency")])
    return detector.with_rates(windows.select(
        "customer_id", F.col("window.end").alias("tick"), "samples", "errors", "total_latency"))


class Cooldown(StatefulProcessor):
    """Per customer, the time until which anomalies are ignored. The state is given up once
    the watermark has passed that time. Only anomalous ticks come here, a few a minute."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState(
            "until", T.StructType([T.StructField("until", T.TimestampType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        ticks = pd.concat(rows).sort_values("tick")
        until = self.until.get()[0] if self.until.exists() else None
        fired = []
        for at, tick in enumerate(ticks["tick"]):
            if until is None or tick >= pd.Timestamp(until):
                fired.append(at)
                until = tick.to_pydatetime() + timedelta(seconds=detector.COOLDOWN_SECONDS)
        if fired:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(until.timestamp() * 1000))
            self.until.update((until,))
            yield ticks.iloc[fired].assign(
                trigger=detector.TRIGGER, reason=detector.REASON)[ALERT_SCHEMA.fieldNames()]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_alerts(events: DataFrame, delay: str = "60 seconds") -> DataFrame:
    """Alerts as the watermark closes windows; a customer's ticks arrive in time order."""
    return (detector.anomalies(stream_window_stats(events, delay))
            .select("customer_id", "tick", "error_rate", "avg_latency")
            .groupBy("customer_id")
            .transformWithStateInPandas(Cooldown(), ALERT_SCHEMA, "append", "EventTime"))


def start_investigations(alerts: DataFrame, read_events: Callable[[], DataFrame], path: str,
                         checkpoint: str, history_path: str | None = None,
                         **trigger) -> StreamingQuery:
    """Investigate each alert and store its findings and, below ``history_path``, the objects
    and snapshots of its session.

    Each batch is written out first: investigating it reads it several times, and must not
    run the stateful query again. Findings of a batch go to its own folder in overwrite mode.
    Its history is one run of the store, named by its content: a batch that is retried after a
    failure replaces what it wrote before, one that was stored is not stored again, whatever
    number it has. Sweeps may be stored below the same path.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            given = materialize(batch, "alerts")
            if given.isEmpty():
                return
            found = materialize(alert_evidence(given, read_events()), "evidence")
            findings_from(found, F.col("session_id")).write.mode("overwrite").parquet(
                f"{path}/batch_id={batch_id}")
            if history_path is not None:
                steps = materialize(investigation_history(found, trigger=detector.REASON), "steps")
                history.store_run(steps, history_path, history.content_run(steps))

    return (alerts.writeStream.foreachBatch(handle).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())
