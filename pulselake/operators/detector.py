"""Sliding-window anomaly detection per customer, batch form.

A tick every 5 s looks at the rows of the last 60 s, ``(tick - 60 s, tick]``. Event time
stands in for arrival time, so a replay gives the same alerts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import error_count
from ..session import materialize

# Detector settings.
WINDOW_SECONDS = 60
TICK_SECONDS = 5
COOLDOWN_SECONDS = 300
MIN_SAMPLES = 10
ERROR_FRACTION = 0.10
AVG_LATENCY_MS = 1000
TRIGGER, REASON = "auto", "anomaly_detected"

# Span of the blocks in which slots meet their windows.
BLOCK_SECONDS = 600

_DAY_TICKS = 86_400 // TICK_SECONDS
_COOLDOWN_TICKS = COOLDOWN_SECONDS // TICK_SECONDS


def just_before(time: Column) -> Column:
    """Spark windows hold their start, ticks hold their end: shift by a microsecond."""
    return time - F.expr("INTERVAL '0.000001' SECOND")


def with_rates(stats: DataFrame) -> DataFrame:
    return (stats.withColumn("error_rate", F.col("errors") / F.col("samples"))
            .withColumn("avg_latency", F.col("total_latency") / F.col("samples"))
            .drop("total_latency"))


def seconds_since_epoch(time: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {time})")


def window_stats(df: DataFrame) -> DataFrame:
    """Samples, errors, error fraction and mean latency per customer and tick.

    Rows are first summed into 5 s slots, so no shuffle carries rows. A slot counts in the
    twelve windows that hold it. Slots are placed by customer and ten-minute block, those
    whose windows reach into the next block in both, and are copied into their windows
    only there: the copies are summed where they are made and never shuffled.
    """
    slots = (df.select("customer_id", "status_code", "latency_ms",
                       F.window(just_before(F.col("timestamp")),
                                f"{TICK_SECONDS} seconds")["end"].alias("slot"))
             .groupBy("customer_id", "slot")
             .agg(F.count(F.lit(1)).alias("samples"), error_count().alias("errors"),
                  F.sum("latency_ms").alias("total_latency")))
    second = seconds_since_epoch("slot")
    reach = WINDOW_SECONDS - TICK_SECONDS
    placed = (slots.withColumn("block", F.explode(F.array_distinct(F.array(
        F.floor(second / BLOCK_SECONDS), F.floor((second + reach) / BLOCK_SECONDS)))))
        .repartition("customer_id", "block"))
    ticks = (placed
             .withColumn("_step", F.explode(F.sequence(
                 F.lit(0), F.lit(reach), F.lit(TICK_SECONDS))))
             .withColumn("tick", F.timestamp_add("SECOND", F.col("_step"), F.col("slot")))
             .where(F.floor(seconds_since_epoch("tick") / BLOCK_SECONDS) == F.col("block")))
    return with_rates(ticks.groupBy("customer_id", "block", "tick")
                      .agg(F.sum("samples").alias("samples"), F.sum("errors").alias("errors"),
                           F.sum("total_latency").alias("total_latency"))
                      .drop("block"))


def anomalies(stats: DataFrame) -> DataFrame:
    return stats.where((F.col("samples") >= MIN_SAMPLES)
                       & ((F.col("error_rate") > ERROR_FRACTION)
                          | (F.col("avg_latency") > AVG_LATENCY_MS)))


def alerts(df: DataFrame) -> DataFrame:
    return apply_cooldown(anomalies(window_stats(df)))


def apply_cooldown(anomalous: DataFrame) -> DataFrame:
    """Keep the ticks that fire: the first anomaly, then each first one at least five
    minutes after the last that fired.

    The rule is greedy, so one customer's ticks depend on each other. They are cut into
    days. For each day the cooldown left at its end is computed for every cooldown that
    may be left at its start; chaining these small arrays over a customer's days gives
    the true start of each day, and the days then fire independently. No task holds more
    than one day of ticks or one entry per day of a customer.
    """
    number = F.floor(seconds_since_epoch("tick") / TICK_SECONDS)
    days = materialize(
        anomalous
        .withColumn("_number", number)
        .withColumn("_day", F.floor(F.col("_number") / _DAY_TICKS))
        .withColumn("_at", (F.col("_number") - F.col("_day") * _DAY_TICKS).cast("int"))
        .groupBy("customer_id", "_day")
        .agg(F.array_sort(F.collect_list(
            F.struct("_at", "tick", "samples", "error_rate", "avg_latency"))).alias("_ticks")))

    def fire_or_wait(until: Column, tick: Column) -> Column:
        return F.when(tick["_at"] >= until, tick["_at"] + _COOLDOWN_TICKS).otherwise(until)

    carried = days.select("customer_id", "_day", F.aggregate(
        "_ticks", F.sequence(F.lit(0), F.lit(_COOLDOWN_TICKS - 1)),
        lambda untils, tick: F.transform(untils, lambda until: fire_or_wait(until, tick)),
        lambda untils: F.transform(untils, lambda until: F.greatest(
            until - _DAY_TICKS, F.lit(0)))).alias("_left"))

    def next_day(state: Column, day: Column) -> Column:
        start = F.when(day["_day"] == state["day"] + 1, state["left"]).otherwise(0)
        return F.struct(
            day["_day"].alias("day"), F.get(day["_left"], start).alias("left"),
            F.concat(state["starts"], F.array(F.struct(
                day["_day"].alias("_day"), start.alias("_start")))).alias("starts"))

    starts = (carried.groupBy("customer_id")
              .agg(F.array_sort(F.collect_list(F.struct("_day", "_left"))).alias("_days"))
              .select("customer_id", F.inline(F.aggregate(
                  "_days",
                  F.struct(F.lit(-2).cast("bigint").alias("day"), F.lit(0).alias("left"),
                           F.expr("CAST(array() AS ARRAY<STRUCT<_day: BIGINT, _start: INT>>)")
                           .alias("starts")),
                  next_day, lambda state: state["starts"]))))

    tick_type = anomalous.schema["tick"].dataType.simpleString()
    no_ticks = F.expr(f"CAST(array() AS ARRAY<STRUCT<_at: INT, tick: {tick_type}, "
                      "samples: BIGINT, error_rate: DOUBLE, avg_latency: DOUBLE>>)")
    fired = (days.join(starts, ["customer_id", "_day"])
             .select("customer_id", F.inline(F.aggregate(
                 "_ticks", F.struct(F.col("_start").alias("until"), no_ticks.alias("fired")),
                 lambda state, tick: F.when(
                     tick["_at"] >= state["until"],
                     F.struct((tick["_at"] + _COOLDOWN_TICKS).alias("until"),
                              F.concat(state["fired"], F.array(tick)).alias("fired")))
                 .otherwise(state),
                 lambda state: state["fired"]))))
    return fired.select("tick", "customer_id", F.lit(TRIGGER).alias("trigger"),
                        F.lit(REASON).alias("reason"), "error_rate", "avg_latency")


def alert_session() -> Column:
    """Id of the session that investigates an alert."""
    return F.sha2(F.concat_ws("|", "customer_id", F.col("tick").cast("string")), 256)


# The words of the line.
def alert_message(alert: DataFrame) -> DataFrame:
    """The alert as one line of text; a metric that is not known is left out."""
    at = F.date_format("tick", "yyyy-MM-dd'T'HH:mm:ss")
    percent = F.bround(F.col("error_rate") * 100, 1)
    return alert.withColumn("message", F.concat_ws(
        " ",
        F.format_string("ALERT at %s: Anomaly detected for customer %s.", at, "customer_id"),
        F.when(F.col("error_rate").isNotNull(),
               F.format_string("Current error rate: %.1f%%.", percent)),
        F.when(F.col("avg_latency").isNotNull(),
               F.format_string("Current avg latency: %.0fms.", F.bround("avg_latency", 0)))))
