"""Customer health, recent events and deploy impact."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import error_count, error_percent, error_rate, round_half_up
from ..functions.quantiles import band_counts, exact_quantiles
from ..schema import EVENT_COLUMNS
from ..session import materialize


def partition_days(df: DataFrame) -> list | None:
    """The days of a day-partitioned table, newest first, from its list of partitions; None
    for any other table. No file is opened; there is one entry per day."""
    if "timestamp_day" not in df.columns:
        return None
    days = df.select("timestamp_day").distinct()
    key = "spark.sql.optimizer.metadataOnly"
    plain = df.sparkSession.conf.get(key)
    df.sparkSession.conf.set(key, "true")
    try:
        return sorted((r[0] for r in days.collect() if r[0] is not None), reverse=True)
    finally:
        df.sparkSession.conf.set(key, plain)


def newest_rows(df: DataFrame) -> DataFrame:
    """Rows that hold the newest timestamp: on a day-partitioned table the last day that has
    rows. Files without rows, as a failed or filtered write leaves them, don't count."""
    days = partition_days(df)
    for day in days or ():
        rows = df.where(F.col("timestamp_day") == F.lit(day))
        if not rows.select("timestamp").where(F.col("timestamp").isNotNull()).isEmpty():
            return rows
    return df


def latest_time(df: DataFrame) -> Column:
    """Newest timestamp as a scalar subquery."""
    return newest_rows(df).select(F.max("timestamp")).scalar()


def recent_window(df: DataFrame, minutes: int, as_of: Column | datetime | None = None) -> DataFrame:
    """Rows of the last ``minutes`` before ``as_of`` (default: the newest row). The lower
    end is exclusive. On a day-partitioned table the days are pruned as well.

    The start of the default window is one scalar subquery, which the scan takes as a
    pushed-down filter.
    """
    span = F.expr(f"INTERVAL '{int(minutes)}' MINUTE")
    if as_of is None:
        start = newest_rows(df).select(F.max("timestamp") - span).scalar()
        rows = df.where(F.col("timestamp") > start)
    else:
        start = F.lit(as_of) - span
        rows = df.where((F.col("timestamp") > start) & (F.col("timestamp") <= F.lit(as_of)))
    if "timestamp_day" in df.columns:
        rows = rows.where(F.col("timestamp_day") >= F.to_date(start))
        if as_of is not None:
            rows = rows.where(F.col("timestamp_day") <= F.to_date(F.lit(as_of)))
    return rows


def for_customer(df: DataFrame, customer: str | None) -> DataFrame:
    return df if customer is None else df.where(F.col("customer_id") == customer)


def metric_bands(df: DataFrame, keys: list[str]) -> DataFrame:
    """What ``request_metrics`` needs of the rows, per group, deploy version and latency band. Such
    tables of different rows add up."""
    return band_counts(
        df, list(dict.fromkeys([*keys, "deploy_version"])), "latency_ms",
        F.count(F.lit(1)).alias("_rows"), error_count().alias("_errors"),
        F.min("timestamp").alias("_earliest"), F.max("timestamp").alias("_latest"))


def request_metrics(df: DataFrame, keys: list[str], bands: DataFrame | None = None) -> DataFrame:
    """Per group: request count, p50/p99 latency (1 dp), error rate (%, 2 dp), latest
    deploy by text order, first and last time. Null keys are groups of their own.

    One pass counts everything per deploy version and latency band, and
    ``exact_quantiles`` goes on from there; grouping by the version keeps the string
    maximum out of the pass over the rows. ``bands`` may pass in the ``metric_bands`` of these
    rows by the same or finer keys, in any number of parts.
    """
    bands = materialize(metric_bands(df, keys) if bands is None else bands, "bands")
    counts = bands.groupBy(F.struct(*keys).alias("_key")).agg(
        F.sum("_rows").alias("request_count"),
        error_percent(F.sum("_errors"), F.sum("_rows")).alias("error_rate"),
        F.max("deploy_version").alias("latest_deploy"),
        F.min("_earliest").alias("first_seen"), F.max("_latest").alias("last_seen"))
    latency = exact_quantiles(df, keys, "latency_ms", {"p50": 0.5, "p99": 0.99}, bands)
    result = counts.join(latency.select(F.struct(*keys).alias("_key"), "p50", "p99"),
                         "_key", "left")
    return result.select(
        "_key.*", "request_count", round_half_up(F.col("p50"), 1).alias("p50_latency"),
        round_half_up(F.col("p99"), 1).alias("p99_latency"), "error_rate",
        "latest_deploy", "first_seen", "last_seen")


def customer_health(df: DataFrame, minutes: int | None = 5,
                    as_of: Column | datetime | None = None) -> DataFrame:
    """Health per customer over the look-back, worst p99 first. ``latest_deploy`` is the
    greatest version text, so v1.2.9 comes after v1.2.10."""
    rows = df if minutes is None else recent_window(df, minutes, as_of)
    return request_metrics(rows, ["customer_id", "customer_name"]).drop(
        "first_seen").orderBy(F.desc("p99_latency"), "customer_id", "customer_name")


def minute_bands(df: DataFrame) -> DataFrame:
    """``metric_bands`` per customer and minute: the parts of which health is put together."""
    kind = df.schema["timestamp"].dataType
    return metric_bands(df.withColumn("minute", F.date_trunc("minute", "timestamp").cast(kind)),
                        ["customer_id", "customer_name", "minute"])


def kept_health(df: DataFrame, kept: DataFrame, minutes: int = 5, as_of: datetime | None = None) -> DataFrame:
    """``customer_health`` out of ``kept``, the ``minute_bands`` of all rows of ``df`` in any number
    of parts, such as a stream keeps them.

    Whole minutes come from ``kept``. Of ``df`` only the minutes that the look-back cuts are
    counted, and the values in the bands that hold a quantile are ranked: one pass over the
    rows instead of two."""
    end = kept.agg(F.max("_latest")).first()[0] if as_of is None else as_of
    if end is None:
        return customer_health(df, minutes)
    start = end - timedelta(minutes=minutes)
    first = start.replace(second=0, microsecond=0) + timedelta(minutes=1)
    # Without ``as_of`` there is nothing after the newest minute's rows.
    last = end.replace(second=0, microsecond=0) + (timedelta(minutes=1) if as_of is None else timedelta())
    at = F.col("timestamp")
    rows = df.where((at > F.lit(start)) & (at <= F.lit(end)))
    if "timestamp_day" in df.columns:
        rows = rows.where(F.col("timestamp_day").between(F.lit(start.date()), F.lit(end.date())))
    whole = kept.where((F.col("minute") >= F.lit(first)) & (F.col("minute") < F.lit(last)))
    cut = rows.where((at < F.lit(first)) | (at >= F.lit(last)))
    bands = whole.unionByName(minute_bands(cut)).drop("minute")
    return request_metrics(rows, ["customer_id", "customer_name"], bands).drop("first_seen").orderBy(
        F.desc("p99_latency"), "customer_id", "customer_name")


def newest_days(df: DataFrame, limit: int) -> DataFrame:
    """On a day-partitioned table, the newest days that together hold ``limit`` rows; other
    tables are returned whole. Days are counted one after the other, twice as many each
    time, until there are enough rows, so older files are not opened."""
    days = partition_days(df)
    if not days:
        return df
    taken = 1
    while taken < len(days):
        newest = df.where(F.col("timestamp_day") >= F.lit(days[taken - 1]))
        if len(newest.select("timestamp_day").limit(limit).collect()) >= limit:
            return newest
        taken *= 2
    return df


def recent_events(df: DataFrame, limit: int = 50) -> DataFrame:
    """Newest events first; ties are ordered by trace id."""
    return (newest_days(df, limit).select(*EVENT_COLUMNS)
            .orderBy(F.desc("timestamp"), "trace_id").limit(limit))


def deploy_history(df: DataFrame, limit: int | None = 20) -> DataFrame:
    """Impact of each deploy version over the whole table, newest deploy first; None for
    all versions."""
    rows = (df.groupBy("deploy_version").agg(
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.count(F.lit(1)).alias("event_count"),
        F.countDistinct("customer_id").alias("customers_affected"),
        round_half_up(F.avg("latency_ms"), 1).alias("avg_latency"),
        error_rate().alias("error_rate"))
        .orderBy(F.desc("first_seen"), "deploy_version"))
    return rows if limit is None else rows.limit(limit)
