"""Survey, peer comparison and drill-down of degraded customers.

Every function works on all customers at once; ``customer`` narrows the scan to one,
which prunes partitions on a table partitioned by customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import (
    MIN_REQUESTS, ONSET_REQUESTS, OUTLIER_FACTOR, WARNING_ERROR_RATE, WARNING_P99, is_degraded,
    is_server_error, round_half_up, severity,
)
from .health import for_customer, request_metrics

METRICS = ["request_count", "p50_latency", "p99_latency", "error_rate"]


def survey(health: DataFrame) -> DataFrame:
    """Customers above 5 % errors or 500 ms p99; no row means all are healthy."""
    return health.where(is_degraded(F.col("p99_latency"), F.col("error_rate")))


def min_sample_gate(health: DataFrame) -> DataFrame:
    return health.where(F.col("request_count") >= MIN_REQUESTS)


def baseline_outliers(health: DataFrame) -> DataFrame:
    """Surveyed customers that stand out from the group: a metric is above its limit and
    above three times the median over all customers with enough requests.

    The medians come in as a scalar subquery, so customers are never paired up. Pass a
    materialised ``health``, it is read twice.
    """
    eligible = min_sample_gate(health)
    # One row per customer, and rounded values: what the aggregate holds is bounded by those.
    medians = eligible.agg(F.struct(*[F.percentile(c, 0.5).alias(c) for c in (
        "error_rate", "p99_latency")])).scalar()
    rate, p99 = F.col("error_rate"), F.col("p99_latency")
    return (eligible.withColumn("_medians", medians)
            .withColumn("median_error_rate", round_half_up(F.col("_medians")["error_rate"], 3))
            .withColumn("median_p99", round_half_up(F.col("_medians")["p99_latency"], 2))
            .drop("_medians")
            .where(((rate > WARNING_ERROR_RATE)
                    & (rate > F.lit(OUTLIER_FACTOR) * F.col("median_error_rate")))
                   | ((p99 > WARNING_P99) & (p99 > F.lit(OUTLIER_FACTOR) * F.col("median_p99")))))


def with_severity(health: DataFrame) -> DataFrame:
    return health.withColumn("severity", severity(
        F.col("p99_latency"), F.col("error_rate"), F.col("request_count")))


def by_endpoint(df: DataFrame, customer: str | None = None, *scope: str) -> DataFrame:
    keys = [*scope, "customer_id", "endpoint"]
    return request_metrics(for_customer(df, customer), keys).select(*keys, *METRICS)


def by_deploy(df: DataFrame, customer: str | None = None, *scope: str) -> DataFrame:
    """Metrics per deploy version and their change from the version seen before it."""
    keys = [*scope, "customer_id", "deploy_version"]
    return deploy_changes(request_metrics(for_customer(df, customer), keys), *scope)


def deploy_changes(metrics: DataFrame, *scope: str) -> DataFrame:
    order = Window.partitionBy(*scope, "customer_id").orderBy("first_seen", "deploy_version")
    return (metrics.select(*scope, "customer_id", "deploy_version", "first_seen", *METRICS)
            .withColumn("error_rate_change", round_half_up(
                F.col("error_rate") - F.lag("error_rate").over(order), 2))
            .withColumn("p99_change", round_half_up(
                F.col("p99_latency") - F.lag("p99_latency").over(order), 1)))


def timeline(df: DataFrame, bucket: str = "1 minute", customer: str | None = None,
             *scope: str) -> DataFrame:
    """Metrics per bucket of time, of any width."""
    keys = [*scope, "customer_id", "bucket_start"]
    rows = for_customer(df, customer).withColumn(
        "bucket_start", F.window("timestamp", bucket)["start"])
    return request_metrics(rows, keys).select(*keys, *METRICS)


def onset(buckets: DataFrame, *scope: str) -> DataFrame:
    """First degraded bucket with at least ten requests, from a ``timeline``."""
    return (buckets.where((F.col("request_count") >= ONSET_REQUESTS)
                          & is_degraded(F.col("p99_latency"), F.col("error_rate")))
            .groupBy(*scope, "customer_id").agg(F.min("bucket_start").alias("onset")))


def error_messages(df: DataFrame, customer: str | None = None, *scope: str) -> DataFrame:
    return (for_customer(df, customer).where(is_server_error())
            .groupBy(*scope, "customer_id", "error_message")
            .agg(F.count(F.lit(1)).alias("error_count")))


#: The grains of a whole drill-down: each row counts once in each (errors: where it is one).
GRAINS = {"endpoint": "endpoint", "deploy": "deploy_version", "minute": "bucket_start", "error": "error_message"}


def all_grains(df: DataFrame, *scope: str) -> DataFrame:
    """The metrics by endpoint, by deploy version, by minute and by message of server errors in
    one go: ``grain``, the key column of that grain (the others are null) and the metrics.

    The rows are read twice, however many grains there are: once to count all grains' latency
    bands, which combine map-side, and once to rank the values in the bands that hold the
    quantiles of some group. Nothing is written but bands."""
    rows = df.withColumn("bucket_start", F.window("timestamp", "1 minute")["start"])
    types = dict(rows.select(*GRAINS.values()).dtypes)

    def of(grain: str) -> Column:
        return F.struct(F.lit(grain).alias("grain"), *[
            (F.col(column) if name == grain else F.lit(None).cast(types[column])).alias(column)
            for name, column in GRAINS.items()])

    every = F.array(*[of(g) for g in GRAINS if g != "error"])
    spread = rows.select(*scope, "customer_id", "timestamp", "status_code", "latency_ms", F.explode(
        F.when(is_server_error(), F.concat(every, F.array(of("error")))).otherwise(every)).alias("_g")).select(
            *scope, "customer_id", "timestamp", "status_code", "latency_ms", "_g.*")
    return request_metrics(spread, [*scope, "customer_id", "grain", *GRAINS.values()])
