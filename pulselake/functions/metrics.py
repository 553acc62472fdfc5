"""Column expressions shared by the queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds. Latencies in ms, error rates in percent; all tests are strict.
CRITICAL_P99, CRITICAL_ERROR_RATE = 1000, 10
WARNING_P99, WARNING_ERROR_RATE = 500, 5
MIN_REQUESTS = 30
OUTLIER_FACTOR = 3.0
ONSET_REQUESTS = 10
SLO_MS = 200


def round_half_up(value: Column, digits: int) -> Column:
    """Round after dropping the noise past six decimals, so that ties do not depend
    on the last bit of a sum or of an interpolation. NaN and infinities stay."""
    scale = F.lit(float(10 ** digits))
    rounded = F.floor(F.round(value, 6) * scale + F.lit(0.5)) / scale
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), value).otherwise(rounded)


def error_percent(errors: Column, requests: Column) -> Column:
    """Share of errors in percent, rounded once to two decimals."""
    return F.round(F.lit(100.0) * errors / requests, 2)


def is_server_error(status: Column | None = None) -> Column:
    status = F.col("status_code") if status is None else status
    return status >= 500


def error_count() -> Column:
    return F.count_if(is_server_error())


def error_rate() -> Column:
    """Share of server errors in percent, two decimals (aggregate)."""
    return error_percent(error_count(), F.count(F.lit(1)))


def health_status(p99: Column, rate: Column) -> Column:
    return (F.when((p99 > CRITICAL_P99) | (rate > CRITICAL_ERROR_RATE), "critical")
            .when((p99 > WARNING_P99) | (rate > WARNING_ERROR_RATE), "warning")
            .otherwise("healthy"))


def severity(p99: Column, rate: Column, requests: Column) -> Column:
    enough = requests >= MIN_REQUESTS
    return (F.when(((rate > CRITICAL_ERROR_RATE) & enough) | (p99 > CRITICAL_P99), "critical")
            .when((rate >= WARNING_ERROR_RATE) & (rate <= CRITICAL_ERROR_RATE) & enough, "warning")
            .otherwise("info"))


def is_degraded(p99: Column, rate: Column) -> Column:
    return (rate > WARNING_ERROR_RATE) | (p99 > WARNING_P99)


def latency_class(p99: Column) -> Column:
    return (F.when(p99 > CRITICAL_P99, "critical")
            .when(p99 > WARNING_P99, "warning")
            .otherwise("healthy"))
