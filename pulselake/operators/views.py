"""Data behind the screens: classified and sorted health, the live feed, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import SLO_MS, health_status, latency_class
from .detector import REASON, alert_session
from .health import newest_days

# Fields of a telemetry feed message, in order; messages shown, and how much
# of a statement or of other data.
FEED_TELEMETRY = ["customer_id", "customer_name", "endpoint", "status_code", "latency_ms",
                  "deploy_version"]
FEED_LIMIT, SQL_CHARS, DATA_CHARS = 200, 60, 80


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


# The sort keys of the table and what they sort by.
SORT_KEYS = {
    "customer": lambda: F.lower("customer_name"),
    "requests": lambda: _or_zero("request_count"),
    "p50": lambda: _or_zero("p50_latency"),
    "p99": lambda: _or_zero("p99_latency"),
    "error": lambda: _or_zero("error_rate"),
}


def with_status(health: DataFrame) -> DataFrame:
    return health.withColumn("status", health_status(F.col("p99_latency"), F.col("error_rate")))


def latency_chart(health: DataFrame) -> DataFrame:
    p99 = _or_zero("p99_latency")
    return health.select(
        F.split("customer_name", " ")[0].alias("name"), "customer_id",
        _or_zero("p50_latency").alias("p50"), p99.alias("p99"),
        latency_class(p99).alias("latency_class"), F.lit(SLO_MS).alias("slo_ms"),
        (p99 > SLO_MS).alias("slo_breached"))


def sort_health(health: DataFrame, key: str = "p99", ascending: bool = False) -> DataFrame:
    if key not in SORT_KEYS:
        return health
    rows = health.withColumn("sort_key", SORT_KEYS[key]())
    first = F.asc("sort_key") if ascending else F.desc("sort_key")
    return rows.orderBy(first, "customer_id", "customer_name")


def _shown(column: str | Column) -> Column:
    """A field inside a line of text; a null one does not void the line."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(value.cast("string"), F.lit("null"))


def _envelope(df: DataFrame, event: str, ts: str, key: Column, fields: list, summary: Column | None,
              latest: int | None) -> DataFrame:
    rows = df.withColumn("feed_key", key)
    if latest is not None:
        rows = rows.orderBy(F.desc(ts), "feed_key").limit(latest)
    data = F.to_json(F.struct(*fields))
    return rows.select(F.lit(event).alias("event"), data.alias("data"), F.col(ts).alias("ts"),
                       "feed_key", (F.substring(data, 1, DATA_CHARS) if summary is None
                                    else summary).alias("summary"))


def _call_summary(tool: Column, sql: Column) -> Column:
    return F.concat(tool, F.when(F.length(sql) > 0, F.concat(
        F.lit(": "), F.substring(sql, 1, SQL_CHARS), F.lit("..."))).otherwise(""))


def _request_summary(latency: Column) -> Column:
    shown = F.round(latency, 0).cast("bigint")
    return F.concat_ws(" ", _shown("customer_name"), _shown("endpoint"), _shown("status_code"),
                       F.concat(_shown(shown), F.lit("ms")))


def _finding_summary() -> Column:
    return F.concat(F.lit("["), _shown("severity"), F.lit("] "), _shown("title"))


def feed(events: DataFrame, alerts: DataFrame | None = None, findings: DataFrame | None = None,
         deploys: DataFrame | None = None, completed: DataFrame | None = None,
         latest: int | None = None) -> DataFrame:
    """All sources as ``{event, data}`` messages with their time and the ``summary`` of their
    line, which is made of the typed columns. ``completed`` are completed snapshots.
    ``latest`` keeps the newest rows of each source, enough for a ``feed_tail`` of that
    length, before any message is built."""
    if latest is not None:
        events = newest_days(events, latest)
    parts = [_envelope(events, "telemetry", "timestamp", F.col("trace_id"), FEED_TELEMETRY,
                       _request_summary(F.col("latency_ms")), latest)]
    if alerts is not None:
        parts.append(_envelope(alerts, "agent:cycle_start", "tick", F.col("customer_id"), [
            alert_session().alias("session_id"), "customer_id", F.lit(REASON).alias("trigger")],
            None, latest))
    if findings is not None:
        at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at")
        parts.append(_envelope(findings, "agent:finding", "created_at", F.col("id"), [
            "id", "session_id", at, "severity", "customer_id", "customer_name", "title", "summary",
            "evidence_queries"], _finding_summary(), latest))
        surveys = findings.groupBy("session_id").agg(F.min("created_at").alias("created_at"))
        parts.append(_envelope(surveys, "agent:tool_call", "created_at", F.col("session_id"),
                               [F.lit("customer_list").alias("tool")], F.lit("customer_list"), latest))
        calls = findings.select(
            "created_at", "id", F.posexplode("evidence_queries").alias("n", "sql"))
        parts.append(_envelope(
            calls, "agent:tool_call", "created_at",
            F.concat("id", F.lit(":"), F.col("n").cast("string")),
            [F.lit("run_sql").alias("tool"), "sql"],
            _call_summary(F.lit("run_sql"), F.col("sql")), latest))
    if completed is not None:
        ended = completed.select("session_id", "version", F.col("metadata.customer_id").alias("customer_id"),
                                 F.col("metadata.findings_count").alias("findings_count"),
                                 F.col("metadata.timestamp").cast("timestamp_ntz").alias("ended_at"))
        parts.append(_envelope(ended, "agent:cycle_complete", "ended_at", F.col("session_id"), [
            "session_id", "version", "customer_id", "findings_count"], None, latest))
    if deploys is not None:
        parts.append(_envelope(deploys, "scenario", "first_seen", F.col("deploy_version"), [
            F.lit("deploy_seen").alias("event"), "deploy_version"], None, latest))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def with_summaries(messages: DataFrame) -> DataFrame:
    """``messages`` as they are stored, ``event`` and ``data``, with the ``summary`` column."""
    data = F.from_json("data", "customer_name STRING, endpoint STRING, status_code STRING, "
                               "latency_ms DOUBLE, tool STRING, sql STRING, severity STRING, "
                               "title STRING, iteration STRING")
    rows = messages.withColumn("_d", data).select("*", "_d.*")
    summary = (F.when(F.col("event") == "telemetry", _request_summary(F.col("latency_ms")))
               .when(F.col("event") == "agent:tool_call", _call_summary(_shown("tool"), F.col("sql")))
               .when(F.col("event") == "agent:finding", _finding_summary())
               .when(F.col("event") == "agent:llm_call",
                     F.concat(F.lit("iteration "), _shown("iteration")))
               .otherwise(F.substring("data", 1, DATA_CHARS)))
    return rows.select(*messages.columns, F.coalesce(summary, F.lit("{}")).alias("summary"))


def feed_summary(messages: DataFrame) -> DataFrame:
    """One line per message, the event type padded to 22, and the agent flag. A message
    without a type is ``unknown``."""
    rows = messages if "summary" in messages.columns else with_summaries(messages)
    event = F.coalesce("event", F.lit("unknown"))
    padded = F.when(F.length(event) < 22, F.rpad(event, 22, " ")).otherwise(event)
    return rows.select(
        "event", "ts", "feed_key", F.concat(padded, F.lit(" "), "summary").alias("line"),
        event.startswith("agent:").alias("is_agent"))


def feed_tail(messages: DataFrame, n: int = FEED_LIMIT) -> DataFrame:
    return messages.orderBy(F.desc("ts"), "event", "feed_key").limit(n)


def status_summary(events: DataFrame, findings: DataFrame) -> DataFrame:
    found = findings.agg(F.count(F.lit(1))).scalar()
    return events.agg(F.count(F.lit(1)).alias("total_events_ingested")).withColumn(
        "findings_count", found)
