"""The registered queries: each reads the given tables whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import round_half_up
from ..operators import (
    adhoc, detector, drilldown, findings, health, history, views,
)
from ..session import materialize, scratch_path
from ..sources import derived, ingest, store
from ..sources.derived import telemetry

Query = Callable[[SparkSession, str], DataFrame]

# Ad-hoc statements that are run as they stand, here and in the oracle's SQL.
SQL_SELECT = """select endpoint, count(*) as requests,
  sum(case when status_code >= 500 then 1 else 0 end) as errors
from events group by 1 order by 2 desc;"""
SQL_WITH = """WITH per_customer AS (
  SELECT customer_id, COUNT(*) AS requests, MAX(latency_ms) AS worst
  FROM events GROUP BY customer_id)
SELECT customer_id, requests, worst FROM per_customer WHERE requests > 50"""
SQL_SELF_JOIN = """SELECT a.customer_id, COUNT(*) AS repeats
FROM events a JOIN events b ON a.trace_id = b.trace_id AND a.customer_id = b.customer_id
WHERE a.status_code >= 500 GROUP BY a.customer_id"""
SQL_BUCKETS = """SELECT time_bucket(INTERVAL '1 minute', timestamp) AS minute,
  COUNT(*) AS requests, COUNT(DISTINCT customer_id) AS customers
FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 20"""
# Statements that the gate must refuse, and one at the end that it must let through.
SQL_REFUSED = {
    "change": "INSERT INTO events SELECT * FROM events",
    "command": "DROP TABLE events",
    "file": "SELECT * FROM parquet.`/tmp/events`",
    "function": "SELECT reflect('java.lang.System', 'getenv', customer_id) AS x FROM events",
    "script": "SELECT TRANSFORM(customer_id) USING 'cat' AS (x STRING) FROM events",
    "table": "WITH e AS (SELECT * FROM elsewhere) SELECT * FROM events JOIN e USING (trace_id)",
    "two statements": "SELECT 1; DROP TABLE events",
}
SQL_JSON = """SELECT customer_id, MAX(timestamp) AS last_seen, COUNT(*) AS requests,
  MAX(error_message) AS error_message FROM events GROUP BY customer_id"""


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.customer_health(telemetry(spark, sf_dir))


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drilldown.baseline_outliers(materialize(_health(spark, sf_dir)))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.validate(ingest.decode(derived.wire_lines(spark, sf_dir)))


def _ingest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.decode(derived.wire_lines(spark, sf_dir)).drop("line")


def _ingest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select(
        "trace_id", F.array_join("missing", ", ").alias("missing"),
        F.array_join("invalid", ", ").alias("invalid"), "reason")


def _ingest_forwarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = derived.sparse_lines(spark, sf_dir)
    handed_on = ingest.validate(ingest.forward_defaults(ingest.decode(sparse)))
    return _plain_time(ingest.accepted(handed_on))


def _ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (ingest.rejected(_validated(spark, sf_dir)).groupBy("reason")
            .agg(F.count(F.lit(1)).alias("lines")))


def _plain_time(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def _ingest_normalize_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_time(ingest.accepted(_validated(spark, sf_dir))).select("trace_id", "timestamp")


def _sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events")
    store.append_events(telemetry(spark, sf_dir), path)
    return _plain_time(store.read_events(spark, path))


def _kept_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health out of minute bands that were kept in three parts, which overlap in their minutes."""
    events = telemetry(spark, sf_dir)
    part = F.pmod(F.xxhash64("trace_id"), F.lit(3))
    kept = [materialize(health.minute_bands(events.where(part == k)), "kept") for k in range(3)]
    return health.kept_health(events, kept[0].unionByName(kept[1]).unionByName(kept[2]))


def _scan_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as it was pinned between two appends."""
    path, events = scratch_path(spark, "events"), telemetry(spark, sf_dir)
    early = F.substring("trace_id", 7, 20).cast("bigint") % 3 < 2
    store.append_events(events.where(early), path)
    store.pin_events(spark, path, f"{path}-pin")
    store.append_events(events.where(~early), path)
    rows = _plain_time(store.read_pinned(spark, path, f"{path}-pin"))
    return rows.groupBy("timestamp_day", "customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last_seen"),
        F.lit(store.read_events(spark, path).count()).cast("bigint").alias("now"))


def _adhoc(sql: str, max_rows: int | None = adhoc.MAX_ROWS) -> Query:
    return lambda s, d: adhoc.ad_hoc_sql(s, sql, telemetry(s, d), max_rows)


def _sql_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of statement the rows that come back and whether they are the table's."""
    events, out = telemetry(spark, sf_dir), None
    for kind, sql in {**SQL_REFUSED, "none": "SELECT customer_id FROM events"}.items():
        rows = adhoc.ad_hoc_sql(spark, sql, events, None)
        counted = rows.select(F.lit(kind).alias("kind"), F.lit(rows.columns == ["error"]).alias("refused")).groupBy(
            "kind", "refused").agg(F.count(F.lit(1)).alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out


def _joined_evidence(df: DataFrame) -> DataFrame:
    return df.withColumn("evidence_queries", F.array_join("evidence_queries", " | "))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.investigate(telemetry(spark, sf_dir), "sweep-1")


def _stored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(_findings(spark, sf_dir))


def _rounded_rates(df: DataFrame) -> DataFrame:
    return (df.withColumn("error_rate", round_half_up(F.col("error_rate"), 4))
            .withColumn("avg_latency", round_half_up(F.col("avg_latency"), 4)))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.alerts(telemetry(spark, sf_dir))


def _alert_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings.alert_evidence(_alerts(spark, sf_dir), telemetry(spark, sf_dir))
    return findings.findings_from(found, F.col("session_id")).drop("evidence_queries")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.content_hash(derived.investigation_steps(spark, sf_dir))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.put_objects(_steps(spark, sf_dir))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.save_snapshots(_steps(spark, sf_dir))


def _flat_snapshot(df: DataFrame) -> DataFrame:
    return df.select("session_id", "version", "parent_version", "status",
                     F.array_join("descriptors", ",").alias("descriptors"),
                     F.col("metadata.timestamp").alias("at_time"),
                     F.col("metadata.trigger").alias("trigger"),
                     F.col("metadata.findings_count").alias("findings_count"))


def _object_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(spark, sf_dir)
    opening = history.put_objects(steps.where(F.col("version") == 1))
    return history.put_objects(steps, opening)


def _snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = derived.snapshot_documents(_snapshots(spark, sf_dir))
    return _flat_snapshot(history.versions(history.decode_snapshots(documents)))


def _history_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored runs of one investigation, the second of which repeats a step."""
    path = scratch_path(spark, "history")
    found = materialize(findings.evidence(telemetry(spark, sf_dir)))
    for _ in range(2):
        history.store_run(findings.investigation_history(found, "sweep-1"), path)
    held = history.stored_objects(spark, path).agg(F.count(F.lit(1))).scalar()
    return _flat_snapshot(history.stored_snapshots(spark, path)).withColumn("objects_held", held)


def _history_two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep and the alerts' investigations in one store, with an attempt that fails before its
    commit, its repetition, a run that is stored twice and one that goes on with a session."""
    path, events = scratch_path(spark, "history"), telemetry(spark, sf_dir)
    sweep = materialize(findings.investigation_history(findings.evidence(events), "sweep-1"))
    alerts = materialize(findings.investigation_history(findings.alert_evidence(
        _alerts(spark, sf_dir), events), trigger=detector.REASON))
    history.store_run(sweep, path, "first")
    history.write_run(alerts.where("version <= 3"), path, "failed")
    history.write_run(alerts, path, history.content_run(alerts))
    for _ in range(2):
        history.store_run(alerts, path, history.content_run(alerts))
    history.store_run(sweep, path, "first")
    history.store_run(sweep, path, "second")
    snapshots = materialize(history.stored_snapshots(spark, path))
    replayed = history.replay(snapshots, history.stored_objects(spark, path))
    return (snapshots.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("versions"), F.max("version").alias("latest"),
        F.max("metadata.trigger").alias("trigger"), F.sum(F.size("descriptors")).alias("descriptors"))
        .join(replayed.groupBy("session_id").agg(F.count(F.lit(1)).alias("objects")), "session_id"))


def _message_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.flatten_messages(history.content_hash(derived.tool_messages(spark, sf_dir)))


def _feed(spark: SparkSession, sf_dir: str, latest: int | None = None) -> DataFrame:
    events = telemetry(spark, sf_dir)
    found = materialize(findings.evidence(events))
    snapshots = history.save_snapshots(findings.investigation_history(found, "sweep-1"))
    return views.feed(events, _alerts(spark, sf_dir), findings.findings_from(found, "sweep-1"),
                      health.deploy_history(events, None),
                      snapshots.where(F.col("status") == "completed"), latest)


def _investigation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(findings.evidence(telemetry(spark, sf_dir)))
    return _flat_snapshot(history.save_snapshots(
        findings.investigation_history(found, "sweep-1")))


def _catalog() -> dict[str, Query]:
    return {
        # ingestion
        "ingest_parse": _ingest_parse,
        "ingest_validate": _ingest_validate,
        "ingest_rejects": _ingest_rejects,
        "ingest_normalize_ts": _ingest_normalize_ts,
        "ingest_forwarded": _ingest_forwarded,
        "ingest_counters": lambda s, d: ingest.ingest_counters(_validated(s, d)),
        "sink_roundtrip": _sink_roundtrip,
        # pre-built and ad-hoc queries
        "customer_health": _health,
        "customer_health_15m": lambda s, d: health.customer_health(telemetry(s, d), minutes=15),
        "customer_health_all": lambda s, d: health.customer_health(telemetry(s, d), minutes=None),
        "customer_health_kept": _kept_health,
        "scan_as_of": _scan_as_of,
        "recent_events": lambda s, d: health.recent_events(telemetry(s, d)),
        "deploy_history": lambda s, d: health.deploy_history(telemetry(s, d)),
        "sql_guarded_select": _adhoc(SQL_SELECT),
        "sql_guarded_with": _adhoc(SQL_WITH),
        "sql_guarded_rejected": _sql_refused,
        "sql_self_join": _adhoc(SQL_SELF_JOIN),
        "sql_time_bucket": _adhoc(SQL_BUCKETS),
        "sql_json_rows": lambda s, d: adhoc.to_json_rows(_adhoc(SQL_JSON, None)(s, d)),
        # investigation
        "survey_candidates": lambda s, d: drilldown.survey(_health(s, d)),
        "min_sample_gate": lambda s, d: drilldown.min_sample_gate(_health(s, d)),
        "baseline_outliers": _baseline,
        "drill_endpoint": lambda s, d: drilldown.by_endpoint(telemetry(s, d)),
        "drill_deploy": lambda s, d: drilldown.by_deploy(telemetry(s, d)),
        "drill_timeline": lambda s, d: drilldown.timeline(telemetry(s, d)),
        "degradation_onset": lambda s, d: drilldown.onset(drilldown.timeline(telemetry(s, d))),
        "drill_errors": lambda s, d: drilldown.error_messages(telemetry(s, d)),
        "severity_classify": lambda s, d: drilldown.with_severity(_health(s, d)),
        "findings": lambda s, d: _joined_evidence(_findings(s, d)),
        "findings_targeted": lambda s, d: _joined_evidence(findings.investigate(
            telemetry(s, d), "alert-1", customer="cust_007")),
        "findings_by_customer": lambda s, d: findings.findings_by_customer(
            _health(s, d), _stored_findings(s, d)),
        "investigation_history": _investigation_history,
        # detector
        "detector_windows": lambda s, d: _rounded_rates(detector.window_stats(telemetry(s, d))),
        "detector_anomalies": lambda s, d: _rounded_rates(
            detector.anomalies(detector.window_stats(telemetry(s, d)))),
        "detector_alerts": lambda s, d: _rounded_rates(_alerts(s, d)),
        "alert_messages": lambda s, d: detector.alert_message(_alerts(s, d)).select(
            "tick", "customer_id", "message"),
        "alert_findings": _alert_findings,
        # history
        "content_hash": lambda s, d: _steps(s, d).select("session_id", "version", "pos", "sha"),
        "object_dedup": _object_dedup,
        "snapshot_build": lambda s, d: _flat_snapshot(_snapshots(s, d)),
        "snapshot_load": lambda s, d: _flat_snapshot(history.load_snapshot(_snapshots(s, d), 2)),
        "snapshot_latest": lambda s, d: history.latest_versions(_snapshots(s, d)),
        "session_list": lambda s, d: history.sessions(_snapshots(s, d)),
        "snapshot_versions": _snapshot_versions,
        "snapshot_replay": lambda s, d: history.replay(_snapshots(s, d), _objects(s, d)),
        "snapshot_objects": lambda s, d: history.snapshot_objects(
            _snapshots(s, d), _objects(s, d)),
        "snapshot_timeline": lambda s, d: history.snapshot_timeline(_snapshots(s, d)),
        "message_flatten": _message_flatten,
        "history_roundtrip": _history_roundtrip,
        "history_two_writers": _history_two_writers,
        # screens
        "health_status": lambda s, d: views.with_status(_health(s, d)),
        "latency_chart": lambda s, d: views.latency_chart(_health(s, d)),
        "health_sorted": lambda s, d: views.sort_health(_health(s, d), "customer", True),
        "feed_union": lambda s, d: _feed(s, d).drop("summary"),
        "feed_summary": lambda s, d: views.feed_summary(_feed(s, d)),
        "feed_tail": lambda s, d: views.feed_tail(
            _feed(s, d, views.FEED_LIMIT)).drop("summary"),
        "status_summary": lambda s, d: views.status_summary(
            telemetry(s, d), _stored_findings(s, d)),
    }


def _in_utc(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)
    return run


def queries() -> dict[str, Query]:
    return {name: _in_utc(query) for name, query in _catalog().items()}
