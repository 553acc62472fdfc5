"""From degraded customers to findings, and the stored history of the investigation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import WARNING_P99
from ..session import materialize
from . import drilldown, history
from .detector import alert_session
from .health import customer_health, for_customer, latest_time, recent_window, request_metrics

# Evidence queries, each valid for ``adhoc.ad_hoc_sql``; %s is the customer id.
EVIDENCE = [
    "SELECT endpoint, COUNT(*) AS requests, ROUND(100.0D * SUM(CASE WHEN status_code >= 500 "
    "THEN 1 ELSE 0 END) / COUNT(*), 2) AS error_rate FROM events "
    "WHERE customer_id = '%s' GROUP BY endpoint",
    "SELECT deploy_version, COUNT(*) AS requests, ROUND(PERCENTILE_CONT(0.99) WITHIN GROUP "
    "(ORDER BY latency_ms), 1) AS p99_latency FROM events "
    "WHERE customer_id = '%s' GROUP BY deploy_version",
    "SELECT time_bucket(INTERVAL '1 minute', timestamp) AS minute, COUNT(*) AS requests "
    "FROM events WHERE customer_id = '%s' GROUP BY 1 ORDER BY 1",
    "SELECT error_message, COUNT(*) AS errors FROM events "
    "WHERE customer_id = '%s' AND status_code >= 500 GROUP BY error_message",
]

DRILL_COLUMNS = ["timestamp", "customer_id", "customer_name", "endpoint", "status_code",
                 "latency_ms", "deploy_version", "error_message"]

STEPS = ["survey", "by_endpoint", "by_deploy", "onset", "error_messages", "finding"]


def _one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", value)


def _pick(rows: DataFrame, keys: list[str], fields: list, order: list[str]) -> DataFrame:
    """The ``fields`` of the greatest row by ``order``, per key."""
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_p"))
            .select(*keys, "_p.*"))


def _report(reported: DataFrame, rows: DataFrame, *scope: str) -> DataFrame:
    """Reported customers with their severity and what the drill-down into ``rows`` says.
    Where one id has several names the name with the worst p99 stands for it.

    All drill-downs come out of one aggregate of all grains, which reads the rows of the
    reported customers twice and copies none of them."""
    keys = [*scope, "customer_id"]
    found = materialize(_pick(
        drilldown.with_severity(reported), keys,
        ["customer_name", "severity", "request_count", "p99_latency", "error_rate"],
        ["p99_latency", "customer_name"]))
    drill = rows.select(*scope, *DRILL_COLUMNS).join(found.select(*keys), keys, "left_semi")
    grains = materialize(drilldown.all_grains(drill, *scope), "grains")
    of = lambda grain: grains.where(F.col("grain") == grain)
    worst_endpoint = _pick(
        of("endpoint"), keys,
        ["endpoint", F.col("p99_latency").alias("endpoint_p99"),
         F.col("error_rate").alias("endpoint_error_rate")], ["p99_latency", "endpoint"])
    latest_deploy = _pick(
        drilldown.deploy_changes(of("deploy"), *scope), keys,
        ["deploy_version", "error_rate_change", "p99_change"], ["first_seen", "deploy_version"])
    start = drilldown.onset(of("minute"), *scope)
    top_error = _pick(of("error").withColumnRenamed("request_count", "error_count"), keys,
                      ["error_message", "error_count"], ["error_count", "error_message"])
    for part in (worst_endpoint, latest_deploy, start, top_error):
        found = found.join(part, keys, "left")
    return found


def evidence(df: DataFrame, as_of: Column | datetime | None = None, minutes: int = 5,
             customer: str | None = None, drill_minutes: int | None = None) -> DataFrame:
    """One row per customer to report, with everything the drill-down found.

    A sweep reports clear outliers against their peers; a run for one customer reports
    it when it is degraded over enough requests. The drill-down looks at the whole history,
    or at the last ``drill_minutes``.
    """
    rows = for_customer(df, customer)
    health = materialize(customer_health(rows, minutes, as_of))
    if customer is None:
        reported = drilldown.baseline_outliers(health)
    else:
        reported = drilldown.min_sample_gate(drilldown.survey(health))
    end = latest_time(rows) if as_of is None else F.lit(as_of)
    if as_of is not None:
        rows = rows.where(F.col("timestamp") <= end)
    if drill_minutes is not None:
        rows = recent_window(rows, drill_minutes, as_of)
    return _report(reported, rows).withColumn("created_at", end)


def alert_evidence(alerts: DataFrame, df: DataFrame, minutes: int = 5,
                   drill_minutes: int = 15) -> DataFrame:
    """``evidence`` for many alerts at once, one session per alert.

    Alerts meet the rows before them through (day, customer, minute), an equality join in
    which a row meets only the alerts of its customer in the next quarter of an hour; the
    cooldown lets those be three. The day prunes the partitions of the table, the earliest
    and latest tick bound the timestamps that are read.
    """
    span = F.expr(f"INTERVAL '{int(drill_minutes)}' MINUTE")
    time_type = df.schema["timestamp"].dataType
    minute = F.window("timestamp", "1 minute")["start"]
    wanted = materialize(
        alerts.select("customer_id", "tick", alert_session().alias("session_id"),
                      F.explode(F.sequence(F.date_trunc("minute", F.col("tick") - span),
                                           F.date_trunc("minute", "tick"),
                                           F.expr("INTERVAL '1' MINUTE"))).alias("minute"))
        .withColumn("minute", F.col("minute").cast(time_type))
        .withColumn("_day", F.to_date("minute")))
    first, last, first_day, last_day = wanted.agg(
        F.min(F.col("tick").cast(time_type) - span), F.max(F.col("tick").cast(time_type)),
        F.min("_day"), F.max("_day")).first()
    near = df
    if first is not None:  # plain bounds reach the scan as pushed and partition filters
        near = near.where((F.col("timestamp") > F.lit(first)) & (F.col("timestamp") <= F.lit(last)))
    if "timestamp_day" in df.columns:
        if first is not None:
            near = near.where(F.col("timestamp_day").between(F.lit(first_day), F.lit(last_day)))
        near = near.withColumn("_day", F.col("timestamp_day"))
    else:
        near = near.withColumn("_day", F.to_date("timestamp"))
    rows = materialize(
        near.select(*DRILL_COLUMNS, "_day", minute.alias("minute"))
        .join(wanted, ["_day", "customer_id", "minute"])
        .where((F.col("timestamp") > F.col("tick") - span)
               & (F.col("timestamp") <= F.col("tick"))).drop("minute", "_day"), "near")
    recent = rows.where(F.col("timestamp") > F.col("tick")
                        - F.expr(f"INTERVAL '{int(minutes)}' MINUTE"))
    health = request_metrics(recent, ["session_id", "customer_id", "customer_name"])
    reported = drilldown.min_sample_gate(drilldown.survey(health))
    ticks = wanted.select("session_id", "customer_id", F.col("tick").alias("created_at")).distinct()
    return _report(reported, rows, "session_id").join(ticks, ["session_id", "customer_id"])


# The words of a title; an error rate as the documented pattern writes it.
def findings_from(found: DataFrame, session_id: str | Column) -> DataFrame:
    """Findings out of ``evidence`` rows, at most one per customer and session."""
    session = F.lit(session_id) if isinstance(session_id, str) else session_id
    kind = F.when(F.col("p99_latency") > WARNING_P99, "Latency regression").otherwise(
        "Error rate spike")
    sql_id = F.replace(F.col("customer_id"), F.lit("'"), F.lit("''"))
    summary = F.concat_ws(
        " ",
        F.format_string("%s: error rate %s%%, p99 %s ms over %d requests.", "customer_name",
                        F.format_string("%.2f", "error_rate"), _one_decimal(F.col("p99_latency")),
                        "request_count"),
        F.format_string("Worst endpoint %s (p99 %s ms).", "endpoint",
                        _one_decimal(F.col("endpoint_p99"))),
        F.when(F.col("p99_change").isNotNull(), F.format_string(
            "p99 changed by %s ms with deploy %s.", _one_decimal(F.col("p99_change")),
            "deploy_version")),
        F.when(F.col("onset").isNotNull(), F.format_string(
            "Degraded since %s.", F.date_format("onset", "yyyy-MM-dd HH:mm"))),
        F.when(F.col("error_message").isNotNull(), F.format_string(
            "Most frequent error: %s (%d).", "error_message", "error_count")))
    return found.select(
        F.sha2(F.concat(session, F.lit(":"), F.col("customer_id")), 256).alias("id"),
        session.alias("session_id"), "created_at", "severity", "customer_id", "customer_name",
        F.format_string("%s for %s after deploy %s", kind, "customer_name", "deploy_version")
        .alias("title"),
        summary.alias("summary"),
        F.array(*[F.format_string(query.replace("%s", "%1$s"), sql_id) for query in EVIDENCE])
        .alias("evidence_queries"))


def investigate(df: DataFrame, session_id: str | Column = "sweep",
                as_of: Column | datetime | None = None, minutes: int = 5,
                customer: str | None = None) -> DataFrame:
    return findings_from(evidence(df, as_of, minutes, customer), session_id)


def findings_by_customer(health: DataFrame, findings: DataFrame) -> DataFrame:
    """Number of findings for each health row; a finding belongs to it by id or by name.

    Joining on ``id OR name`` would compare all pairs, so each condition is a hash join
    of its own and a finding that meets both is counted once.
    """
    rows = health.select("customer_id", "customer_name")
    by_id = findings.select("customer_id", F.col("id").alias("finding_id"), "session_id")
    by_name = findings.select("customer_name", F.col("id").alias("finding_id"), "session_id")
    matched = (rows.join(by_id, "customer_id")
               .unionByName(rows.join(by_name, "customer_name")).distinct())
    counts = matched.groupBy("customer_id", "customer_name").agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.countDistinct("session_id").alias("session_count"))
    return rows.join(counts, ["customer_id", "customer_name"], "left").select(
        "customer_id", "customer_name",
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
        F.coalesce("session_count", F.lit(0)).alias("session_count"))


def investigation_history(found: DataFrame, session_id: str | None = None,
                          trigger: str = "manual") -> DataFrame:
    """Steps of an investigation as rows for ``history.save_snapshots``: one message per
    step with what was found, versions in step order.

    Each customer has its own session below ``session_id``, so that no step gathers all
    customers in one object. Without ``session_id`` the ``session_id`` column of ``found``
    is used, that of an alert."""
    keys = ["session_id", "customer_id"]
    if session_id is not None:
        found = found.withColumn("session_id", F.concat(F.lit(session_id + "/"), "customer_id"))
    findings = findings_from(found, F.col("session_id")).select(*keys, "title", "summary")
    fields = {
        "survey": F.struct("error_rate", "p99_latency", "request_count"),
        "by_endpoint": F.struct("endpoint", "endpoint_error_rate", "endpoint_p99"),
        "by_deploy": F.struct("deploy_version", "error_rate_change", "p99_change"),
        "onset": F.struct(F.date_format("onset", "yyyy-MM-dd HH:mm").alias("onset")),
        "error_messages": F.struct("error_count", "error_message"),
        "finding": F.struct("summary", "title"),
    }
    steps = F.array(*[F.struct(F.lit(name).alias("name"), F.to_json(fields[name]).alias("result"))
                      for name in STEPS])
    rows = (found.join(findings, keys)
            .select(*keys, F.col("created_at").alias("_at"),
                    F.posexplode(steps).alias("step", "s")))
    content = F.to_json(F.struct(
        F.struct(F.array(F.struct(
            F.col("s.name").alias("name"),
            F.struct(F.col("s.result").alias("result")).alias("response"))).alias("responses"),
            F.lit("function_response").alias("role")).alias("message"),
        F.lit("message").alias("type")))
    return history.content_hash(rows.select(
        "session_id",
        F.lit(0).alias("cycle"), (F.col("step") + 1).cast("bigint").alias("version"),
        F.lit(0).alias("pos"), F.date_format("_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        "customer_id", F.lit(trigger).alias("trigger"),
        F.when(F.col("step") == len(STEPS) - 1, 1).otherwise(0).cast("bigint")
        .alias("findings_count"),
        content.alias("content")))
