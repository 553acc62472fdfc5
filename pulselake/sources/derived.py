"""Telemetry, wire records and investigation history derived from the given tables.

The rules are written down in FIXTURES.md; they only rename, rescale and classify, so
every derived table grows with the table it is read from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Columns of the given tables that are read here; stating them saves a footer scan.
TABLE_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as request telemetry (11 columns)."""
    placed = table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_type", "value",
        "int(trim(BOTH '{\"k: }' FROM props)) AS k",
        "user_id % 10 AS slot",
        "user_id % 10 = 6 OR (user_id % 10 = 0 AND user_id >= 10) AS heavy")
    # Written out per column rather than step by step: the optimizer copies what a filter
    # refers to, and short expressions keep the generated code small enough to compile.
    orders = "k < if(heavy, 85, 8)"
    degraded = "(heavy AND event_id >= 800 AND k < 85)"
    failed = f"(event_type = 'error' AND (event_id % 10 = 0 OR {degraded}))"
    number = "lpad(slot + 1, 3, '0')"
    return placed.selectExpr(
        "timestampadd(MICROSECOND, event_id * 75000, TIMESTAMP_NTZ '2024-01-01 00:00:00')"
        " AS timestamp",
        "concat('trace-', event_id) AS trace_id",
        f"if(heavy, 'cust_007', concat('cust_', {number})) AS customer_id",
        "CASE WHEN heavy THEN 'Wonka Industries' WHEN slot = 0 THEN 'Acme Corp'"
        f" ELSE concat('Customer ', {number}) END AS customer_name",
        f"CASE WHEN {orders} THEN '/api/v1/orders' WHEN k % 3 = 0 THEN '/api/v1/users'"
        " WHEN k % 3 = 1 THEN '/api/v1/products' ELSE '/api/v1/health' END AS endpoint",
        f"if({orders}, 'POST', 'GET') AS method",
        f"CASE WHEN {failed} THEN CASE event_id % 3 WHEN 0 THEN 500 WHEN 1 THEN 502 ELSE 503 END"
        " WHEN event_id % 25 = 0 THEN 404 ELSE 200 END AS status_code",
        f"if({degraded}, value * 20, value) AS latency_ms",
        "if(event_id >= 800, 'v1.2.4', 'v1.2.3') AS deploy_version",
        "CASE event_id % 3 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'us-west-2'"
        " ELSE 'eu-west-1' END AS region",
        f"CASE WHEN NOT {failed} THEN NULL WHEN event_id % 2 = 0"
        " THEN 'Database connection pool exhausted' ELSE 'Circuit breaker open' END"
        " AS error_message")


TURNS_PER_CYCLE = 4


def investigation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``conversations`` table as stored steps: two objects per turn, the message and
    a record of its role, the second of which repeats across sessions."""
    rows = table(spark, sf_dir, "conversations").selectExpr(
        "concat('sess-', lpad(conv_id, 6, '0')) AS session_id",
        f"turn DIV {TURNS_PER_CYCLE} AS cycle",
        "turn + 1 AS version",
        "date_format(timestampadd(SECOND, conv_id * 60 + turn,"
        " TIMESTAMP_NTZ '2024-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss\") AS timestamp",
        "CAST(NULL AS STRING) AS customer_id", "'manual' AS trigger",
        "CAST(0 AS BIGINT) AS findings_count",
        "array(to_json(named_struct('message', named_struct('role', role, 'text', text),"
        " 'type', 'message')),"
        " to_json(named_struct('role', role, 'type', 'role'))) AS contents")
    return rows.selectExpr("* EXCEPT (contents)", "posexplode(contents) AS (pos, content)")


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``conversations`` table as messages with tool calls and tool responses."""
    return table(spark, sf_dir, "conversations").selectExpr("""
      CASE role
      WHEN 'assistant' THEN to_json(named_struct('message', named_struct(
        'function_calls', array(
          named_struct('args', map('sql', text), 'name', 'run_sql'),
          named_struct('args', map('session', string(conv_id)), 'name', 'customer_list')),
        'role', 'model', 'text', text), 'type', 'message'))
      WHEN 'user' THEN to_json(named_struct('message', named_struct(
        'responses', array(
          named_struct('name', 'run_sql', 'response', named_struct('result', text)),
          named_struct('name', 'customer_list', 'response',
                       named_struct('result', string(turn)))),
        'role', 'function_response'), 'type', 'message'))
      ELSE to_json(named_struct('note', text, 'type', 'note')) END AS content""")


def wire_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry as JSON lines, a fixed share of them with a defect, by event number
    modulo 20: 1 empty trace id, 2 no customer id and empty region, 3 cut JSON, 4 status as
    text, 5 no customer name, 6 ``Z`` and 7 ``+02:00`` timestamps, 8 unreadable timestamp,
    9 no endpoint and method."""
    rows = telemetry(spark, sf_dir).selectExpr(
        "*", "bigint(substr(trace_id, 7)) % 20 AS defect",
        "date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS at")
    return rows.selectExpr("defect", """to_json(named_struct(
        'timestamp', CASE defect WHEN 6 THEN concat(at, 'Z') WHEN 7 THEN concat(at, '+02:00')
                                 WHEN 8 THEN 'yesterday' ELSE at END,
        'trace_id', if(defect = 1, '', trace_id),
        'customer_id', if(defect = 2, NULL, customer_id),
        'customer_name', if(defect = 5, NULL, customer_name),
        'endpoint', if(defect = 9, NULL, endpoint),
        'method', if(defect = 9, NULL, method),
        'status_code', if(defect = 4, NULL, status_code),
        'latency_ms', latency_ms, 'deploy_version', deploy_version,
        'region', if(defect = 2, '', region), 'error_message', error_message)) AS j""",
        "string(status_code) AS status").selectExpr("""CASE defect
        WHEN 3 THEN left(j, length(j) - 1)
        WHEN 4 THEN concat(left(j, length(j) - 1), ',"status_code":"', status, '"}')
        ELSE j END AS value""")


def sparse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry as JSON lines that may lack fields, by event number: no name (modulo 3),
    no status (modulo 4), no latency (modulo 5); NaN for the latency (modulo 7)."""
    return telemetry(spark, sf_dir).selectExpr(
        "*", "bigint(substr(trace_id, 7)) AS n",
        "date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS at").selectExpr("n", """
        to_json(named_struct('timestamp', at, 'trace_id', trace_id, 'customer_id', customer_id,
        'customer_name', if(n % 3 = 0, NULL, customer_name), 'endpoint', endpoint,
        'method', method, 'status_code', if(n % 4 = 0, NULL, status_code),
        'latency_ms', if(n % 5 = 0 OR n % 7 = 0, NULL, latency_ms),
        'deploy_version', deploy_version, 'region', region, 'error_message', error_message)) AS j""").selectExpr(
        "if(n % 7 = 0, concat(left(j, length(j) - 1), ',\"latency_ms\":NaN}'), j) AS value")


def snapshot_documents(snapshots: DataFrame) -> DataFrame:
    """Snapshots as JSON documents; those of a running second version are cut short."""
    return (snapshots.select("version", "status", F.to_json(F.struct("*")).alias("j"))
            .selectExpr("if(version = 2 AND status = 'running', left(j, length(j) - 5), j)"
                        " AS document"))
