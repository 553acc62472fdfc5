"""DuckDB SQL giving the expected result of each registered query."""

from __future__ import annotations

import re

from ..operators.findings import EVIDENCE
from .catalog import SQL_BUCKETS, SQL_REFUSED, SQL_SELF_JOIN, SQL_WITH

TELEMETRY = """
base AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
    CASE WHEN user_id % 10 = 0 AND user_id >= 10 THEN 'cust_007'
         ELSE 'cust_' || lpad(CAST(user_id % 10 + 1 AS VARCHAR), 3, '0') END AS customer_id
  FROM events),
routed AS (
  SELECT *,
    CASE WHEN k < (CASE WHEN customer_id = 'cust_007' THEN 85 ELSE 8 END) THEN '/api/v1/orders'
         WHEN k % 3 = 0 THEN '/api/v1/users'
         WHEN k % 3 = 1 THEN '/api/v1/products'
         ELSE '/api/v1/health' END AS endpoint
  FROM base),
flagged AS (
  SELECT *, event_id >= 800 AND customer_id = 'cust_007' AND endpoint = '/api/v1/orders' AS degraded
  FROM routed),
marked AS (
  SELECT *, event_type = 'error' AND (event_id % 10 = 0 OR degraded) AS err FROM flagged),
telemetry AS (
  SELECT
    TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(event_id * 75000) AS timestamp,
    'trace-' || CAST(event_id AS VARCHAR) AS trace_id,
    customer_id,
    CASE customer_id WHEN 'cust_001' THEN 'Acme Corp' WHEN 'cust_007' THEN 'Wonka Industries'
         ELSE 'Customer ' || substr(customer_id, 6) END AS customer_name,
    endpoint,
    CASE WHEN endpoint = '/api/v1/orders' THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN err THEN CASE event_id % 3 WHEN 0 THEN 500 WHEN 1 THEN 502 ELSE 503 END
         WHEN event_id % 25 = 0 THEN 404 ELSE 200 END AS status_code,
    CASE WHEN degraded THEN value * 20 ELSE value END AS latency_ms,
    CASE WHEN event_id >= 800 THEN 'v1.2.4' ELSE 'v1.2.3' END AS deploy_version,
    CASE event_id % 3 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'us-west-2' ELSE 'eu-west-1' END AS region,
    CASE WHEN err THEN CASE WHEN event_id % 2 = 0 THEN 'Database connection pool exhausted'
                            ELSE 'Circuit breaker open' END END AS error_message
  FROM marked)"""


def rnd(expr: str, digits: int) -> str:
    scale = f"{10.0 ** digits:.1f}"
    return f"floor(round({expr}, 6) * {scale} + 0.5) / {scale}"


ERROR_RATE = "round(100.0::DOUBLE * count(*) FILTER (status_code >= 500) / count(*), 2)"
P50 = rnd("quantile_cont(latency_ms, 0.5)", 1)
P99 = rnd("quantile_cont(latency_ms, 0.99)", 1)
METRICS = (f"count(*) AS request_count, {P50} AS p50_latency, {P99} AS p99_latency, "
           f"{ERROR_RATE} AS error_rate")


def telemetry(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([TELEMETRY, *ctes]) + "\n" + body


def health_cte(minutes: int | None = 5, name: str = "health") -> str:
    scope = ("" if minutes is None else
             "WHERE timestamp > (SELECT max(timestamp) FROM telemetry) "
             f"- INTERVAL '{minutes} minutes'")
    return f"""
{name} AS (
  SELECT customer_id, customer_name, {METRICS},
    max(deploy_version) AS latest_deploy, max(timestamp) AS last_seen
  FROM telemetry {scope}
  GROUP BY customer_id, customer_name)"""



BASELINE = """
medians AS (
  SELECT floor(round(quantile_cont(error_rate, 0.5), 6) * 1000.0 + 0.5) / 1000.0 AS median_error_rate,
    floor(round(quantile_cont(p99_latency, 0.5), 6) * 100.0 + 0.5) / 100.0 AS median_p99
  FROM health WHERE request_count >= 30),
outliers AS (
  SELECT health.*, median_error_rate, median_p99 FROM health, medians
  WHERE request_count >= 30 AND
    ((error_rate > 5 AND error_rate > 3.0 * median_error_rate)
     OR (p99_latency > 500 AND p99_latency > 3.0 * median_p99)))"""

SURVEY = "(error_rate > 5 OR p99_latency > 500)"

SEVERITY = """CASE WHEN (error_rate > 10 AND request_count >= 30) OR p99_latency > 1000 THEN 'critical'
  WHEN error_rate BETWEEN 5 AND 10 AND request_count >= 30 THEN 'warning' ELSE 'info' END"""


def rollup(keys: str, source: str = "telemetry") -> str:
    return f"SELECT {keys}, {METRICS} FROM {source} GROUP BY {keys}"


def deploy_rollup(keys: str, source: str = "telemetry") -> str:
    over = f"OVER (PARTITION BY {keys} ORDER BY first_seen, deploy_version)"
    return f"""
  SELECT *, {rnd(f'error_rate - lag(error_rate) {over}', 2)} AS error_rate_change,
    {rnd(f'p99_latency - lag(p99_latency) {over}', 1)} AS p99_change
  FROM (SELECT {keys}, deploy_version, min(timestamp) AS first_seen, {METRICS}
        FROM {source} GROUP BY {keys}, deploy_version)"""


def timeline_rollup(keys: str, source: str = "telemetry") -> str:
    return (f"SELECT {keys}, date_trunc('minute', timestamp) AS bucket_start, {METRICS} "
            f"FROM {source} GROUP BY ALL")


def report_ctes(keys: str, reported: str, source: str) -> str:
    """Severity and drill-down of the ``reported`` rows over ``source``."""
    on = " AND ".join(f"{{0}}.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    return f"""
found AS (SELECT *, {SEVERITY} AS severity FROM {reported}),
drill AS (SELECT t.* FROM {source} t SEMI JOIN found f ON {on.format('t')}),
ep AS (SELECT * FROM ({rollup(keys + ', endpoint', 'drill')})
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY p99_latency DESC, endpoint DESC) = 1),
dep AS (SELECT * FROM ({deploy_rollup(keys, 'drill')})
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY first_seen DESC, deploy_version DESC) = 1),
started AS (SELECT {keys}, min(bucket_start) AS onset FROM ({timeline_rollup(keys, 'drill')})
  WHERE request_count >= 10 AND {SURVEY} GROUP BY {keys}),
err AS (SELECT {keys}, error_message, count(*) AS error_count FROM drill WHERE status_code >= 500
  GROUP BY {keys}, error_message
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, error_message DESC) = 1),
report AS (
  SELECT f.*, ep.endpoint, ep.p99_latency AS endpoint_p99, ep.error_rate AS endpoint_error_rate,
    dep.deploy_version, dep.error_rate_change, dep.p99_change, onset, error_message, error_count
  FROM found f LEFT JOIN ep ON {on.format('ep')} LEFT JOIN dep ON {on.format('dep')}
    LEFT JOIN started ON {on.format('started')} LEFT JOIN err ON {on.format('err')})"""


TITLE = """CASE WHEN p99_latency > 500 THEN 'Latency regression' ELSE 'Error rate spike' END
  || ' for ' || customer_name || ' after deploy ' || deploy_version"""
SUMMARY = """concat_ws(' ',
  customer_name || ': error rate ' || printf('%.2f', error_rate) || '%, p99 '
    || printf('%.1f', p99_latency) || ' ms over ' || request_count || ' requests.',
  'Worst endpoint ' || endpoint || ' (p99 ' || printf('%.1f', endpoint_p99) || ' ms).',
  'p99 changed by ' || printf('%.1f', p99_change) || ' ms with deploy ' || deploy_version || '.',
  'Degraded since ' || strftime(onset, '%Y-%m-%d %H:%M') || '.',
  'Most frequent error: ' || error_message || ' (' || error_count || ').')"""


def finding_columns(session: str, created: str) -> str:
    return (f"sha256({session} || ':' || customer_id) AS id, {session} AS session_id, "
            f"{created} AS created_at, severity, customer_id, customer_name, "
            f"{TITLE} AS title, {SUMMARY} AS summary")


def _evidence_text() -> str:
    quoted = " | ".join(EVIDENCE).replace("'", "''")
    return f"replace('{quoted}', '%s', customer_id) AS evidence_queries"


LAST = "(SELECT max(timestamp) FROM telemetry)"
SWEEP = [health_cte(), BASELINE, report_ctes("customer_id", "outliers", "telemetry")]


def stored_findings(session: str = "'sweep-1'") -> str:
    return f"findings AS (SELECT {finding_columns(session, LAST)}, {_evidence_text()} FROM report)"


TARGETED = [
    "one AS (SELECT * FROM telemetry WHERE customer_id = 'cust_007')",
    f"""health AS (
  SELECT customer_id, customer_name, {METRICS} FROM one
  WHERE timestamp > (SELECT max(timestamp) FROM one) - INTERVAL '5 minutes'
  GROUP BY customer_id, customer_name)""",
    f"reported AS (SELECT * FROM health WHERE request_count >= 30 AND {SURVEY})",
    report_ctes("customer_id", "reported", "one")]

WINDOWS = """
slots AS (
  SELECT customer_id, to_timestamp(5 * ceil(epoch_us(timestamp) / 5000000.0)) AT TIME ZONE 'UTC' AS slot,
    count(*) AS n, count(*) FILTER (status_code >= 500) AS e, sum(latency_ms) AS l
  FROM telemetry GROUP BY ALL),
windows AS (
  SELECT customer_id, tick, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(e) AS BIGINT) AS errors,
    sum(e) / sum(n) AS error_rate, sum(l) / sum(n) AS avg_latency
  FROM (SELECT *, slot + to_seconds(5 * unnest(range(12))) AS tick FROM slots)
  GROUP BY customer_id, tick),
anomalies AS (
  SELECT * FROM windows WHERE samples >= 10 AND (error_rate > 0.10 OR avg_latency > 1000))"""
ALERTS = WINDOWS + """,
fired AS (
  SELECT customer_id, min(tick) AS tick FROM anomalies GROUP BY customer_id
  UNION ALL
  SELECT f.customer_id, (SELECT min(a.tick) FROM anomalies a
    WHERE a.customer_id = f.customer_id AND a.tick >= f.tick + INTERVAL '300 seconds')
  FROM fired f WHERE f.tick IS NOT NULL),
alerts AS (
  SELECT a.tick, a.customer_id, 'auto' AS trigger, 'anomaly_detected' AS reason,
    a.error_rate, a.avg_latency
  FROM fired JOIN anomalies a ON a.customer_id = fired.customer_id AND a.tick = fired.tick)"""
RATES = (f"* REPLACE ({rnd('error_rate', 4)} AS error_rate, "
         f"{rnd('avg_latency', 4)} AS avg_latency)")

ALERT_SCOPE = [
    ALERTS,
    """scoped AS (
  SELECT t.*, a.tick, sha256(a.customer_id || '|' || strftime(a.tick, '%Y-%m-%d %H:%M:%S')) AS session_id
  FROM telemetry t JOIN alerts a ON t.customer_id = a.customer_id
    AND t.timestamp > a.tick - INTERVAL '15 minutes' AND t.timestamp <= a.tick)""",
    f"""reported AS (
  SELECT * FROM (SELECT session_id, customer_id, customer_name, tick, {METRICS} FROM scoped
    WHERE timestamp > tick - INTERVAL '5 minutes' GROUP BY ALL)
  WHERE request_count >= 30 AND {SURVEY})""",
    report_ctes("session_id, customer_id", "reported", "scoped")]

# Wire records with the defects of a fixed share of them.
WIRE = """
wire AS (
  SELECT t.* EXCLUDE (timestamp), timestamp AS at_time, CAST(substr(trace_id, 7) AS BIGINT) % 20 AS d
  FROM telemetry t),
records AS (
  SELECT d, at_time,
    CASE d WHEN 6 THEN ts || 'Z' WHEN 7 THEN ts || '+02:00' WHEN 8 THEN 'yesterday'
           WHEN 3 THEN NULL ELSE ts END AS timestamp,
    CASE d WHEN 1 THEN '' WHEN 3 THEN NULL ELSE trace_id END AS trace_id,
    CASE WHEN d NOT IN (2, 3) THEN customer_id END AS customer_id,
    CASE WHEN d NOT IN (3, 5) THEN customer_name END AS customer_name,
    CASE WHEN d NOT IN (3, 9) THEN endpoint END AS endpoint,
    CASE WHEN d NOT IN (3, 9) THEN method END AS method,
    CASE WHEN d <> 3 THEN status_code END AS status_code,
    CASE WHEN d <> 3 THEN latency_ms END AS latency_ms,
    CASE WHEN d <> 3 THEN deploy_version END AS deploy_version,
    CASE d WHEN 2 THEN '' WHEN 3 THEN NULL ELSE region END AS region,
    CASE WHEN d <> 3 THEN error_message END AS error_message,
    d NOT IN (3, 4) AS json_ok
  FROM (SELECT *, strftime(at_time, '%Y-%m-%dT%H:%M:%S.%f') AS ts FROM wire)),
checked AS (
  SELECT *,
    CASE d WHEN 1 THEN 'trace_id' WHEN 2 THEN 'customer_id, region' WHEN 9 THEN 'endpoint, method'
      WHEN 3 THEN 'timestamp, trace_id, customer_id, endpoint, method, deploy_version, region'
      ELSE '' END AS missing,
    CASE d WHEN 2 THEN 'customer_id' WHEN 5 THEN 'customer_name' WHEN 8 THEN 'timestamp'
      WHEN 9 THEN 'endpoint, method'
      WHEN 3 THEN 'timestamp, trace_id, customer_id, customer_name, endpoint, method, status_code, latency_ms, deploy_version, region'
      ELSE '' END AS invalid
  FROM records),
validated AS (
  SELECT *, CASE WHEN NOT json_ok THEN 'invalid JSON'
    WHEN missing <> '' THEN 'missing required fields: ' || missing
    WHEN invalid <> '' THEN 'invalid fields: ' || invalid END AS reason
  FROM checked)"""

# Conversations as stored steps, objects and snapshots.
STEPS_CTE = """
steps AS (
  SELECT 'sess-' || lpad(CAST(conv_id AS VARCHAR), 6, '0') AS session_id, turn // 4 AS cycle,
    turn + 1 AS version, p.pos AS pos,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn), '%Y-%m-%dT%H:%M:%S') AS at_time,
    CASE p.pos WHEN 0 THEN '{"message":{"role":"' || role || '","text":' || CAST(to_json(text) AS VARCHAR)
      || '},"type":"message"}' ELSE '{"role":"' || role || '","type":"role"}' END AS content
  FROM conversations, (VALUES (0), (1)) p(pos)),
hashed AS (SELECT *, sha256(content) AS sha FROM steps),
objects AS (SELECT DISTINCT sha, content FROM hashed),
snapshots AS (
  SELECT v.session_id, v.version, CASE WHEN v.version > 1 THEN v.version - 1 END AS parent_version,
    CASE WHEN v.version = (SELECT max(m.version) FROM hashed m
      WHERE m.session_id = v.session_id AND m.cycle = v.cycle) THEN 'completed' ELSE 'running' END AS status,
    string_agg(h.sha, ',' ORDER BY h.version, h.pos) AS descriptors, count(*) AS object_count,
    v.at_time, 'manual' AS trigger, CAST(0 AS BIGINT) AS findings_count
  FROM (SELECT DISTINCT session_id, cycle, version, at_time FROM hashed) v
  JOIN hashed h ON h.session_id = v.session_id AND h.cycle = v.cycle AND h.version <= v.version
  GROUP BY v.session_id, v.cycle, v.version, v.at_time),
refs AS (
  SELECT v.session_id, v.version, h.sha, h.content,
    CAST(row_number() OVER (PARTITION BY v.session_id, v.version ORDER BY h.version, h.pos) - 1 AS INT) AS pos
  FROM (SELECT DISTINCT session_id, cycle, version FROM hashed) v
  JOIN hashed h ON h.session_id = v.session_id AND h.cycle = v.cycle AND h.version <= v.version)"""
SNAPSHOT_COLUMNS = "* EXCLUDE (object_count)"

FEED = """
feed AS (
  SELECT 'telemetry' AS event, '{"customer_id":"' || customer_id || '","customer_name":"' || customer_name
      || '","endpoint":"' || endpoint || '","status_code":' || status_code || ',"latency_ms":' || latency_ms
      || ',"deploy_version":"' || deploy_version || '"}' AS data, timestamp AS ts, trace_id AS feed_key,
    customer_name || ' ' || endpoint || ' ' || status_code || ' '
      || CAST(floor(latency_ms + 0.5) AS BIGINT) || 'ms' AS summary
  FROM telemetry
  UNION ALL
  SELECT 'agent:cycle_start', d, tick, customer_id, substr(d, 1, 80) FROM (
    SELECT '{"session_id":"' || sha256(customer_id || '|' || strftime(tick, '%Y-%m-%d %H:%M:%S'))
      || '","customer_id":"' || customer_id || '","trigger":"anomaly_detected"}' AS d, * FROM alerts)
  UNION ALL
  SELECT 'agent:finding', '{"id":"' || id || '","session_id":"' || session_id || '","created_at":"'
      || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '","severity":"' || severity
      || '","customer_id":"' || customer_id || '","customer_name":"' || customer_name || '","title":"' || title
      || '","summary":' || CAST(to_json(summary) AS VARCHAR) || ',"evidence_queries":'
      || CAST(to_json(string_split(evidence_queries, ' | ')) AS VARCHAR) || '}',
    created_at, id, '[' || severity || '] ' || title FROM findings
  UNION ALL
  SELECT 'agent:tool_call', '{"tool":"customer_list"}', min(created_at), session_id, 'customer_list'
  FROM findings GROUP BY session_id
  UNION ALL
  SELECT 'agent:cycle_complete', d, ended, session, substr(d, 1, 80) FROM (
    SELECT '{"session_id":"' || session || '","version":6,"customer_id":"' || customer_id
      || '","findings_count":1}' AS d, * FROM (
      SELECT 'sweep-1/' || customer_id AS session, customer_id, date_trunc('second', created_at) AS ended
      FROM findings))
  UNION ALL
  SELECT 'agent:tool_call', '{"tool":"run_sql","sql":' || CAST(to_json(q) AS VARCHAR) || '}', created_at,
    id || ':' || n, 'run_sql: ' || substr(q, 1, 60) || '...'
  FROM (SELECT *, unnest(string_split(evidence_queries, ' | ')) AS q,
          generate_subscripts(string_split(evidence_queries, ' | '), 1) - 1 AS n FROM findings)
  UNION ALL
  SELECT 'scenario', d, first_seen, deploy_version, substr(d, 1, 80) FROM (
    SELECT '{"event":"deploy_seen","deploy_version":"' || deploy_version || '"}' AS d, deploy_version,
      min(timestamp) AS first_seen FROM telemetry GROUP BY deploy_version))"""

MESSAGES = """
stored AS (
  SELECT *, CASE role
    WHEN 'assistant' THEN '{"message":{"function_calls":[{"args":{"sql":' || t
      || '},"name":"run_sql"},{"args":{"session":"' || conv_id || '"},"name":"customer_list"}],'
      || '"role":"model","text":' || t || '},"type":"message"}'
    WHEN 'user' THEN '{"message":{"responses":[{"name":"run_sql","response":{"result":' || t
      || '}},{"name":"customer_list","response":{"result":"' || turn
      || '"}}],"role":"function_response"},"type":"message"}'
    ELSE '{"note":' || t || ',"type":"note"}' END AS content
  FROM (SELECT *, CAST(to_json(text) AS VARCHAR) AS t FROM conversations))"""

STATUS = """CASE WHEN p99_latency > 1000 OR error_rate > 10 THEN 'critical'
  WHEN p99_latency > 500 OR error_rate > 5 THEN 'warning' ELSE 'healthy' END"""


def history_steps(name: str, n: int, fields: str) -> str:
    return f"SELECT {n} AS step, '{name}' AS name, '{{' || {fields} || '}}' AS result, * FROM report"


def _number(key: str, column: str) -> str:
    """A JSON member that is left out when the value is null."""
    return f"""coalesce('"{key}":' || {column} || ',', '')"""


def investigation_history_sql(runs: int = 1) -> str:
    def body(*members: str) -> str:
        return "rtrim(" + " || ".join(members) + ", ',')"

    def text(key: str, column: str) -> str:
        return _number(key, f"CAST(to_json({column}) AS VARCHAR)")

    steps = " UNION ALL ".join(history_steps(name, n, fields) for n, (name, fields) in enumerate([
        ("survey", body(_number("error_rate", "error_rate"), _number("p99_latency", "p99_latency"),
                        _number("request_count", "request_count"))),
        ("by_endpoint", body(text("endpoint", "endpoint"),
                             _number("endpoint_error_rate", "endpoint_error_rate"),
                             _number("endpoint_p99", "endpoint_p99"))),
        ("by_deploy", body(text("deploy_version", "deploy_version"),
                           _number("error_rate_change", "error_rate_change"),
                           _number("p99_change", "p99_change"))),
        ("onset", body(text("onset", "strftime(onset, '%Y-%m-%d %H:%M')"))),
        ("error_messages", body(_number("error_count", "error_count"),
                                text("error_message", "error_message"))),
        ("finding", body(text("summary", SUMMARY), text("title", TITLE))),
    ]))
    held = ("" if runs == 1 else ",\n  (SELECT count(DISTINCT sha) FROM hashed) AS objects_held")
    return telemetry(f"""
SELECT 'sweep-1/' || s.customer_id AS session_id, CAST(6 * run + s.step + 1 AS BIGINT) AS version,
  CASE WHEN 6 * run + s.step > 0 THEN CAST(6 * run + s.step AS BIGINT) END AS parent_version,
  CASE WHEN s.step = 5 THEN 'completed' ELSE 'running' END AS status,
  string_agg(p.sha, ',' ORDER BY p.step) AS descriptors,
  strftime({LAST}, '%Y-%m-%dT%H:%M:%S') AS at_time, 'manual' AS trigger,
  CAST(CASE WHEN s.step = 5 THEN 1 ELSE 0 END AS BIGINT) AS findings_count{held}
FROM hashed s JOIN hashed p ON p.customer_id = s.customer_id AND p.step <= s.step, range({runs}) r(run)
GROUP BY run, s.customer_id, s.step""", *SWEEP, f"investigated AS ({steps})", """
hashed AS (SELECT customer_id, step, sha256('{"message":{"responses":[{"name":"' || name
  || '","response":{"result":' || CAST(to_json(result) AS VARCHAR)
  || '}}],"role":"function_response"},"type":"message"}') AS sha FROM investigated)""")


def history(body: str) -> str:
    return "WITH " + STEPS_CTE + "\n" + body


def over_events(sql: str) -> str:
    """An ad-hoc statement with ``events`` standing for the telemetry rows."""
    renamed = re.sub(r"\b(FROM|JOIN)\s+events\b", r"\1 telemetry", sql.strip().rstrip(";"),
                     flags=re.IGNORECASE)
    return telemetry(f"SELECT * FROM ({renamed})")


def oracle_sql() -> dict[str, str]:
    sql_select = telemetry("""
SELECT endpoint, count(*) AS requests, CAST(count(*) FILTER (status_code >= 500) AS BIGINT) AS errors
FROM telemetry GROUP BY endpoint""")
    sweep_feed = [ALERTS, *SWEEP, stored_findings(), FEED]
    return {
        "ingest_parse": telemetry("SELECT * EXCLUDE (d, at_time) FROM records", WIRE),
        "ingest_validate": telemetry(
            "SELECT trace_id, missing, invalid, reason FROM validated", WIRE),
        "ingest_rejects": telemetry(
            "SELECT reason, count(*) AS lines FROM validated WHERE reason IS NOT NULL GROUP BY reason",
            WIRE),
        "ingest_normalize_ts": telemetry("""
SELECT trace_id, CASE WHEN d = 7 THEN at_time - INTERVAL '2 hours' ELSE at_time END AS timestamp
FROM validated WHERE reason IS NULL""", WIRE),
        "ingest_forwarded": telemetry("""
SELECT * EXCLUDE (n) REPLACE (CASE WHEN n % 3 = 0 THEN '' ELSE customer_name END AS customer_name,
  CASE WHEN n % 4 = 0 THEN 0 ELSE status_code END AS status_code,
  CASE WHEN n % 5 = 0 THEN 0 ELSE latency_ms END AS latency_ms)
FROM (SELECT *, CAST(substr(trace_id, 7) AS BIGINT) AS n FROM telemetry) WHERE n % 7 <> 0"""),
        "ingest_counters": telemetry("""
SELECT count(*) AS events_received, count(*) FILTER (reason IS NULL) AS events_accepted,
  count(*) FILTER (reason IS NOT NULL) AS events_rejected FROM validated""", WIRE),
        "sink_roundtrip": telemetry(
            "SELECT *, CAST(timestamp AS DATE) AS timestamp_day FROM telemetry"),
        "customer_health": telemetry("SELECT * FROM health", health_cte()),
        "customer_health_15m": telemetry("SELECT * FROM health", health_cte(15)),
        "customer_health_kept": telemetry("SELECT * FROM health", health_cte()),
        "scan_as_of": telemetry("""
SELECT CAST(timestamp AS DATE) AS timestamp_day, customer_id, count(*) AS n, max(timestamp) AS last_seen,
  (SELECT count(*) FROM telemetry) AS now
FROM telemetry WHERE CAST(substr(trace_id, 7) AS BIGINT) % 3 < 2 GROUP BY ALL"""),
        "customer_health_all": telemetry("SELECT * FROM health", health_cte(None)),
        "recent_events": telemetry(
            "SELECT * FROM telemetry ORDER BY timestamp DESC, trace_id LIMIT 50"),
        "deploy_history": telemetry(f"""
SELECT deploy_version, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  count(*) AS event_count, count(DISTINCT customer_id) AS customers_affected,
  {rnd('avg(latency_ms)', 1)} AS avg_latency, {ERROR_RATE} AS error_rate
FROM telemetry GROUP BY deploy_version ORDER BY first_seen DESC LIMIT 20"""),
        "sql_guarded_select": sql_select,
        "sql_guarded_with": over_events(SQL_WITH),
        "sql_guarded_rejected": telemetry("SELECT kind, true AS refused, 1::BIGINT AS n FROM (VALUES "
            + ", ".join(f"('{kind}')" for kind in SQL_REFUSED) + ") AS t(kind) "
            "UNION ALL SELECT 'none', false, count(*) FROM telemetry"),
        "sql_self_join": over_events(SQL_SELF_JOIN),
        "sql_time_bucket": over_events(SQL_BUCKETS),
        "sql_json_rows": telemetry("""
SELECT '{"customer_id":"' || customer_id || '","last_seen":"'
  || CASE WHEN max(timestamp) = date_trunc('second', max(timestamp))
     THEN strftime(max(timestamp), '%Y-%m-%dT%H:%M:%S')
     ELSE strftime(max(timestamp), '%Y-%m-%dT%H:%M:%S.%f') END || '","requests":' || count(*)
  || ',"error_message":' || coalesce('"' || max(error_message) || '"', 'null') || '}' AS "row"
FROM telemetry GROUP BY customer_id"""),
        "survey_candidates": telemetry(f"SELECT * FROM health WHERE {SURVEY}", health_cte()),
        "min_sample_gate": telemetry(
            "SELECT * FROM health WHERE request_count >= 30", health_cte()),
        "baseline_outliers": telemetry("SELECT * FROM outliers", health_cte(), BASELINE),
        "drill_endpoint": telemetry(rollup("customer_id, endpoint")),
        "drill_deploy": telemetry(deploy_rollup("customer_id")),
        "drill_timeline": telemetry(timeline_rollup("customer_id")),
        "degradation_onset": telemetry(f"""
SELECT customer_id, min(bucket_start) AS onset FROM ({timeline_rollup('customer_id')})
WHERE request_count >= 10 AND {SURVEY} GROUP BY customer_id"""),
        "drill_errors": telemetry("""
SELECT customer_id, error_message, count(*) AS error_count FROM telemetry
WHERE status_code >= 500 GROUP BY customer_id, error_message"""),
        "severity_classify": telemetry(f"SELECT *, {SEVERITY} AS severity FROM health",
                                       health_cte()),
        "findings": telemetry("SELECT * FROM findings", *SWEEP, stored_findings()),
        "findings_targeted": telemetry(
            f"SELECT {finding_columns(chr(39) + 'alert-1' + chr(39), '(SELECT max(timestamp) FROM one)')},"
            f" {_evidence_text()} FROM report", *TARGETED),
        "findings_by_customer": telemetry("""
SELECT h.customer_id, h.customer_name, count(f.id) AS finding_count,
  count(DISTINCT f.session_id) AS session_count
FROM health h LEFT JOIN findings f
  ON f.customer_id = h.customer_id OR f.customer_name = h.customer_name
GROUP BY h.customer_id, h.customer_name""", *SWEEP, stored_findings()),
        "investigation_history": investigation_history_sql(),
        "history_roundtrip": investigation_history_sql(2),
        "history_two_writers": "SELECT * FROM (" + telemetry("""
SELECT 'sweep-1/' || customer_id AS session_id, 12::BIGINT AS versions, 12::BIGINT AS latest, 'manual' AS trigger,
  42::BIGINT AS descriptors, 6::BIGINT AS objects FROM report""", *SWEEP) + """) UNION ALL SELECT * FROM (""" + telemetry("""
SELECT session_id, 6, 6, 'anomaly_detected', 21, 6 FROM report""", *ALERT_SCOPE) + ")",
        "detector_windows": telemetry(f"SELECT {RATES} FROM windows", WINDOWS),
        "detector_anomalies": telemetry(f"SELECT {RATES} FROM anomalies", WINDOWS),
        "detector_alerts": telemetry(f"SELECT {RATES} FROM alerts", ALERTS),
        "alert_messages": telemetry("""
SELECT tick, customer_id, 'ALERT at ' || strftime(tick, '%Y-%m-%dT%H:%M:%S')
  || ': Anomaly detected for customer ' || customer_id || '. Current error rate: '
  || printf('%.1f', error_rate * 100) || '%. Current avg latency: '
  || printf('%.0f', avg_latency) || 'ms.' AS message
FROM alerts""", ALERTS),
        "alert_findings": telemetry(
            f"SELECT {finding_columns('session_id', 'tick')} FROM report", *ALERT_SCOPE),
        "content_hash": history("SELECT session_id, version, pos, sha FROM hashed"),
        "object_dedup": history("""
SELECT * FROM objects WHERE sha NOT IN (SELECT sha FROM hashed WHERE version = 1)"""),
        "snapshot_build": history(f"SELECT {SNAPSHOT_COLUMNS} FROM snapshots"),
        "snapshot_load": history(f"SELECT {SNAPSHOT_COLUMNS} FROM snapshots WHERE version = 2"),
        "snapshot_latest": history(
            "SELECT session_id, max(version) AS latest_version FROM snapshots GROUP BY session_id"),
        "session_list": history("SELECT DISTINCT session_id FROM snapshots"),
        "snapshot_versions": history(f"""
SELECT {SNAPSHOT_COLUMNS} FROM snapshots WHERE NOT (version = 2 AND status = 'running')"""),
        "snapshot_replay": history("""
SELECT session_id, sha, version, CAST(pos AS BIGINT) AS pos, content FROM refs
QUALIFY row_number() OVER (PARTITION BY session_id, sha ORDER BY version, pos) = 1"""),
        "snapshot_objects": history("SELECT * FROM refs"),
        "snapshot_timeline": history("""
SELECT session_id, version, substr(at_time, 12, 8) AS at_time, CAST(object_count AS INT) AS object_count, status
FROM snapshots"""),
        "message_flatten": "WITH " + MESSAGES + """
SELECT sha256(content) AS sha, CASE WHEN role IN ('assistant', 'user') THEN 'message' ELSE 'note' END AS type,
  CASE role WHEN 'assistant' THEN 'model' WHEN 'user' THEN 'function_response' END AS role,
  CASE role WHEN 'assistant' THEN text WHEN 'user' THEN '' END AS text,
  CASE role WHEN 'assistant' THEN substr(text, 1, 500) WHEN 'user' THEN '' END AS shown_text,
  CASE WHEN role = 'assistant' THEN 'run_sql, customer_list' END AS tools,
  CASE WHEN role NOT IN ('assistant', 'user') THEN content END AS raw,
  CASE WHEN role NOT IN ('assistant', 'user') THEN substr(content, 1, 300) END AS shown_raw,
  r.n AS response_no,
  CASE r.n WHEN 0 THEN 'run_sql' WHEN 1 THEN 'customer_list' END AS response_tool,
  CASE r.n WHEN 0 THEN text WHEN 1 THEN CAST(turn AS VARCHAR) END AS response,
  CASE r.n WHEN 0 THEN substr(text, 1, 400) WHEN 1 THEN CAST(turn AS VARCHAR) END AS shown_response
FROM stored LEFT JOIN (VALUES (0), (1)) r(n) ON stored.role = 'user'""",
        "health_status": telemetry(f"SELECT *, {STATUS} AS status FROM health", health_cte()),
        "latency_chart": telemetry("""
SELECT split_part(customer_name, ' ', 1) AS name, customer_id, p50_latency AS p50, p99_latency AS p99,
  CASE WHEN p99_latency > 1000 THEN 'critical' WHEN p99_latency > 500 THEN 'warning'
       ELSE 'healthy' END AS latency_class,
  200 AS slo_ms, p99_latency > 200 AS slo_breached FROM health""", health_cte()),
        "health_sorted": telemetry("""
SELECT *, lower(customer_name) AS sort_key FROM health ORDER BY sort_key""", health_cte()),
        "feed_union": telemetry("SELECT * EXCLUDE (summary) FROM feed", *sweep_feed),
        "feed_summary": telemetry("""
SELECT event, ts, feed_key, rpad(event, 22, ' ') || ' ' || summary AS line,
  starts_with(event, 'agent:') AS is_agent FROM feed""", *sweep_feed),
        "feed_tail": telemetry("""
SELECT * EXCLUDE (summary) FROM feed ORDER BY ts DESC, event, feed_key LIMIT 200""", *sweep_feed),
        "status_summary": telemetry("""
SELECT (SELECT count(*) FROM telemetry) AS total_events_ingested,
  (SELECT count(*) FROM findings) AS findings_count""", *SWEEP, stored_findings()),
    }
