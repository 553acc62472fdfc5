"""Fixed schemas of the tables."""

from pyspark.sql import types as T

# The event columns, in table order. All but error_message are required.
EVENT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("deploy_version", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("error_message", T.StringType()),
])
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()
REQUIRED_COLUMNS = [name for name in EVENT_COLUMNS if name != "error_message"]

# The strings that must not be empty, in reporting order.
NON_EMPTY_COLUMNS = [
    "timestamp", "trace_id", "customer_id", "endpoint", "method", "deploy_version", "region",
]

# The record as it arrives: the timestamp is still text.
WIRE_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()) if f.name == "timestamp" else f
    for f in EVENT_SCHEMA.fields
])

OBJECT_SCHEMA = T.StructType([
    T.StructField("sha", T.StringType()),
    T.StructField("content", T.StringType()),
])

SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("parent_version", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("descriptors", T.ArrayType(T.StringType())),
    T.StructField("metadata", T.StructType([
        T.StructField("timestamp", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("trigger", T.StringType()),
        T.StructField("findings_count", T.LongType()),
    ])),
])

MESSAGE_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("message", T.StructType([
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("function_calls", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("args", T.MapType(T.StringType(), T.StringType())),
        ]))),
        T.StructField("tool_calls", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("function", T.StructType([T.StructField("name", T.StringType())])),
        ]))),
        T.StructField("responses", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("response", T.StringType()),  # JSON text
        ]))),
    ])),
])
