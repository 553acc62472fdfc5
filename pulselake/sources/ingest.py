"""From JSON lines to typed, validated telemetry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EVENT_COLUMNS, NON_EMPTY_COLUMNS, REQUIRED_COLUMNS, WIRE_SCHEMA

# Fixed value: how a line that is no valid record is refused.
INVALID_JSON = "invalid JSON"
# Standard JSON only: no NaN or Infinity, no single quotes, no bare names.
_STRICT = {"columnNameOfCorruptRecord": "_corrupt", "allowNonNumericNumbers": "false",
           "allowSingleQuotes": "false", "allowUnquotedFieldNames": "false",
           "allowNumericLeadingZeros": "false"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _has_type(kind: Column, data_type: T.DataType) -> Column:
    """Whether a JSON value of variant type ``kind`` may stand for the column type."""
    if isinstance(data_type, T.StringType):
        fits = kind == "STRING"
    elif isinstance(data_type, T.IntegerType):
        fits = kind == "BIGINT"
    else:
        fits = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    return kind.isNull() | (kind == "VOID") | fits


def decode(lines: DataFrame, column: str = "value") -> DataFrame:
    """The record columns of each JSON line, the timestamp still as text, and whether the
    line is an object whose values have the right JSON types.

    The line is parsed once, into a variant per column, and passed through a one-row
    generator: filters on what follows would otherwise be pushed below the parsing and
    repeat it for each use of a column.
    """
    variants = ", ".join(f"{f.name} VARIANT" for f in WIRE_SCHEMA.fields)
    parsed = lines.select(F.col(column).alias("line"), F.inline(F.array(F.from_json(
        column, f"{variants}, _corrupt STRING", _STRICT))))
    ok = F.col("_corrupt").isNull() & F.ltrim("line").startswith("{")
    for field in WIRE_SCHEMA.fields:
        ok = ok & _has_type(F.schema_of_variant(field.name), field.dataType)
    values = [F.try_variant_get(f.name, "$", f.dataType.simpleString()).alias(f.name)
              for f in WIRE_SCHEMA.fields]
    return parsed.select("line", ok.alias("json_ok"), *values)


def forward_defaults(records: DataFrame) -> DataFrame:
    """What the forwarding tier makes of absent values: an empty name and zero numbers."""
    return (records.withColumn("customer_name", F.coalesce("customer_name", F.lit("")))
            .withColumn("status_code", F.coalesce("status_code", F.lit(0)))
            .withColumn("latency_ms", F.coalesce("latency_ms", F.lit(0.0))))


def to_utc(text: Column) -> Column:
    """Timestamp from ISO text; without an offset the text is UTC. Null if unreadable."""
    zoned = text.rlike("([zZ]|[+-][0-9]{2}(:?[0-9]{2})?)$") & text.contains(":")
    return F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")


def _names(columns: list[str], absent) -> Column:
    return F.filter(F.array(*[F.when(absent(c), F.lit(c)) for c in columns]),
                    lambda name: name.isNotNull())


def missing_fields(columns: list[str] = NON_EMPTY_COLUMNS) -> Column:
    """Names of required text columns that are absent or empty, in the fixed order."""
    return _names(columns, lambda c: F.col(c).isNull() | (F.col(c) == ""))


def _unusable(column: str) -> Column:
    if column == "timestamp":
        return F.col("event_time").isNull()
    absent = F.col(column).isNull()
    if column == "latency_ms":
        return absent | F.isnan(column) | (F.abs(column) == float("inf"))
    return absent


def validate(records: DataFrame) -> DataFrame:
    """Adds ``missing``, the empty required texts; ``invalid``, the required columns that
    are null, unreadable (timestamp) or no finite number (latency); and ``reason``, null when accepted."""
    records = (records.withColumn("event_time", to_utc(F.col("timestamp")))
               .withColumn("missing", missing_fields())
               .withColumn("invalid", _names(REQUIRED_COLUMNS, _unusable)))
    reason = F.when(F.size("missing") > 0, F.concat(
        F.lit("missing required fields: "), F.array_join("missing", ", "))).when(
        F.size("invalid") > 0, F.concat(
            F.lit("invalid fields: "), F.array_join("invalid", ", ")))
    if "json_ok" in records.columns:
        reason = F.when(~F.col("json_ok"), F.lit(INVALID_JSON)).otherwise(reason)
    return records.withColumn("reason", reason)


def accepted(validated: DataFrame) -> DataFrame:
    return (validated.where(F.col("reason").isNull())
            .withColumn("timestamp", F.col("event_time")).select(*EVENT_COLUMNS))


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reason").isNotNull()).select("line", "reason")


def ingest_counters(validated: DataFrame) -> DataFrame:
    """Lines received, rows accepted and lines refused."""
    return validated.agg(*counter_columns())


def counter_columns() -> list[Column]:
    return [F.count(F.lit(1)).alias("events_received"),
            F.count_if(F.col("reason").isNull()).alias("events_accepted"),
            F.count_if(F.col("reason").isNotNull()).alias("events_rejected")]
