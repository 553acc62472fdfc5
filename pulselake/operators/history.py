"""Content-addressed objects, versioned snapshots and their replay."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MESSAGE_SCHEMA, OBJECT_SCHEMA, SNAPSHOT_SCHEMA
from ..session import materialize

# How much of a stored text the timeline shows.
TEXT_CHARS, RESPONSE_CHARS, RAW_CHARS = 500, 400, 300
#: Hexadecimal digits of a hash by which stored objects are partitioned.
PREFIX = 2


def canonical_json(document: Column) -> Column:
    """JSON text with the keys sorted at every level and no spaces; null if malformed."""
    return F.to_json(F.try_parse_json(document))


def content_hash(df: DataFrame, document: str = "content") -> DataFrame:
    """Documents in canonical form with their sha256, the key they are stored under."""
    return (df.withColumn(document, canonical_json(F.col(document)))
            .where(F.col(document).isNotNull())
            .withColumn("sha", F.sha2(document, 256)))


def put_objects(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Objects of ``new`` to append: each content once, none that is stored already."""
    rows = new.select("sha", "content").dropDuplicates(["sha"])
    return rows if existing is None else rows.join(existing.select("sha"), "sha", "left_anti")


def get_objects(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    """``wanted`` rows with the content behind their ``sha``."""
    return wanted.join(objects.select("sha", "content"), "sha")


def save_snapshots(steps: DataFrame) -> DataFrame:
    """Snapshots from steps ``(session_id, cycle, version, pos, sha, timestamp,
    customer_id, trigger, findings_count)``, one row per new object.

    Descriptors add up within a cycle and start anew in the next; the last version of a
    cycle is completed. The window spans one cycle, which the round limit keeps short,
    so a long session is spread over its cycles.
    """
    versions = steps.groupBy("session_id", "cycle", "version").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "sha"))), lambda s: s["sha"])
        .alias("added"),
        F.struct(F.max("timestamp").alias("timestamp"), F.max("customer_id").alias("customer_id"),
                 F.max("trigger").alias("trigger"),
                 F.max("findings_count").alias("findings_count")).alias("metadata"))
    cycle = Window.partitionBy("session_id", "cycle")
    so_far = cycle.orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return versions.select(
        "session_id", "version",
        F.when(F.col("version") > 1, F.col("version") - 1).alias("parent_version"),
        F.when(F.col("version") == F.max("version").over(cycle), "completed")
        .otherwise("running").alias("status"),
        F.flatten(F.collect_list("added").over(so_far)).alias("descriptors"),
        "metadata")


def decode_snapshots(documents: DataFrame, column: str = "document") -> DataFrame:
    """Snapshots read from JSON documents; those that cannot be read are skipped."""
    return (documents.select(F.from_json(column, SNAPSHOT_SCHEMA).alias("s"))
            .select("s.*").where(F.col("session_id").isNotNull() & F.col("version").isNotNull()))


def load_snapshot(snapshots: DataFrame, version: int, session_id: str | None = None) -> DataFrame:
    """One version, of one session or of each that has it."""
    return in_session(snapshots, session_id).where(F.col("version") == version)


def in_session(snapshots: DataFrame, session_id: str | None) -> DataFrame:
    return snapshots if session_id is None else snapshots.where(F.col("session_id") == session_id)


def latest_versions(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("session_id").agg(F.max("version").alias("latest_version"))


def sessions(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("session_id").distinct().orderBy("session_id")


def versions(snapshots: DataFrame, session_id: str | None = None) -> DataFrame:
    return in_session(snapshots, session_id).orderBy("session_id", "version")


def new_references(snapshots: DataFrame) -> DataFrame:
    """``(session_id, version, pos, sha)`` of the descriptors that a version adds to the one before
    it in its session. A version that goes on from the one before, as all of a cycle do, gives
    only what lies beyond that; so each descriptor of a cycle is exploded once."""
    before = F.lag("descriptors").over(Window.partitionBy("session_id").orderBy("version"))
    known = F.size("_before")
    goes_on = (known <= F.size("descriptors")) & (F.slice("descriptors", F.lit(1), known) == F.col("_before"))
    start = F.when(F.col("_before").isNotNull() & goes_on, known).otherwise(0)
    added = F.when(F.col("_start") == 0, F.col("descriptors")).otherwise(F.slice(
        "descriptors", F.col("_start") + 1, F.size("descriptors")))
    return (snapshots.select("session_id", "version", "descriptors", before.alias("_before"))
            .withColumn("_start", start)
            .select("session_id", "version", "_start", F.posexplode(added).alias("_pos", "sha"))
            .select("session_id", "version", (F.col("_start") + F.col("_pos")).alias("pos"), "sha"))


def replay(snapshots: DataFrame, objects: DataFrame, session_id: str | None = None) -> DataFrame:
    """Objects of a session in order of first appearance, each hash once.

    The minimum of (version, pos) is combined map-side. An object that many sessions share
    is a hot key of the join; adaptive execution splits it on the side of the references.
    """
    first = (new_references(in_session(snapshots, session_id)).groupBy("session_id", "sha")
             .agg(F.min(F.struct("version", F.col("pos").cast("bigint").alias("pos"))).alias("seen"))
             .select("session_id", "sha", "seen.version", "seen.pos"))
    return get_objects(first, objects).orderBy("session_id", "version", "pos")


def snapshot_objects(snapshots: DataFrame, objects: DataFrame, version: int | None = None,
                     session_id: str | None = None) -> DataFrame:
    """Objects of each snapshot in descriptor order, repeats kept."""
    rows = in_session(snapshots, session_id)
    if version is not None:
        rows = rows.where(F.col("version") == version)
    rows = rows.select("session_id", "version", F.posexplode("descriptors").alias("pos", "sha"))
    return get_objects(rows, objects).orderBy("session_id", "version", "pos")


def snapshot_timeline(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(
        "session_id", "version",
        F.coalesce(F.substring("metadata.timestamp", 12, 8), F.lit("")).alias("at_time"),
        F.size("descriptors").alias("object_count"), "status")


def flatten_messages(objects: DataFrame) -> DataFrame:
    """Role, text, tool names and responses of stored messages, one row per response, whole
    and as the timeline shows them (``shown_*``). A response without a text ``result`` is the
    whole response. Other objects keep their JSON in ``raw``, and its start in ``shown_raw``."""
    rows = objects.withColumn("_o", F.from_json("content", MESSAGE_SCHEMA))
    message = F.col("_o.message")
    is_message = F.col("_o.type") == "message"
    text = F.coalesce(F.when(message["content"] != "", message["content"]), message["text"],
                      F.lit(""))
    calls = F.coalesce(
        F.transform(message["tool_calls"], lambda c: F.coalesce(c["function"]["name"], c["name"])),
        F.transform(message["function_calls"], lambda c: c["name"]))
    # A text result is shown as it is; any other response is shown whole.
    result = F.try_variant_get(F.try_parse_json(F.col("_r.response")), "$.result", "variant")
    is_text = F.coalesce(F.schema_of_variant(result) == "STRING", F.lit(False))
    return rows.select(
        "sha", F.col("_o.type").alias("type"),
        F.when(is_message, message["role"]).alias("role"),
        F.when(is_message, text).alias("text"),
        F.when(is_message, F.array_join(calls, ", ")).alias("tools"),
        F.when(~is_message, F.col("content")).alias("raw"),
        F.posexplode_outer(F.when(is_message, message["responses"])).alias("response_no", "_r"),
    ).select(
        "sha", "type", "role", "text", "tools", "raw", "response_no",
        F.col("_r.name").alias("response_tool"),
        F.when(is_text, F.get_json_object("_r.response", "$.result"))
        .otherwise(F.col("_r.response")).alias("response")
    ).select(
        "*", F.substring("text", 1, TEXT_CHARS).alias("shown_text"),
        F.substring("raw", 1, RAW_CHARS).alias("shown_raw"),
        F.substring("response", 1, RESPONSE_CHARS).alias("shown_response"))


# --- the store ---------------------------------------------------------------------------
#
# Below one path: ``objects``, by the beginning of their hash; ``snapshots``, a folder for each
# run; ``commits``, a row for each run whose snapshots are complete. Sweeps and the batches of
# alert streams are runs alike. Readers see committed runs only.


def _touched(new: DataFrame) -> list[str]:
    """The prefixes among the hashes of ``new``, at most 16 ** ``PREFIX``."""
    return sorted(r[0] for r in new.select(_prefix()).distinct().collect())


def _prefix() -> Column:
    return F.substring("sha", 1, PREFIX).alias("prefix")


def candidates_for(new: DataFrame, path: str) -> DataFrame:
    """The stored objects below ``path`` among which those of ``new`` could be: only the folders of
    their prefixes are listed in the plan."""
    return _object_rows(new.sparkSession, path).where(F.col("prefix").isin(_touched(new)))


def store_objects(new: DataFrame, path: str) -> None:
    """Append the objects of ``new`` that are not below ``path`` yet."""
    known = candidates_for(new, path) if _exists(new.sparkSession, f"{path}/objects") else None
    (put_objects(new, known).withColumn("prefix", _prefix()).hint("rebalance", "prefix")
     .write.mode("append").partitionBy("prefix").parquet(f"{path}/objects"))


def _object_rows(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*OBJECT_SCHEMA.fields, T.StructField("prefix", T.StringType())])
    if not _exists(spark, f"{path}/objects"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/objects")


def stored_objects(spark: SparkSession, path: str) -> DataFrame:
    """All objects, each once even if two writers put it at the same time."""
    return _object_rows(spark, path).drop("prefix").dropDuplicates(["sha"])


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """``run`` of each run that is complete."""
    if not _exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], "run STRING")
    return spark.read.schema("run STRING").parquet(f"{path}/commits").distinct()


def stored_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The snapshots of all committed runs. What a run that failed left behind is not read."""
    if not _exists(spark, f"{path}/snapshots"):
        return spark.createDataFrame([], SNAPSHOT_SCHEMA)
    schema = T.StructType([*SNAPSHOT_SCHEMA.fields, T.StructField("run", T.StringType())])
    return spark.read.schema(schema).parquet(f"{path}/snapshots").join(
        committed_runs(spark, path), "run", "left_semi").drop("run")


def continue_sessions(steps: DataFrame, path: str) -> DataFrame:
    """``steps`` with their versions counted on from the latest committed one of their session,
    each run a cycle of its own; unchanged where nothing is stored."""
    latest = latest_versions(stored_snapshots(steps.sparkSession, path)).withColumnRenamed(
        "latest_version", "_latest")
    shift = F.coalesce("_latest", F.lit(0))
    return (steps.join(latest, "session_id", "left")
            .withColumn("cycle", F.col("cycle") + shift.cast("int"))
            .withColumn("version", F.col("version") + shift)
            .drop("_latest").select(*steps.columns))


def write_run(steps: DataFrame, path: str, run: str) -> None:
    """The objects and snapshots of ``run``, whose versions follow on, without its commit. What an
    earlier attempt at the run left behind is replaced."""
    steps = materialize(continue_sessions(steps, path), "steps")
    store_objects(steps, path)
    save_snapshots(steps).write.mode("overwrite").parquet(f"{path}/snapshots/run={run}")


def store_run(steps: DataFrame, path: str, run: str | None = None) -> str:
    """Store one run of investigations, ``steps`` as for ``save_snapshots``, and return its id.

    Objects come first, then snapshots, then the commit: a run that fails shows nothing and can
    be repeated under its id, and a run that is committed is not stored again. Runs may be
    written side by side as long as they continue different sessions."""
    spark = steps.sparkSession
    run = uuid.uuid4().hex if run is None else re.sub(r"[^\w.-]", "_", run)
    if committed_runs(spark, path).where(F.col("run") == run).isEmpty():
        write_run(steps, path, run)
        spark.createDataFrame([(run,)], "run STRING").coalesce(1).write.mode("append").parquet(
            f"{path}/commits")
    return run


def content_run(steps: DataFrame) -> str:
    """An id for a run by what it holds, the same whenever the same steps are stored again."""
    held = steps.agg(F.count(F.lit(1)), F.sum(F.xxhash64("session_id", "version", "pos", "sha").cast(
        "decimal(38,0)"))).first()
    return f"content-{held[0]}-{held[1] or 0}"


def compact_objects(spark: SparkSession, path: str, target: str) -> None:
    """Write the objects below ``path`` to ``target`` in few files, one or more to a prefix."""
    (stored_objects(spark, path).withColumn("prefix", _prefix()).hint("rebalance", "prefix")
     .write.mode("overwrite").partitionBy("prefix").parquet(f"{target}/objects"))


def _exists(spark: SparkSession, path: str) -> bool:
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name)
