"""Continuous ingestion from JSON-lines files into the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import health
from ..sources import ingest, store

# Fixed value: the flush interval.
FLUSH_SECONDS = 5
COUNTERS = ("query STRING, batch BIGINT, at STRING, input BIGINT, received BIGINT, flushed BIGINT, refused BIGINT, "
            "late BIGINT")


def stream_validated(spark: SparkSession, source: str, max_files: int = 100,
                     max_bytes: str | None = None) -> DataFrame:
    """Lines as the forwarding tier hands them on: absent names and numbers get defaults. A
    micro-batch takes at most ``max_files``, or about ``max_bytes`` if that is given."""
    limit = ("maxFilesPerTrigger", max_files) if max_bytes is None else ("maxBytesPerTrigger", max_bytes)
    lines = spark.readStream.option(*limit).text(source)
    return ingest.validate(ingest.forward_defaults(ingest.decode(lines)))


def _trigger(available_now: bool) -> dict:
    return {"availableNow": True} if available_now else {"processingTime": f"{FLUSH_SECONDS} seconds"}


def start_ingest(spark: SparkSession, source: str, path: str, checkpoint: str,
                 max_files: int = 100, available_now: bool = False,
                 max_bytes: str | None = None, bands: str | None = None) -> StreamingQuery:
    """Append accepted events every five seconds, ``max_files`` or ``max_bytes`` at a time.

    A batch is rebalanced by day and customer: small customers share a task, one that
    dominates the batch is split over several. It is written to folders that bear its name, that
    of the query's checkpoint and its number, so a batch that is retried after a failure
    replaces what it wrote before. A table fed by such queries takes no other kind of writer.

    With ``bands``, the batch's ``health.minute_bands`` are kept below that path, out of what was
    written: health reads those (``read_bands``) instead of counting the rows again.
    Counters are in the query progress under ``ingest``, see ``CounterTable``.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        here = batch.sparkSession
        name = f"{here.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        store.write_batch(ingest.accepted(batch), path, name)  # the only action on the batch
        if bands is not None:
            written = here.read.schema(store.TABLE_SCHEMA).parquet(path).where(F.col("batch") == name)
            (health.minute_bands(written).withColumn("timestamp_day", F.to_date("minute"))
             .withColumn("batch", F.lit(name)).coalesce(1).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("timestamp_day", "batch").parquet(bands))

    validated = stream_validated(spark, source, max_files, max_bytes).observe(
        "ingest", *ingest.counter_columns())
    return (validated.writeStream.foreachBatch(handle).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**_trigger(available_now)).start())


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """All parts of the kept ``minute_bands``."""
    return spark.read.parquet(path).drop("timestamp_day", "batch")


def compact_bands(spark: SparkSession, path: str, target: str) -> None:
    """Add the parts up, a row for each group, minute and band, in few files per day."""
    parts = read_bands(spark, path)
    keys = ["customer_id", "customer_name", "minute", "deploy_version", "_band"]
    (parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_n", "_rows", "_errors")],
                              F.min("_earliest").alias("_earliest"), F.max("_latest").alias("_latest"))
     .withColumn("timestamp_day", F.to_date("minute")).withColumn("batch", F.lit("compact"))
     .hint("rebalance", "timestamp_day").write.mode("overwrite").partitionBy("timestamp_day", "batch").parquet(target))


def start_rejects(spark: SparkSession, source: str, path: str, checkpoint: str,
                  max_files: int = 100, available_now: bool = False) -> StreamingQuery:
    """Append refused lines with their reason."""
    rows = ingest.rejected(stream_validated(spark, source, max_files))
    return (rows.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**_trigger(available_now)).start())


class CounterTable(StreamingQueryListener):
    """Appends a row per batch of every query of the session to the table at ``path``: rows read,
    and of ingestion those received, flushed and refused, and rows dropped because they came
    later than the watermark. Add it with ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get("ingest")
        counted = (seen.events_received, seen.events_accepted, seen.events_rejected) if seen else (None,) * 3
        late = sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)
        if progress.numInputRows or late:
            row = (str(progress.id), progress.batchId, progress.timestamp, progress.numInputRows, *counted, late)
            self.spark.createDataFrame([row], COUNTERS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def stream_counters(spark: SparkSession, path: str) -> DataFrame:
    """Totals over the life of each query; a batch that was reported again counts once."""
    rows = spark.read.schema(COUNTERS).parquet(path).dropDuplicates(["query", "batch"])
    return rows.groupBy("query").agg(F.count(F.lit(1)).alias("batches"), *[
        F.sum(c).alias(c) for c in ("input", "received", "flushed", "refused", "late")])
