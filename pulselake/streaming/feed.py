"""The live feed: several streams as one, of which the newest messages are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import views
from ..session import materialize, scratch_scope


def _as_one(sources: dict[str, DataFrame]) -> DataFrame:
    """The union of streams with different columns: a struct column for each, null in the others."""
    kinds = {name: df.schema.simpleString() for name, df in sources.items()}
    return _union([df.select(F.lit(name).alias("source"), *[
        (F.struct(*df.columns) if other == name else F.lit(None).cast(kind)).alias(other)
        for other, kind in kinds.items()]) for name, df in sources.items()])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def start_feed(events: DataFrame, path: str, checkpoint: str, alerts: DataFrame | None = None,
               findings: DataFrame | None = None, n: int = views.FEED_LIMIT, **trigger) -> StreamingQuery:
    """Keep the newest ``n`` messages of the streams below ``path``, and how many there were.

    Each batch is cut to its own newest ``n`` by Spark, which merges them with those kept so far;
    no more than twice ``n`` messages meet in a task. The state of a batch is a folder of its
    own, made from that of the batch before, so a batch that is retried counts once. The findings of a
    session are one sweep: they should arrive in one batch, as ``start_investigations`` writes them.
    """
    given = {name: df for name, df in (("events", events), ("alerts", alerts), ("findings", findings))
             if df is not None}

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            rows = materialize(batch, "feed")
            parts = {name: rows.where(F.col("source") == name).select(f"{name}.*") for name in given}
            messages = materialize(views.feed(**parts), "messages")
            old = kept_batches(spark, path, below=batch_id)
            seen = messages.count()
            tail = views.feed_tail(messages, n)
            if old:
                before = spark.read.parquet(_folder(path, old[-1]))
                seen += before.agg(F.max("seen")).first()[0] or 0
                tail = views.feed_tail(tail.unionByName(before.drop("seen")), n)
            tail.withColumn("seen", F.lit(seen).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(
                _folder(path, batch_id))
            for number in old[:-2]:  # what a reader may still be at stays
                _delete(spark, _folder(path, number))

    return (_as_one(given).writeStream.foreachBatch(handle).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def live_tail(spark: SparkSession, path: str) -> DataFrame:
    """The kept messages, newest first, with ``seen``, how many there were in all, and ``dropped``,
    how many of those are not kept any more."""
    rows = spark.read.parquet(_folder(path, kept_batches(spark, path)[-1]))
    kept = rows.agg(F.count(F.lit(1))).scalar()
    return rows.withColumn("dropped", F.col("seen") - kept).orderBy(F.desc("ts"), "event", "feed_key")


def kept_batches(spark: SparkSession, path: str, below: int | None = None) -> list[int]:
    """The batches whose state is complete, in order; there are a few."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []
    numbers = sorted(int(status.getPath().getParent().getName().split("=")[1]) for status in found)
    return [x for x in numbers if below is None or x < below]


def _folder(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
