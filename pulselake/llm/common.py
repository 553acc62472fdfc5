"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import moved, scratch_path, session_apart

# Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def apart(df: DataFrame, **conf: str) -> DataFrame:
    """``df`` in a session of its own, so that an operator's settings do not touch its caller's, and
    hold whenever its result is computed."""
    return moved(df, session_apart(df.sparkSession, **conf))


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the Arrow batches sent to Python, so that very long texts do not add up. For a
    session that is ``apart``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def named(column: str) -> Column:
    """The column of that very name."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(docs: DataFrame) -> Column:
    """``doc``: all columns of ``docs`` but ``text``, whatever their names, as one struct, so that
    they clash with none. The text stays a column of its own and is shuffled once."""
    return F.struct(*[named(c) for c in docs.columns if c != "text"]).alias("doc")


def unpacked(docs: DataFrame, **instead: Column) -> list[Column]:
    """The columns of ``docs`` from ``doc`` and ``text``, some of them replaced."""
    own = {"text": F.col("text")} | instead
    return [own.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns]


class Scratch:
    """Tables written to the shared folder, deleted one by one once they are not needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
