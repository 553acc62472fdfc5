"""Running totals over a whole table, or over groups of any size, without one task holding
a group: the order is a hash, so its leading bits cut every group into even bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BIN = 20_000
LEAST_BITS = 12


def hash_order(*columns: Column) -> Column:
    """60 leading bits of the md5 of the columns' texts (null: empty), as a long."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int,
                  out: str = "before") -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``keys`` that come
    earlier by ``order``, whose first column must be a ``hash_order``. ``keys`` must not
    be null. ``rows``, the row count, sets the number of bins. Rows equal in all of
    ``order`` take their totals in any order. ``df`` is read twice."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(rows, 1) / ROWS_PER_BIN + 1)))
    binned = df.withColumn("_bin", F.shiftright(order[0], 60 - bits))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = (binned.groupBy(*keys, "_bin").agg(F.sum(value).alias("_sum"))
              .select(*keys, "_bin", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")))
    inside = (Window.partitionBy(*keys, "_bin").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (binned.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(starts, [*keys, "_bin"])
            .withColumn(out, F.col("_start") + F.col("_inside"))
            .drop("_bin", "_start", "_inside"))
