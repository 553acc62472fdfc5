"""Exact interpolated quantiles per group that no single task has to hold.

The built-in ``percentile`` keeps every distinct value of a group in one aggregation
buffer. With a customer that owns a third of the table that buffer has no bound, so
the rank is located first and only the values around it are looked at:

1. one pass counts rows per group and logarithmic value band; the counts combine
   map-side into a few thousand rows per group, whatever the group holds;
2. a window over the bands of a group tells which bands contain the wanted ranks;
3. while such a band still holds many rows it is divided again, by another pass;
4. a last pass counts equal values inside those bands and ranks them.

The bands of interest, at most two per quantile and group, are written out, so that the
planner knows their size. While they are small enough to be broadcast no pass shuffles
rows; with very many groups the rows are joined to them through a shuffle.

There is one path for all inputs. Groups travel as one struct, so null keys are groups like
others. Null values don't count; NaN comes after every number, infinity included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BANDS_PER_E_FOLD = 256
REFINEMENT = 4096
FINEST = BANDS_PER_E_FOLD * REFINEMENT ** 2
#: A band with more rows than this is divided before its values are ranked; the result does
#: not depend on it. Callers may pass another number.
MAX_BAND_ROWS = 20_000_000
_LOG_LIMIT = 750.0  # above |ln| of every finite non-zero double
_NAN_BAND = (1 << 62)


def value_band(value: Column, per_e_fold: int = BANDS_PER_E_FOLD) -> Column:
    """Band number that never decreases when the value grows."""
    log = F.least(F.greatest(F.log(F.abs(value)), F.lit(-_LOG_LIMIT)), F.lit(_LOG_LIMIT))
    size = F.floor((log + F.lit(_LOG_LIMIT + 1)) * F.lit(float(per_e_fold)))
    sign = F.when(value > 0, 1).when(value < 0, -1).otherwise(0)
    return F.when(F.isnan(value), F.lit(_NAN_BAND)).when(value == 0, F.lit(0)).otherwise(size * sign)


def _key(keys: list[str]) -> Column:
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))


def band_counts(df: DataFrame, keys: list[str], value: str, *measures: Column) -> DataFrame:
    """Values per group and band, with further aggregates; one pass over the rows."""
    return df.groupBy(*keys, value_band(F.col(value)).alias("_band")).agg(
        F.count(value).alias("_n"), *measures)


def _preceding(*columns: str, by: str):
    return (Window.partitionBy(*columns).orderBy(by)
            .rowsBetween(Window.unboundedPreceding, -1))


def _sum_before(count: str, window) -> Column:
    return F.coalesce(F.sum(count).over(window), F.lit(0))


def _ranks(total: Column, quantiles: dict[str, float]) -> Column:
    ends = []
    for q in quantiles.values():
        position = F.lit(q) * (total - 1)
        ends += [F.floor(position), F.ceil(position)]
    return F.array_distinct(F.array(*ends))


def _within(ranks: str | Column, first: str, count: str) -> Column:
    return F.filter(ranks, lambda r: (r >= F.col(first)) & (r < F.col(first) + F.col(count)))


def _bands_of_interest(bands: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    return (bands.where("_n > 0").groupBy("_key", "_band").agg(F.sum("_n").alias("_n"))
            .withColumn("_total", F.sum("_n").over(Window.partitionBy("_key")))
            .withColumn("_first", _sum_before("_n", _preceding("_key", by="_band")))
            .withColumn("_wanted", _within(_ranks(F.col("_total"), quantiles), "_first", "_n"))
            .where(F.size("_wanted") > 0))


def _divide(rows: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """The bands of interest at ``width`` per e-fold, inside the coarser ones in ``found``."""
    counts = (rows.join(found.select("_key", "_band"), ["_key", "_band"], "left_semi")
              .groupBy("_key", "_band", value_band(F.col("_v"), width).alias("_part"))
              .agg(F.count(F.lit(1)).alias("_count")))
    return (counts.join(found, ["_key", "_band"])
            .withColumn("_first", F.col("_first")
                        + _sum_before("_count", _preceding("_key", "_band", by="_part")))
            .withColumn("_wanted", _within("_wanted", "_first", "_count"))
            .where(F.size("_wanted") > 0)
            .select("_key", F.col("_part").alias("_band"), F.col("_count").alias("_n"), "_total",
                    "_first", "_wanted"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
                    bands: DataFrame | None = None,
                    max_band_rows: int | None = None) -> DataFrame:
    """One row per group with a linearly interpolated quantile per alias.

    ``bands`` may pass in what ``band_counts`` gave for these or finer keys. Runs the
    passes that locate the ranks; the last pass is left to the returned DataFrame. Groups
    without values give no row.
    """
    if bands is None:
        bands = band_counts(df, keys, value)
    limit = MAX_BAND_ROWS if max_band_rows is None else max_band_rows
    width = BANDS_PER_E_FOLD
    found = materialize(_bands_of_interest(
        bands.select(_key(keys).alias("_key"), "_band", "_n"), quantiles), "bands")
    values = df.select(_key(keys).alias("_key"), F.col(value).alias("_v")).where("_v IS NOT NULL")

    def banded(width: int) -> DataFrame:
        return values.withColumn("_band", value_band(F.col("_v"), width))

    while width < FINEST and (found.agg(F.max("_n")).first()[0] or 0) > limit:
        rows, width = banded(width), width * REFINEMENT
        found = materialize(_divide(rows, found, width), "bands")

    cells = (banded(width).join(found.select("_key", "_band"), ["_key", "_band"], "left_semi")
             .groupBy("_key", "_band", "_v").agg(F.count(F.lit(1)).alias("_count")))
    hits = (cells.join(found, ["_key", "_band"])
            .withColumn("_at", F.col("_first")
                        + _sum_before("_count", _preceding("_key", "_band", by="_v")))
            .withColumn("_rank", F.explode(_within("_wanted", "_at", "_count"))))
    # At most two ranks per quantile, so the map stays small whatever the group holds.
    result = hits.groupBy("_key").agg(
        F.max("_total").alias("_total"),
        F.map_from_entries(F.collect_set(F.struct("_rank", "_v"))).alias("_values"))

    def interpolate(q: float) -> Column:
        position = F.lit(q) * (F.col("_total") - 1)
        low, high = F.floor(position), F.ceil(position)
        share = position - low
        at = F.col("_values")
        # On a rank the value itself: a share of zero of an infinite one would be NaN.
        return F.when(low == high, F.element_at(at, low)).otherwise(
            F.element_at(at, low) * (F.lit(1.0) - share) + F.element_at(at, high) * share)

    return result.select(*[F.col("_key")[k].alias(k) for k in keys],
                         *[interpolate(q).alias(name) for name, q in quantiles.items()])
