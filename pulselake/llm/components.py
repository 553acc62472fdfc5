"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join over the edges, written to the shared folder. A
step hangs every vertex's larger (then its smaller) neighbours onto the smallest one it
knows; the edges shrink to stars around the smallest id of each component in a logarithmic
number of rounds. No adjacency list is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u").where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` are directed from the larger id ``u`` to the smaller ``v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return (joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v"))).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)``, the smallest id reachable, for every id in ``edges`` (two long
    columns). Loops and repeated edges do no harm; ids without edges don't appear."""
    a, b = edges.columns
    scratch = Scratch(edges.sparkSession)
    now = scratch.keep(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        large = scratch.keep(_large_star(now), "large")
        after = scratch.keep(_small_star(large), "small")
        scratch.drop(now, large)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
