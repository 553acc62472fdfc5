"""Mixing sources to target weights by a time-varying curriculum.

Every source gets a target in words and a schedule, its relative weight at each moment of
the training, time running from 0 to 1. The schedule's integral, scaled to the target, is
the source's cumulative demand. The documents of a source stand in a fixed hash order, pass
after pass; inverting the demand at the middle of a document's words gives the time at which
this copy is trained on. Copies beyond the target are not taken. Sorting all copies by time,
over range partitions, mixes the sources as the schedules ask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, apart, packed, text_of, unpacked
from .prefix import hash_order, running_total

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
# Schedules by weight class: (time, relative weight) knots, linear in between. Heavy
# sources fade, light ones grow; only the shape counts, the target sets the amount.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def doc_size() -> Column:
    return F.regexp_count(text_of(), F.lit(WORD)).cast("bigint")


def source_key() -> Column:
    """The source as a text that is never null; null sources sort last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(
        F.concat(F.lit("0"), F.col("source")))


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   most: float = MAX_REPEATS) -> DataFrame:
    """``(key, source_size)`` rows with weight class and target.

    Sources in code point order take the weights in turn and share ``share`` of all words.
    No target exceeds ``most`` times its source; what that leaves over is shared again by
    weight. In the order of cap per weight the capped sources come first: a source is
    capped if it would be at the level that all before it, capped, leave to the rest.
    There is one row per source, so the windows hold no more than that.
    """
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("klass") + 1).cast("int"))
    ranked = (totals.withColumn("klass", rank % len(weights)).withColumn("weight", weight)
              .withColumn("cap", F.lit(float(most)) * F.col("source_size")))
    ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "key")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    leveled = (ranked
               .withColumn("wanted", F.least(F.lit(float(share)), F.lit(float(most)))
                           * F.sum("source_size").over(everything))
               .withColumn("level", (F.col("wanted") - F.coalesce(
                   F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
               .withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
               .withColumn("last_level", F.min_by("level", F.when(
                   ~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "key")))
                   .over(everything)))
    return leveled.select("key", "klass", "source_size", F.when(F.col("capped"), F.col("cap"))
                          .otherwise(F.col("last_level") * F.col("weight")).alias("target"))


def _areas(knots) -> list[float]:
    """Integral of a schedule up to each knot."""
    total, out = 0.0, [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        total += (t1 - t0) * (w0 + w1) / 2
        out.append(total)
    return out


def time_of(fraction: Column, knots) -> Column:
    """The time at which a schedule has given out ``fraction`` of its whole."""
    areas = _areas(knots)
    wanted = fraction * F.lit(areas[-1])
    time = F.lit(float(knots[-1][0]))
    for (t0, w0), (t1, w1), begin, end in reversed(
            list(zip(knots, knots[1:], areas, areas[1:]))):
        slope, rest = (w1 - w0) / (t1 - t0), wanted - F.lit(begin)
        if abs(slope) < 1e-12:
            inside = rest / F.lit(w0 or 1.0)
        else:
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * slope * rest))
            inside = (root - F.lit(w0)) / F.lit(slope)
        time = F.when(wanted <= F.lit(end), F.lit(t0) + inside).otherwise(time)
    return time


def assign(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MAX_REPEATS,
           schedules=SCHEDULES) -> DataFrame:
    """Rows of ``docs`` (with ``doc_id``, ``text``, ``source``) with ``size``,
    ``source_size``, ``target`` and ``positions``, the sorted training times in [0, 1] at
    which the document is used, at most ``most`` of them.

    The hash order is that of the doc_id, then size; a null source is a source, a null text
    has size 0, null ids are equal. Rows equal in all of this may swap their positions.
    The largest source is cut into bins by its hash order, so no task holds a source.
    Columns of ``docs`` other than the ones used are dropped.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.keep(docs.select(
        "doc_id", "source", source_key().alias("key"), doc_size().alias("size"),
        hash_order(F.col("doc_id")).alias("order")), "sizes")
    return _assign(sized, weights, share, most, schedules)


def _assign(sized: DataFrame, weights, share, most, schedules) -> DataFrame:
    totals = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, most)
    placed = running_total(sized, ["key"], ["order", "size"], "size", sized.count()).join(
        targets, "key")
    middle = F.col("before") + F.col("size") / 2
    times = []
    for copy in range(most):
        at = middle + copy * F.col("source_size")
        part = F.when(F.col("target") > 0, at / F.col("target")).otherwise(F.lit(0.0))
        time = F.lit(None).cast("double")
        for klass in range(len(weights)):
            time = F.when(F.col("klass") == klass,
                          time_of(part, schedules[klass % len(schedules)])).otherwise(time)
        times.append(F.when(at <= F.col("target"), time))
    return placed.withColumn("positions", F.array_compact(F.array(*times))).drop(
        "key", "klass", "before")


def _taken(docs: DataFrame, **options) -> DataFrame:
    """``doc`` and ``text``, the packed columns of ``docs``, and ``position`` of each copy."""
    # Numbering and join use the same three columns: the texts are shuffled once for both.
    docs = apart(docs, spark_sql_requireAllClusterKeysForCoPartition="false")
    scratch = Scratch(docs.sparkSession)
    key = [F.coalesce(F.col("doc_id"), F.lit(-1)).alias("id"), source_key().alias("key")]
    same = Window.partitionBy("id", "key", "size").orderBy("tie")
    rows = docs.select(packed(docs), "text", *key, doc_size().alias("size"), F.lit(0).alias("tie"))
    placed = scratch.keep(assign(docs, **options).where(F.size("positions") > 0), "placed")
    slots = placed.select(*key, "size", "positions", F.get("positions", F.lit(0)).alias("tie"))
    slots = slots.withColumn("n", F.row_number().over(same))
    rows = rows.withColumn("n", F.row_number().over(same))
    taken = rows.join(slots.drop("tie").hint("merge"), ["id", "key", "size", "n"]).select(
        "doc", "text", F.explode("positions").alias("position"))
    return taken.repartitionByRange("position").sortWithinPartitions("position")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each copy taken, with all columns of ``docs``, whatever their
    names, range-sorted by its training position.

    Rows are matched to their positions by doc_id, source and size; rows that agree in these
    three are dealt their positions by number, so no copy is lost or made up. Nulls, repeated
    rows and empty tables as in ``assign``."""
    return _taken(docs, **options).select(*unpacked(docs))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """``mixed`` with ``train_position``; an own column of that name is replaced."""
    kept = docs.drop("train_position")
    return _taken(kept, **options).select(*unpacked(kept), F.col("position").alias("train_position"))


def mix_digest(docs: DataFrame) -> DataFrame:
    first = F.get("positions", F.lit(0))
    spread = F.coalesce(first, 2 + F.col("order") / F.lit(float(1 << 60)))
    return (assign(docs).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"),
        (F.col("size") * F.size("positions")).cast("bigint").alias("taken"),
        F.round(first, 9).alias("first_position"), spread.alias("_at"))
        .repartitionByRange("_at").sortWithinPartitions("_at").drop("_at"))
