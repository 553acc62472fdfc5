"""What the classifiers share: a bounded labelled sample, folds, and isotonic calibration."""

from __future__ import annotations

import math

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .prefix import hash_order

#: At most about so many labelled rows are used for a fit; of more, a share by hash.
SAMPLE_ROWS = 20_000
#: Share of the sample that only calibrates.
CALIBRATION = 0.3
ORDER_SHARE, ORDER_SCALE = 0.01, 20.0


def held_out(modulus: int, remainder: int) -> Column:
    """Whether the row's labels are kept from learning. A null doc_id counts as text ''."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == remainder


def training_rows(docs: DataFrame, labels: DataFrame, label: str, withheld: Column,
                  scratch: Scratch, rows: int = SAMPLE_ROWS) -> DataFrame | None:
    """``(text, label, calibrates)`` of the labelled sample; None unless both labels occur among
    the documents.

    Rows with a null doc_id or label don't teach; a doc_id labelled twice takes the larger
    label."""
    usable = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~withheld)
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    n, ones = usable.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not ones or ones == n:
        return None
    place = hash_order(F.lit("sample"), F.col("doc_id")) / F.lit(float(1 << 60))
    share = min(1.0, rows / n)
    sample = usable.withColumn("place", place / share).where(F.col("place") < 1.0)
    # The sample is bounded by ``rows``, about 16 bytes each.
    kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(sample), "doc_id").select(
            "text", "label", (F.col("place") < CALIBRATION).alias("calibrates")).dropDuplicates(
                ["text", "label"])  # copies would count as independent evidence
    training = scratch.keep(kept, "training")
    return training if training.agg(F.count_distinct("label")).first()[0] == 2 else None


def calibrated(scored: DataFrame, training: DataFrame, feature: str) -> DataFrame:
    """``scored`` with ``score``, the isotonic regression of the label on ``feature`` over the
    calibrating rows of ``training``. Without calibrating rows all training rows calibrate."""
    fold = training.where("calibrates")
    fold = fold if fold.head(1) else training
    model = IsotonicRegression(featuresCol=feature, labelCol="label", predictionCol="raw_score").fit(
        fold.select(feature, F.col("label").cast("double").alias("label")).coalesce(4))
    # Isotonic regression is flat in steps; a small share of the feature orders within them.
    order = 0.5 + F.atan(F.col(feature) * ORDER_SCALE) / F.lit(math.pi)
    return model.transform(scored).withColumn("score", F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), F.col("raw_score") * (1 - ORDER_SHARE) + order * ORDER_SHARE)))


def with_decision(scored: DataFrame, modulus: int, remainder: int, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out(modulus, remainder).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
