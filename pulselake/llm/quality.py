"""Quality by compression: a text is good if a dictionary of good texts packs it better.

Two zstandard dictionaries are built from pieces of the labelled good and bad texts. Every
whole text is cut into pieces, so that a dictionary keeps its weight on long texts; all
pieces are compressed with both. The difference of the compressed sizes per byte of text is
calibrated by isotonic regression on rows that the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import moved
from .common import Scratch, apart, small_batches
from .learning import calibrated, training_rows, with_decision, held_out
from .prefix import hash_order

PIECE, DICTIONARY, LEVEL = 512, 32_768, 3
#: Pieces of each class that a dictionary is built from, at most about so many.
PIECES = 4_000
THRESHOLD = 0.3
PRIOR_BYTES = 256


def pieces(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few or too uniform samples, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def sample_pieces(training: DataFrame, label: int) -> list[bytes]:
    """A share by hash of the pieces of one class, at most about ``PIECES``."""
    rows = training.where((F.col("label") == label) & ~F.col("calibrates"))
    cut = rows.select(F.explode(F.transform(
        F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / PIECE).cast("int")),
        lambda i: F.substring("text", i * PIECE + 1, F.lit(PIECE)))).alias("piece")).where(
            F.length("piece") > 0)
    n = rows.agg(F.sum(F.ceil(F.char_length("text") / PIECE))).first()[0] or 0
    place = hash_order(F.col("piece")) / F.lit(float(1 << 60))
    chosen = cut.where(place < PIECES / max(n, 1)).orderBy(F.md5("piece")).limit(2 * PIECES)
    return [row.piece.encode("utf-8", "surrogatepass") for row in chosen.collect()]


def packed_sizes(docs: DataFrame, good: bytes, bad: bytes, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, ``bytes`` of the whole text, and ``gain``: how many bytes smaller it
    gets with the good dictionary than with the bad one."""
    small_batches(docs.sparkSession, 2000)
    rows = docs.select(*keep, "text")
    schema = rows.drop("text").withColumns({"gain": F.lit(0.0), "bytes": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = []
        for raw in (good, bad):
            data = zstandard.ZstdCompressionDict(raw)
            data.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False).compress)
        by_good, by_bad = packers
        for batch in batches:
            gains, sizes = [], []
            for text in batch.column(len(keep)).to_pylist():
                cut = pieces(text or "")
                gains.append(float(sum(len(by_bad(p)) - len(by_good(p)) for p in cut)))
                sizes.append(float(sum(map(len, cut))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(gains), pa.array(sizes)],
                names=[*keep, "gain", "bytes"])

    return rows.mapInArrow(run, schema)


def difference(usual: float) -> Column:
    """The gain per byte. ``PRIOR_BYTES`` bytes of the usual gain are added to each text, since
    a few words say little: a short text is judged nearly, an empty one wholly as usual."""
    return (F.col("gain") + PRIOR_BYTES * usual) / (F.col("bytes") + PRIOR_BYTES)


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0,
                   threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``.

    Null and empty texts have the usual difference and the score that goes with it. Unless both
    labels occur among the learnt rows, the score is 1 throughout: nothing is known to be
    bad. Repeated rows are scored alike, further columns dropped.
    """
    docs = apart(docs.select("doc_id", "text"))
    labels = moved(labels, docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    training = training_rows(docs, labels, "quality", held_out(modulus, remainder), scratch)
    if training is None:
        return with_decision(docs.withColumn("score", F.lit(1.0)), modulus, remainder, threshold)
    good, bad = dictionary(sample_pieces(training, 1)), dictionary(sample_pieces(training, 0))
    measured = scratch.keep(packed_sizes(training, good, bad, ["label", "calibrates"]), "measured")
    totals = measured.agg(F.sum("gain"), F.sum("bytes")).first()
    per_byte = difference(totals[0] / max(1.0, totals[1])).alias("difference")
    scored = calibrated(packed_sizes(docs, good, bad, ["doc_id"]).select("doc_id", per_byte),
                        measured.select("label", "calibrates", per_byte), "difference")
    return with_decision(scored, modulus, remainder, threshold)
