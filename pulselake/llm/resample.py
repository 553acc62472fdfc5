"""Importance resampling towards a target distribution, over hashed n-gram features.

Features are runs of words, hashed to buckets by CRC-32. A bucket's gain is the logarithm of how
much likelier it is in the target texts than in the documents; a document's weight is the mean
gain of its features. Adding Gumbel noise and taking the highest scores draws without
replacement in proportion to the weights.

The checksums of a piece of text are taken together: its features are grouped by length, the
distinct ones of a length stand in a matrix of bytes, a row each, all checksums advance by one
column at a time, and the results are scattered back. Features longer than ``WIDE`` bytes fall
into rows of that many bytes each, whose checksums are linked by the effect of ``WIDE`` zero bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, apart, small_batches, text_of

BUCKETS = 10_000
LONGEST_RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Words are runs of these bytes, once A-Z are lower-cased: digits, a-z, all beyond ASCII.
SPACE = 0x20
FOLDED = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F
               else SPACE for b in range(256))
WIDE = 256
#: Bytes of text, unless one document has more, and rows of a matrix that are worked on together.
PIECE_BYTES, MATRIX_ROWS = 4 << 20, 1 << 18


def _single_bytes() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1)
    return state


TABLE = _single_bytes()


def _advance(state: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """``state`` (a checksum per row) after the bytes of ``columns``, one column after the other."""
    for column in columns:
        state = TABLE[(state ^ column) & 255] ^ (state >> 8)
    return state


#: What ``WIDE`` zero bytes make of each of the four bytes of a state.
OVER_ZEROS = _advance((np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None])
                      .ravel(), np.zeros((WIDE, 1), np.uint8)).reshape(4, 256).astype(np.uint32)


def _distinct(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of row, and for every row which kind it is."""
    rows, width = matrix.shape
    words = np.zeros((rows, max(8, -(-width // 8) * 8)), np.uint8)
    words[:, :width] = matrix
    keys = words.view(np.uint64)
    if keys.shape[1] == 1:
        _, first, back = np.unique(keys[:, 0], return_index=True, return_inverse=True)
        return first, back
    order = np.lexsort(keys.T)
    new = np.r_[True, (keys[order[1:]] != keys[order[:-1]]).any(axis=1)]
    back = np.empty(rows, np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def _by_length(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States of the stretches of ``flat``, of at most ``WIDE`` bytes, each begun with its own ``state``
    (equal for equal bytes)."""
    out = state.copy()
    order = np.argsort(lengths, kind="stable")
    ends = np.flatnonzero(np.diff(lengths[order], append=-1)) + 1
    for begin, end in zip([0, *ends[:-1]], ends):
        length = int(lengths[order[begin]])
        for at in range(begin, end, MATRIX_ROWS):
            members = order[at:min(at + MATRIX_ROWS, end)]
            matrix = flat[starts[members, None] + np.arange(length)]
            first, back = _distinct(matrix)
            out[members] = _advance(state[members[first]], matrix[first].T)[back]
    return out


def checksums(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of the bytes ``flat``."""
    head = np.where(lengths > 0, (lengths - 1) % WIDE + 1, 0)
    fresh = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    out = _by_length(flat, starts, head, fresh)
    for i in np.flatnonzero(lengths > WIDE):
        rows = starts[i] + head[i] + WIDE * np.arange((lengths[i] - head[i]) // WIDE)
        state = int(out[i])
        for row in _by_length(flat, rows, np.full(len(rows), WIDE), np.zeros(len(rows), np.uint32)).tolist():
            state = row ^ int(OVER_ZEROS[0, state & 255] ^ OVER_ZEROS[1, state >> 8 & 255]
                              ^ OVER_ZEROS[2, state >> 16 & 255] ^ OVER_ZEROS[3, state >> 24])
        out[i] = state
    return ~out


def features(texts: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of words of each text; then of all features the text and the checksum."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]]
    data, offsets = np.frombuffer(FOLDED, np.uint8)[data], offsets - offsets[0]
    inside = data != SPACE
    bounds = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[bounds] = inside[bounds]
    last[bounds - 1] = inside[bounds - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    of = np.searchsorted(offsets, starts, "right") - 1
    # All words, one space after each.
    flat = np.full(int(lengths.sum()) + len(lengths), SPACE, np.uint8)
    flat[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = data[inside]
    starts = np.cumsum(lengths + 1) - lengths - 1
    words = np.bincount(of, minlength=len(texts))
    owner, found = [], []
    for run in range(1, longest + 1):
        whole = np.flatnonzero(of[run - 1:] == of[:len(of) - run + 1])
        end = starts[whole + run - 1] + lengths[whole + run - 1]
        owner.append(of[whole])
        found.append(checksums(flat, starts[whole], end - starts[whole]))
    return words, np.concatenate(owner), np.concatenate(found)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive texts of together at most ``PIECE_BYTES``, or one."""
    texts = texts.fill_null("")
    sizes = np.cumsum(pa.compute.binary_length(texts).to_numpy())
    begin = 0
    while begin < len(texts):
        limit = PIECE_BYTES + (sizes[begin - 1] if begin else 0)
        end = max(begin + 1, int(np.searchsorted(sizes, limit, "right")))
        yield begin, texts.slice(begin, end - begin)
        begin = end


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """``(bucket, n)``: the features of all rows' ``text``; a task sends a row per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, piece in _pieces(batch.column(0)):
                total += np.bincount(features(piece, longest)[2] % buckets, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    counted = texts.select(text_of()).mapInArrow(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, in thousandths of a nat, from the counts in documents and in the target."""
    s, t = source.astype(float), target.astype(float)
    n = len(s)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _collected(counts: DataFrame, buckets: int) -> np.ndarray:
    """At most one row per bucket."""
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST_RUN) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of every row of ``docs``."""
    kinds = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, piece in _pieces(batch.column(1)):
                words, owner, found = features(piece, longest)
                n = np.bincount(owner, minlength=len(piece))
                total = np.bincount(owner, gain[found % len(gain)], len(piece)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(piece)), pa.array(words), pa.array(n),
                     pa.array(total // np.maximum(n, 1))], names)

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(run, kinds)


def _noise(seed: int) -> Column:
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(
        F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_features``, ``weight``, ``score`` and
    ``rank`` among the drawn (null: not drawn), ``percent`` of the rows with ``least_words`` words.
    ``target`` needs ``text`` only.

    A null text has no features and weight 0, a null id sorts first and counts as ''. Rows that
    repeat a doc_id are rows of their own; those of equal score and id take their ranks in any
    order. Either table may be empty; other columns are dropped. A task works on ``PIECE_BYTES``
    of text or one document, and holds about twenty times its bytes.

    Scores are whole numbers within a few ten thousands of 0, as logarithms of counts are, so
    there are at most so many to add up in order; rows are only ranked among equal scores.
    """
    docs, target = apart(docs.select("doc_id", "text")), apart(target.select("text"))
    scratch = Scratch(docs.sparkSession)
    for frame in (docs, target):
        small_batches(frame.sparkSession, 2000)
    gain = gains(*[_collected(bucket_counts(t, buckets, longest), buckets) for t in (docs, target)])
    weighed = scratch.keep(weigh(docs, gain, longest).withColumn(
        "score", F.col("weight") + _noise(seed)), "weighed")
    can = (F.col("n_words") >= least_words).alias("can")
    drawn = weighed.where(can).count() * percent // 100
    earlier = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = weighed.where(can).groupBy("score").agg(F.count(F.lit(1)).alias("n")).select(
        "score", F.lit(True).alias("can"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    rank = F.col("ahead") + F.row_number().over(Window.partitionBy("score", "can").orderBy("doc_id"))
    return (weighed.withColumn("can", can).join(ahead.where(F.col("ahead") < drawn), ["score", "can"], "left")
            .withColumn("rank", rank.cast("bigint"))
            .select("doc_id", "n_features", "weight", "score",
                    F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")))
