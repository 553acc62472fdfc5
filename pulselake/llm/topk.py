"""Exact top-k by inner product over a bit-sliced index.

Candidates are dealt into blocks. Per block and dimension the quantised components, less the
dimension's minimum, are stored as bit slices: one bitmap for each binary place. A query's
scores are a weighted sum of its block's dimensions. Per binary place all slices that count
there (a slice counts where the weight has a bit; for a negative weight its complement does)
are added with bitmap arithmetic: full adders turn three bitmaps of one place into a sum and
a carry, for all rows at once. From the most significant slice of the scores downward the k
best rows are then selected; rows that tie at the boundary are resolved by their exact scores
and ids. The best of all blocks are merged per query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

TOP = 20
SCALE = 64
#: Candidates in a block of the index, and queries that one task looks up in a block.
BLOCK, QUERIES = 65_536, 512
#: Queries are the rows whose id this divides.
EVERY = 20
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null unless all are finite numbers."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(v, lambda x: F.floor(x * float(scale)).cast("bigint")))


# --- bitmaps ---------------------------------------------------------------------------

def packed(values: np.ndarray) -> tuple[str, bytes]:
    """The values in the smallest integer type that holds them."""
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if not values.size or (
        np.iinfo(t).min <= values.min() and values.max() <= np.iinfo(t).max))
    return kind, values.astype(kind).tobytes()


def slices_of(values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Minimum and bit slices (rows of 64-bit words) of each column of non-negative rest."""
    low = values.min(axis=0)
    rest = (values - low).astype(np.uint64)
    width = max(1, int(rest.max()).bit_length())
    words = -(-len(values) // 64)
    out = []
    for place in range(width):
        bits = np.zeros((values.shape[1], words * 64), np.uint8)
        bits[:, :len(values)] = ((rest >> np.uint64(place)) & np.uint64(1)).T
        out.append(np.packbits(bits, axis=1, bitorder="little").view("<u8"))
    return low, out


def add_slices(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """The bit slices of the sum of all bitmaps, listed by binary place."""
    out, place = [], 0
    while any(p >= place and maps for p, maps in columns.items()):
        parts = columns.pop(place, [])
        stack = np.concatenate(parts) if parts else np.zeros((1, words), np.uint64)
        carries = []
        while len(stack) > 1:
            third = len(stack) // 3
            if third:
                a, b, c = stack[:third], stack[third:2 * third], stack[2 * third:3 * third]
                half = a ^ b
                carries.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * third:]])
            else:  # two are left
                carries.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
        out.append(stack[0])
        if carries:
            columns.setdefault(place + 1, []).append(np.concatenate(carries))
        place += 1
    return out


def score_slices(weights: np.ndarray, slices: list[np.ndarray]) -> list[np.ndarray]:
    """Bit slices of the scores, up to a constant that all rows share."""
    columns: dict[int, list[np.ndarray]] = {}
    size = np.abs(weights)
    negative = weights < 0
    for bit in range(int(size.max()).bit_length()):
        used = (size >> bit) & 1 == 1
        plus, minus = used & ~negative, used & negative
        for place, maps in enumerate(slices):
            group = columns.setdefault(place + bit, [])
            if plus.any():
                group.append(maps[plus])
            if minus.any():
                group.append(maps[minus] ^ _FULL)
    return add_slices(columns, slices[0].shape[1])


def select_top(scores: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best scores and of all that tie with the last of them."""
    sure, open_ = np.zeros_like(valid), valid
    for bits in reversed(scores):
        high = open_ & bits
        n = int(np.bitwise_count(sure | high).sum())
        if n > k:
            open_ = high
        else:
            sure = sure | high
            open_ = open_ & ~bits
            if n == k:
                open_ = np.zeros_like(valid)
                break
    found = np.unpackbits((sure | open_).view(np.uint8), bitorder="little")
    return np.flatnonzero(found)


# --- Spark -----------------------------------------------------------------------------

def build_index(rows: DataFrame, blocks: int, scratch: Scratch) -> DataFrame:
    """A row per block: ids, quantised vectors and bit slices of its candidates ``(id, q)``."""
    placed = scratch.keep(rows.withColumn("d", F.size("q")).withColumn("block", F.pmod(
        F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")), "placed")

    def run(table: pa.Table) -> pa.Table:
        values = _matrix(table.column("q").combine_chunks())
        low, slices = slices_of(values) if values.shape[1] else (values[:0], [])
        kind, rows_ = packed(values)
        return pa.table({
            "d": [values.shape[1]], "block": [table.column("block")[0].as_py()],
            "ids": [table.column("id").to_numpy().astype("<i8").tobytes()],
            "kind": [kind], "rows": [rows_], "places": [len(slices)],
            "slices": [b"".join(s.tobytes() for s in slices)]},
            schema=pa.schema([("d", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()),
                              ("kind", pa.string()), ("rows", pa.binary()), ("places", pa.int32()), ("slices", pa.binary())]))

    index = scratch.keep(placed.groupBy("d", "block").applyInArrow(
        run, "d int, block int, ids binary, kind string, rows binary, places int, slices binary"), "index")
    scratch.drop(placed)
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(queries: DataFrame, rows: DataFrame, k: int = TOP) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k best rows of each query.

    Both have ``id`` and ``q``, an array of integers; a query's own id is no candidate, and
    only equally long vectors are compared. Rows with a null id or q take no part. Equal
    scores go by smaller id. Repeated rows are candidates each; a repeated query is answered
    once. Scores must fit into 62 bits; a search in which they may not is refused.
    """
    scratch = Scratch(rows.sparkSession)
    usable = scratch.keep(rows.where("id is not null and q is not null").select("id", "q"), "rows")
    asked = scratch.keep(queries.where("id is not null and q is not null and size(q) > 0")
                         .select("id", "q").dropDuplicates(["id"]), "queries")
    n, m = usable.count(), asked.count()
    blocks, groups = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(m / QUERIES))
    index = build_index(usable.where("size(q) > 0"), blocks, scratch)
    # Every block meets every group of queries: the stated query set against all rows.
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = (asked.withColumn("d", F.size("q"))
             .withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def run(held: pa.Table, wanted: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if held.num_rows and wanted.num_rows:
            d = held.column("d")[0].as_py()
            ids = np.frombuffer(held.column("ids")[0].as_py(), "<i8")
            values = np.frombuffer(held.column("rows")[0].as_py(),
                                   held.column("kind")[0].as_py()).reshape(-1, d)
            places = held.column("places")[0].as_py()
            slices = list(np.frombuffer(held.column("slices")[0].as_py(), "<u8").reshape(places, d, -1))
            valid = np.packbits(np.arange(slices[0].shape[1] * 64) < len(ids),
                                bitorder="little").view("<u8")
            weights = _matrix(wanted.column("q").combine_chunks())
            largest = float(np.abs(weights.astype(float)).max()) * float(np.abs(values.astype(float)).max())
            if largest * d >= 2.0 ** 61:
                raise ValueError("scores do not fit into 62 bits")
            for query, weight in zip(wanted.column("id").to_pylist(), weights):
                # One more than k for each row of the query's own id in the block.
                own = int((ids == query).sum())
                if weight.any():
                    rows_ = select_top(score_slices(weight, slices), valid, k + own)
                else:
                    rows_ = np.arange(len(ids))
                rows_ = rows_[ids[rows_] != query]
                score = values[rows_].astype(np.int64) @ weight
                order = np.lexsort((ids[rows_], -score))[:k]
                out["query_id"] += [query] * len(order)
                out["vec_id"] += ids[rows_][order].tolist()
                out["score"] += score[order].tolist()
        return pa.table(out, schema=pa.schema([(c, pa.int64()) for c in out]))

    keys = ["d", "block", "part"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def topk_digest(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"),
                          quantised("embedding").alias("q"))
    return search(rows.where(F.col("id") % EVERY == 0), rows)
