"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors are one, with a count. All vectors are scaled to length one and turned into the
basis of their principal components, largest variance first. Two vectors with cosine c are
``sqrt(2 - 2c)`` apart, in every coordinate at most, so a grid of that width over the first
two coordinates tells which vectors may meet: those of a cell and of its neighbours. Cells
are cut into blocks; a tile compares two blocks. It adds up products of the leading
coordinates, a few at a time; what the rest can still add is bounded by the product of the
suffix norms, and pairs stop as soon as the cosine cannot be reached. The others are compared
exactly in double precision. A tile gives counts of links and a spanning forest of them, so
no pairs leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

COSINE = 0.98
#: Vectors in a block, and leading coordinates added at a time.
BLOCK, STEP = 1024, 8
#: Room for rounding in all bounds; the exact comparison has none.
ROOM = 1e-9


def usable(vector: str, label: str) -> Column:
    """Vectors that can link: not null, no null or non-finite component, not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & F.col(label).isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by the largest component first, against overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each number of dimensions the principal axes of all vectors, largest variance
    first, as columns. Tasks send sums, d * d + d + 1 numbers for each d; Spark adds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(0)
            sizes = np.asarray(lists.value_lengths())
            for d in np.unique(sizes).tolist():
                x = unit(_matrix(lists.filter(pa.array(sizes == d))))
                part = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                sums[d] = sums[d] + part if d in sums else part
        for d, values in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(values), pa.int32()),
                                              pa.array(np.arange(len(values)), pa.int32()),
                                              pa.array(values)], names=["d", "at", "value"])

    parts = vectors.select("vector").mapInArrow(run, "d int, at int, value double")
    rows = parts.groupBy("d", "at").agg(F.sum("value")).collect()
    sums: dict[int, np.ndarray] = {}
    for d, at, value in rows:
        sums.setdefault(d, np.zeros(1 + d + d * d))[at] = value
    axes = {}
    for d, values in sums.items():
        n, mean = values[0], values[1:1 + d] / values[0]
        spread, basis = np.linalg.eigh(values[1 + d:].reshape(d, d) / n - np.outer(mean, mean))
        axes[d] = basis[:, np.argsort(-spread)]
    return axes


def place(vectors: DataFrame, axes: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """Adds the grid cell ``cx, cy`` and the dimensions ``d``."""
    width = math.sqrt(max(0.0, 2 - 2 * cosine)) + ROOM
    names = vectors.columns
    kinds = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes) + ", d int, cx int, cy int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(names.index("vector"))
            sizes = np.asarray(lists.value_lengths()) if batch.num_rows else np.zeros(0, int)
            cells = np.zeros((batch.num_rows, 2), np.int32)
            for d in np.unique(sizes).tolist():
                some = sizes == d
                at = unit(_matrix(lists.filter(pa.array(some)))) @ axes[d][:, :2]
                cells[some, :at.shape[1]] = np.floor(at / width)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int32()), pa.array(cells[:, 0]),
                 pa.array(cells[:, 1])], names=[*names, "d", "cx", "cy"])

    return vectors.mapInArrow(run, kinds)


def tiles(placed: DataFrame) -> DataFrame:
    """A row for each tile a vector is in: the cell, the two blocks, and its side in it.

    Side 0 is the cell's own block ``i``; side 1 is its block ``j >= i``, or block ``j`` of a
    guest from the neighbour ``shift`` (1 to 4, so that each two cells meet once)."""
    cell = ["label", "d", "cx", "cy"]
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    shifts = F.array(*[F.struct(F.lit(k).alias("shift"), F.lit(x).alias("x"), F.lit(y).alias("y"))
                       for k, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (-1, 1)])])
    block = F.pmod(F.xxhash64("id"), F.col("own")).cast("int")
    rows = (placed.join(sizes.withColumnRenamed("blocks", "own"), cell)
            .withColumn("block", block).withColumn("s", F.explode(shifts))
            .withColumn("cx", F.col("cx") + F.col("s.x")).withColumn("cy", F.col("cy") + F.col("s.y")))
    hosted = rows.join(sizes, cell).withColumn("shift", F.col("s.shift"))  # the host cell exists
    guests = hosted.select(*cell, "shift", "blocks", "block", "own", "id", "n", "vector")
    mine = F.col("shift") == 0
    left = F.transform(F.sequence(F.col("block"), F.col("blocks") - 1), lambda j: F.struct(
        F.col("block").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    # As second block of its own cell: with every block before it.
    second = F.when(F.col("block") > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("block") - 1)), lambda i: F.struct(
            i.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")))).otherwise(F.array())
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(
        i.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")))
    own = guests.where(mine).select("*", F.explode(F.concat(left, second)).alias("t"))
    visiting = guests.where(~mine).select("*", F.explode(met).alias("t"))
    # The host's side of tiles with guests: once for each block of each neighbour that is there.
    there = guests.where(~mine).groupBy(*cell, "shift").agg(F.max("own").alias("guest_blocks"))
    hosts = guests.where(mine).drop("shift").join(there, cell).select(
        *cell, "shift", "blocks", "block", "own", "id", "n", "vector",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("guest_blocks") - 1), lambda j: F.struct(
            F.col("block").alias("i"), j.alias("j"), F.lit(0).alias("side")))).alias("t"))
    every = own.unionByName(visiting).unionByName(hosts)
    return every.select(*cell, "shift", "t.i", "t.j", "t.side", "id", "n", "vector")


def linked_pairs(left: np.ndarray, right: np.ndarray, axes: np.ndarray, cosine: float,
                 same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of two blocks whose cosine is at least ``cosine``."""
    unit_left, unit_right = unit(left), unit(right)
    a, b = unit_left @ axes, unit_right @ axes
    d = a.shape[1]
    products = a[:, :STEP] @ b[:, :STEP].T
    rest_a, rest_b = (np.sqrt(np.maximum((x[:, STEP:] ** 2).sum(axis=1), 0)) for x in (a, b))
    alive = products + np.outer(rest_a, rest_b) >= cosine - ROOM
    if same:
        alive = np.triu(alive, 1)
    i, j = np.nonzero(alive)
    sums = products[i, j]
    for start in range(STEP, d, STEP):
        sums = sums + np.einsum("ij,ij->i", a[i, start:start + STEP], b[j, start:start + STEP])
        rest = np.sqrt((a[:, start + STEP:] ** 2).sum(axis=1))[i] * np.sqrt(
            (b[:, start + STEP:] ** 2).sum(axis=1))[j]
        keep = sums + rest >= cosine - ROOM
        i, j, sums = i[keep], j[keep], sums[keep]
    dot = np.einsum("ij,ij->i", left[i], right[j])
    norms = np.sqrt((left[i] ** 2).sum(axis=1)) * np.sqrt((right[j] ** 2).sum(axis=1))
    plain = np.isfinite(dot) & np.isfinite(norms) & (norms > 1e-150)
    exact = np.where(plain, dot / np.where(plain, norms, 1.0),
                     np.einsum("ij,ij->i", unit_left[i], unit_right[j]))
    keep = exact >= cosine
    return i[keep], j[keep]


def forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest id each row of a tile is linked with, through links of the tile."""
    root = ids.copy()
    while len(i):
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (root == before).all():
            break
    return root


def compare_tiles(tiled: DataFrame, axes: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """``(id, links, root)``: links found in a tile, and the smallest id linked there."""
    keys = ["label", "d", "cx", "cy", "shift", "i", "j"]

    def run(table: pa.Table) -> pa.Table:
        d, shift = table.column("d")[0].as_py(), table.column("shift")[0].as_py()
        inside = shift == 0 and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        side = table.column("side").to_numpy()
        ids, counts = table.column("id").to_numpy(), table.column("n").to_numpy()
        rows = _matrix(table.column("vector").combine_chunks())
        first = np.flatnonzero(side == 0)
        other = first if inside else np.flatnonzero(side == 1)
        empty = np.zeros(0, np.int64)
        i, j = linked_pairs(rows[first], rows[other], axes[d], cosine, inside) \
            if len(first) and len(other) else (empty, empty)
        i, j = first[i], other[j]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i, counts[j])
        np.add.at(links, j, counts[i])
        root, some = forest(ids, i, j), links > 0
        return pa.table({"id": ids[some], "links": links[some], "root": root[some]})

    return tiled.groupBy(*keys).applyInArrow(run, "id bigint, links bigint, root bigint")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id",
                 vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors``.

    Only vectors with equal labels and equally many components are compared. Vectors that are
    null, zero or hold null or non-finite components, and those without label or id, link with
    nothing; without an id the component is null and the row is kept. Rows that repeat an id
    count as vectors of their own for ``n_links`` and are one for components. Other columns
    are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.keep(vectors.select(
        F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"),
        F.when(usable(vector, label), F.col(vector).cast("array<double>")).alias("vector")), "vectors")
    valid = rows.where("vector is not null and id is not null")
    distinct = scratch.keep(valid.groupBy("label", "vector").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "distinct")
    axes = principal_axes(distinct)
    placed = scratch.keep(place(distinct, axes, cosine), "placed")
    found = scratch.keep(compare_tiles(tiles(placed), axes, cosine), "found")
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    members = connected_components(found.select("id", "root"))
    summary = (distinct.select("label", "vector", "id", "n").join(counted, "id", "left")
               .join(members, "id", "left").select(
                   "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
                   F.coalesce("component", "id").alias("component")))
    return rows.join(summary, ["label", "vector"], "left").select(
        F.col("id").alias(key), F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0)))
        .otherwise(0).cast("bigint").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
