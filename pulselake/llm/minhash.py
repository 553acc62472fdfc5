"""MinHash near-duplicates with sequential Bayesian verification.

1. Documents with the same word sequence are one class, with an id of its own; the row of the
   smallest doc_id stands for it.
2. Signatures are cut into bands; documents that share a band are candidates. In each bucket
   every member is paired with the one that meets most others, the leader.
3. Pairs are verified in batches of hashes. After each batch, given the matches so far, the
   posterior probability that the similarity reaches the threshold is known (uniform prior);
   pairs for which it is below ``MISS`` are dropped.
4. Survivors are compared exactly, on the full shingle sets of their whole texts.
5. Links give components. Documents with the same leader that are still in different
   components are all compared with each other, in tiles of two blocks: by their signatures,
   and, where both were compared exactly with the leader, by what they keep of its shingles
   (a bitmap) and by the hashes of their other shingles, which bound their intersection from
   above, as a rule to the exact number. What is left goes through 4. So a bucket of thousands
   of near copies costs one pair each, and still no candidate pair is lost but those inside
   one component, which could not change the result.

Joins carry a merge hint where one side is small on small inputs only: a plan that holds at
every size is shuffled alike at every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, apart, packed, small_batches, unpacked
from ..session import moved
from .components import connected_components

#: Words of a shingle, and the least similarity in percent of intersection over union.
WORDS, PERCENT = 5, 80
#: Bands of ``ROWS`` hashes: a pair at similarity 0.8 shares none with probability 5e-5.
BANDS, ROWS = 25, 5
HASHES = 128
#: Hashes per verification batch, and the posterior below which a pair is dropped.
BATCH, MISS = 32, 1e-6
#: Documents in one block of a tile, and about the most bytes of them.
BLOCK, BLOCK_BYTES = 1024, 32 << 20

_RANDOM = np.random.default_rng(20240229)
_MULTIPLY = _RANDOM.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
_XOR = _RANDOM.integers(0, 1 << 32, HASHES, np.uint32)
_BLOCK = 2048


def words_of(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_codes(words: list[bytes], size: int) -> tuple[np.ndarray, list[bytes]]:
    """Distinct shingles as rows of word numbers, and the words by number; fewer words than
    ``size`` make one shingle."""
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    size = min(size, len(words))
    rows = np.lib.stride_tricks.sliding_window_view(codes, size)
    if size == 1:
        return np.unique(rows, axis=0), list(number)
    # Number the distinct pairs, then pairs of those with the next word, and so on: exact.
    key = rows[:, 0]
    for column in range(1, size):
        key = key * len(number) + rows[:, column]
        if column < size - 1 and len(number) * (int(key.max()) + 1) > 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    first = np.unique(key, return_index=True)[1]
    return rows[first], list(number)


def signature(words: list[bytes], size: int) -> tuple[int, bytes]:
    """Size of the shingle set, and its minimum under each hash."""
    rows, known = shingle_codes(words, size)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    mixed = np.zeros(len(rows), np.uint64)
    for column in range(rows.shape[1]):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashed[rows[:, column]]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    short = (mixed >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), _BLOCK):
        block = (short[start:start + _BLOCK, None] ^ _XOR) * _MULTIPLY
        np.minimum(least, block.min(axis=0), out=least)
    return len(rows), least.astype("<u4").tobytes()


def text_key() -> Column:
    """Tells the texts of a doc_id apart; a null text from an empty one, too."""
    return F.coalesce(F.md5("text"), F.lit("")).alias("text_key")


def sign(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_shingles``, ``key`` (of the word sequence; null without
    words) and ``sig`` of every row."""
    small_batches(docs.sparkSession, 2000)
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("n_shingles", pa.int64()),
                        ("key", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, sigs = [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text or "")
                count, sig = signature(words, size) if words else (0, None)
                counts.append(count)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sigs.append(sig)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()),
                                              pa.array(counts, pa.int64()),
                                              pa.array(keys, pa.binary()),
                                              pa.array(sigs, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), text_key(), "text").mapInArrow(
        run, "doc_id bigint, text_key string, n_shingles bigint, key binary, sig binary")


def least_matches(seen: int, threshold: float, miss: float) -> int:
    """The fewest matches among ``seen`` hashes that keep a pair. With a uniform prior the
    posterior that the similarity reaches t, given m matches of n, is P(Bin(n+1, t) <= m)."""
    total, n = 0.0, seen + 1
    for m in range(seen + 1):
        total += math.comb(n, m) * threshold ** m * (1 - threshold) ** (n - m)
        if total >= miss:
            return m
    return seen


def _bounds(percent: int, miss: float) -> list[tuple[int, int]]:
    return [(n, least_matches(n, percent / 100, miss)) for n in range(BATCH, HASHES + 1, BATCH)]


def _alive(left: np.ndarray, right: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """The rows of two arrays of signatures that no batch rules out."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for seen, least in bounds:
        part = slice(seen - BATCH, seen)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


def prune(pairs: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """The pairs ``(a, b)`` of ``(a, b, sig_a, sig_b)`` that the signatures don't rule out."""
    bounds = _bounds(percent, miss)
    small_batches(pairs.sparkSession, 2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive = _alive(_signatures(batch.column("sig_a")), _signatures(batch.column("sig_b")),
                           bounds)
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint")


def leader_tiles(members: DataFrame) -> DataFrame:
    """A row of ``members`` for each tile ``(a, i, j)``, i <= j, that its block is in."""
    weight = F.count(F.lit(1)) / BLOCK + F.sum(F.coalesce(F.length("shape"), F.lit(0))) / BLOCK_BYTES
    blocks = members.groupBy("a").agg(F.ceil(weight).cast("int").alias("of"))
    rows = members.join(blocks.hint("merge"), "a").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda k: F.struct(
        F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    return rows.withColumn("t", F.explode(other)).select(*members.columns, "block", "t.i", "t.j")


class Shapes:
    """What documents keep of a leader's shingles, and the hashes of their other ones."""

    def __init__(self, shapes: list[bytes | None], kept: list[int | None]):
        self.known = np.array([s is not None for s in shapes])
        width = next((k for k in kept if k is not None), 0)
        self.bits = np.zeros((len(shapes), width), np.uint8)
        self.others = [np.zeros(0, np.uint64)] * len(shapes)
        for row, shape in enumerate(shapes):
            if shape is not None:
                self.bits[row] = np.frombuffer(shape, np.uint8, width)
                self.others[row] = np.frombuffer(shape, "<u8", -1, width)
        self.more = np.array([len(o) for o in self.others], np.int64)

    def at_most(self, x: int, y: np.ndarray, needed: np.ndarray) -> np.ndarray:
        """Upper bound of the intersections of ``x`` with ``y``, all of them known; worked out
        to the end only where it may reach ``needed``."""
        most = np.bitwise_count(self.bits[y] & self.bits[x]).sum(axis=1).astype(np.int64)
        least = np.minimum(self.more[y], self.more[x])
        open_ = np.flatnonzero((most + least >= needed) & (least > 0))
        if len(open_):
            parts = [self.others[k] for k in y[open_].tolist()]
            hit = np.isin(np.concatenate(parts), self.others[x])
            ends = np.cumsum([len(p) for p in parts])
            total = np.concatenate([[0], np.cumsum(hit)])
            least[open_] = total[ends] - total[np.concatenate([[0], ends[:-1]])]
        return most + least


def compare_tiles(tiled: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """Pairs ``(a, b)`` of a tile's documents of different ``label`` that neither the sizes,
    nor the signatures, nor what is known of them by way of the leader rules out."""
    bounds = _bounds(percent, miss)

    def run(table: pa.Table) -> pa.Table:
        ids, label, n, block = (table.column(c).to_numpy() for c in ("id", "label", "n", "block"))
        sig = _signatures(table.column("sig"))
        shapes = Shapes(table.column("shape").to_pylist(), table.column("width").to_pylist())
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found: list[np.ndarray] = []
        for x in left.tolist():
            y = right[(label[right] != label[x]) & ((ids[right] > ids[x]) | (i != j))]
            # 100 * both >= percent * union, solved for the intersection.
            needed = -(-percent * (n[y] + n[x]) // (100 + percent))
            fits = np.minimum(n[y], n[x]) >= needed
            y, needed = y[fits], needed[fits]
            if len(y):
                alive = _alive(np.broadcast_to(sig[x], (len(y), HASHES)), sig[y], bounds)
                y, needed = y[alive], needed[alive]
            if len(y) and shapes.known[x]:
                known = shapes.known[y]
                most = needed.copy()
                most[known] = shapes.at_most(x, y[known], needed[known])
                y = y[most >= needed]
            if len(y):
                found.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return tiled.groupBy("a", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _hashes(shingles: set) -> np.ndarray:
    joined = map(b"\0".join, shingles)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, joined), np.uint64, len(shingles))


def confirm(pairs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(a, b, links, width, shape)`` of ``(a, b, text_a, text_b)``: whether the full sets
    link, and b as seen from a: ``width`` bytes of bitmap, then hashes (see ``Shapes``)."""
    small_batches(pairs.sparkSession, 128)

    def shingles(text: str) -> set:
        words = words_of(text)
        n = min(size, len(words))
        return set(zip(*[words[i:len(words) - n + 1 + i] for i in range(n)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known, order = None, set(), []
        for batch in batches:
            links, widths, shapes = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")]
            for a, text_a, text_b in zip(*columns):
                if last != (a, text_a):
                    last, known = (a, text_a), shingles(text_a)
                    order = sorted(known)
                other = shingles(text_b)
                both = len(known & other)
                links.append(100 * both >= percent * (len(known) + len(other) - both))
                bits = np.packbits(np.fromiter((s in other for s in order), bool, len(order)))
                widths.append(len(bits))
                shapes.append(bits.tobytes() + _hashes(other - known).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(links, pa.bool_()),
                 pa.array(widths, pa.int32()), pa.array(shapes, pa.binary())],
                names=["a", "b", "links", "width", "shape"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(
        run, "a bigint, b bigint, links boolean, width int, shape binary")


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` with ``column`` of both documents, from ``table`` by id."""
    for side in ("b", "a"):  # at last by a, so that pairs of one a follow each other
        pairs = pairs.join(table.select(F.col("id").alias(side), F.col(column).alias(
            f"{column}_{side}")).hint("merge"), side)
    return pairs


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs``.

    Two documents link if 100 * intersection >= ``percent`` * union of their sets of
    ``size``-word shingles. ``component_id`` is the smallest doc_id reachable. Null and empty
    texts have no shingles and link with nothing; rows with a null doc_id link with nothing
    either, have a null component and are kept. Rows that repeat a doc_id give a row each; its
    different texts are documents of their own. Of a component the rows of the smallest
    (doc_id, md5 of the text) are kept. Other columns are ignored.
    """
    return near_duplicate_texts(docs, size, percent).drop("text_key")


def near_duplicate_texts(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``near_duplicates`` with the ``text_key`` of each row."""
    docs = apart(docs.select("doc_id", "text"))
    scratch = Scratch(docs.sparkSession)
    signed = scratch.keep(sign(docs, size), "signed")
    named = signed.where("key is not null and doc_id is not null")
    classes = scratch.keep(named.groupBy("key").agg(F.min(F.struct("doc_id", "text_key")).alias(
        "first")).select("key", "first.*").withColumn("id", F.monotonically_increasing_id()), "classes")
    reps = scratch.keep(
        named.withColumnRenamed("n_shingles", "n")
        .join(classes.hint("merge"), ["key", "doc_id", "text_key"]).dropDuplicates(["id"])
        .select("id", "doc_id", "text_key", "n", "sig"), "reps")
    bands = reps.select("id", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(
            i, F.substring("sig", i * (4 * ROWS) + 1, F.lit(4 * ROWS))))).alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("z")).where("z > 1")
    shared = scratch.keep(bands.join(sizes.hint("merge"), "bucket"), "shared")
    # Who meets most others stands in the middle of them, and leads its buckets.
    meets = shared.groupBy("id").agg(F.sum("z").alias("meets"))
    leads = shared.join(meets.hint("merge"), "id").groupBy("bucket").agg(
        F.max(F.struct("meets", -F.col("id"))).alias("lead")).select(
        "bucket", (-F.col("lead.col2")).alias("a"))
    stars = scratch.keep(shared.join(leads.hint("merge"), "bucket").where("id != a").select(
        "a", F.col("id").alias("b")).distinct(), "stars")
    texts = scratch.keep(
        docs.select(F.col("doc_id").cast("bigint"), text_key(), "text").where("text is not null")
        .join(reps.select("id", "doc_id", "text_key").join(
            shared.select("id").distinct().hint("merge"), "id", "left_semi").hint("merge"),
            ["doc_id", "text_key"])
        .select("id", "text").dropDuplicates(["id"]), "texts")
    checked = scratch.keep(confirm(_with_both(prune(
        _with_both(stars, reps, "sig"), percent), texts, "text"), size, percent), "checked")
    found = scratch.keep(connected_components(checked.where("links").select("a", "b")), "components")
    labelled = stars.withColumnRenamed("b", "id").join(found.hint("merge"), "id", "left").withColumn(
        "label", F.coalesce("component", "id")).drop("component")
    # Pairs with the leader are done; what is left needs two others apart.
    mixed = labelled.groupBy("a").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("a")
    members = (labelled.join(mixed.hint("merge"), "a")
               .join(checked.select("a", F.col("b").alias("id"), "width", "shape").hint("merge"),
                     ["a", "id"], "left")
               .join(reps.select("id", "n", "sig").hint("merge"), "id"))
    rest = scratch.keep(compare_tiles(leader_tiles(members), percent).distinct(), "rest")
    more = scratch.keep(confirm(_with_both(rest, texts, "text"), size, percent).select(
        "a", "b", "links"), "more")
    joined = more.where("links").join(found.toDF("a", "x"), "a", "left").join(
        found.toDF("b", "y"), "b", "left").select(
        F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    bridges = connected_components(joined).toDF("component", "root")
    scratch.drop(shared, stars, texts, checked, rest, more)
    rooted = scratch.keep(classes.join(found, "id", "left").withColumn(
        "component", F.coalesce("component", "id")).join(bridges, "component", "left").select(
        "key", "doc_id", "text_key", F.coalesce("root", "component").alias("root")), "rooted")
    scratch.drop(classes)
    # Back from classes to doc_ids: a row for each component of several classes.
    least = scratch.keep(rooted.groupBy("root").agg(
        F.min(F.struct("doc_id", "text_key")).alias("least"), F.count(F.lit(1)).alias("z"))
        .where("z > 1").select("root", "least"), "least")
    final = rooted.join(least, "root", "left").select("key", F.coalesce(
        "least", F.struct("doc_id", "text_key")).alias("least"))
    kept = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))
    return (signed.select("doc_id", "text_key", "n_shingles", "key")
            .join(final.hint("merge"), "key", "left")
            .select("doc_id", "text_key", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id"))
                    .alias("component_id"), (F.col("doc_id").isNull() | F.coalesce(kept, F.lit(True))).alias("kept")))


def drop_near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all columns, whatever their names
    and types. Of rows that repeat doc_id (nulls are equal) and text, one, by the md5 of the rest."""
    dropped = moved(near_duplicate_texts(docs, size, percent), docs.sparkSession).where(~F.col("kept")).select(
        "doc_id", "text_key").distinct()
    rows = docs.select(F.col("doc_id").cast("bigint"), text_key(), packed(docs), "text")
    rest = F.md5(F.to_json("doc", {"ignoreNullFields": "false"}))
    return (rows.join(dropped, ["doc_id", "text_key"], "left_anti").groupBy("doc_id", "text_key")
            .agg(F.min_by(F.struct("doc", "text"), rest).alias("row")).select(
                F.col("row.doc"), F.col("row.text")).select(*unpacked(docs)))


def minhash_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, size=2)
