"""Sharding by balanced label propagation.

Linked documents (here: of equal text) should share a shard, and all shards should hold nearly
equally many bytes. The linked documents start in an order that keeps each group together, cut
into shards; so at first only groups at a cut lie in several. Then, round after round of joins,

* documents of a group that lies in several shards ask for one of their neighbours' shards: the
  one that holds most of the group of those that have room for the rest of it, or else any shard
  with room for all of it, or else the one that holds most. A group larger than a shard names as
  many of its shards as it needs,
* requests are added up for each pair of shards and granted under quotas: two shards may swap
  equal bytes, and beyond that a shard takes in what its capacity has room for and gives away
  what others can make up for,
* for what is still asked for, whole groups of the full shard go the other way, as many bytes
  as come in,
* within a pair of shards requests are granted in hash order, by running totals,

until the number of cuts stops falling. Documents of one group in one shard have the same
neighbours, so they ask and move as one piece; of a large group, as one piece per ``PART`` of a
shard. No piece is ever split and whole groups only move whole, so no round adds a cut.

Documents without links cut nothing wherever they lie: they fill the shards up to equal size.
All state lies in tables; only a number per shard comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .prefix import hash_order, running_total

SHARDS = 40
ROUNDS = 10
ROW_BYTES = 16
#: A group of more than this part of a shard is divided into pieces of that ``PART`` of it.
LARGE, PART = 8, 64
#: What shards may differ in for a group to stay whole: a part of a shard, or so many documents.
LEEWAY, LEEWAY_DOCS = 0.02, 5
PIECE = ["group", "start", "part"]


def doc_bytes() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("bigint")


class Limits:
    """How far shards may be filled: ``loads`` by shard, of linked documents only."""

    def __init__(self, loads: dict[int, float], shards: int, share: float, slack: float, alone: float):
        self.loads = [float(loads.get(s) or 0) for s in range(shards)]
        self.share = share
        self.room = [max(0.0, share + slack - load) for load in self.loads]
        self.free = [max(0.0, share - load) for load in self.loads]
        # Where shards may overfill, documents without links do not make up for all that leaves.
        self.spare = [max(0.0, load - (share - slack - alone / shards)) if slack > 0 else load for load in self.loads]

    def of(self, values: list[float], shard: Column) -> Column:
        return F.get(F.array(*map(F.lit, values)), shard)


def held_bytes(pieces: DataFrame) -> DataFrame:
    """``(group, shard, held, whole, n)``: bytes of a group in a shard and in all, its shards."""
    of_group = Window.partitionBy("group")
    return (pieces.groupBy("group", "shard").agg(F.sum("size").alias("held"))
            .withColumn("whole", F.sum("held").over(of_group))
            .withColumn("n", F.count(F.lit(1)).over(of_group)))


def _wishes(held: DataFrame, limits: Limits, turn: int) -> DataFrame:
    """``(group, targets)`` for the groups that lie in several shards."""
    room = limits.of(limits.room, F.col("shard"))
    order = [F.desc("held"), F.xxhash64("group", "shard", F.lit(turn))]
    before = Window.partitionBy("group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    named = held.where("n > 1").withColumn("earlier", F.coalesce(
        F.sum(F.col("held") + limits.of(limits.free, F.col("shard"))).over(before), F.lit(0.0)))
    single = F.col("whole") <= limits.share
    fits = F.col("held") + room >= F.col("whole")
    wide = F.filter(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(r).alias("r")) for s, r in enumerate(limits.room)]),
                    lambda x: x.r >= F.col("whole"))
    foreign = F.when((F.size(wide) > 0) & (F.col("whole") * LARGE <= limits.share),
                     F.get(wide, F.pmod(F.xxhash64("group", F.lit(turn)), F.size(wide)).cast("int")).s)
    rank = F.struct(-F.col("held"), order[1])
    own = (named.groupBy("group").agg(
        F.first("whole").alias("whole"),
        F.min_by("shard", F.when(fits, rank)).alias("fitting"), F.min_by("shard", rank).alias("most"),
        F.sort_array(F.collect_list(F.when(F.col("earlier") < F.col("whole"), F.col("shard")))).alias("several")))
    return own.select("group", F.when(single, F.array(F.coalesce("fitting", foreign, "most")))
                      .otherwise(F.col("several")).alias("targets"))


def _granted(asking: DataFrame, held: DataFrame, limits: Limits, turn: int, rows: int,
             scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The requests of ``asking`` (``group``, ``part``, ``src``, ``dst``, ``size``) that are granted, and
    whole groups that make room: both ``(group, part, src, dst)``, ``part`` null for whole groups."""
    asked = scratch.keep(asking.groupBy("src", "dst").agg(F.sum("size").alias("asked")), "asked")
    back = asked.toDF("dst", "src", "back")
    extra = F.col("asked") - F.col("swap")
    part = lambda limit, all_: F.when(F.col(all_) > 0, F.least(F.lit(1.0), limit / F.col(all_))).otherwise(0.0)
    # A row per pair of shards at most.
    quotas = scratch.keep(
        asked.join(back, ["src", "dst"], "left")
        .withColumn("swap", F.least("asked", F.coalesce("back", F.lit(0))))
        .withColumn("into", F.sum(extra).over(Window.partitionBy("dst")))
        .withColumn("out", F.sum(extra).over(Window.partitionBy("src")))
        .withColumn("quota", F.col("swap") + extra * F.least(
            part(limits.of(limits.room, F.col("dst")), "into"), part(limits.of(limits.spare, F.col("src")), "out")))
        .withColumn("unmet", F.col("asked") - F.col("quota"))
        .withColumn("end", F.sum("unmet").over(Window.partitionBy("dst").orderBy("src"))), "quotas")
    able = held.where((F.col("n") == 1) & (F.col("whole") * LARGE <= limits.share)).join(
        quotas.where("unmet > 0").groupBy("dst").agg(F.max("end").alias("wanted")).withColumnRenamed(
            "dst", "shard"), "shard").withColumn("order", hash_order(F.col("group"), F.lit(turn)))
    offers = running_total(able, ["shard"], ["order", "group"], "held", rows).where(
        F.col("before") + F.col("held") <= F.col("wanted")).alias("o").join(
            quotas.select("src", F.col("dst").alias("shard"), "end", "unmet"), "shard").where(
                (F.col("before") >= F.col("end") - F.col("unmet")) & (F.col("before") + F.col("held") <= F.col("end")))
    offers = scratch.keep(offers.select("group", F.lit(None).cast("int").alias("part"), F.col("shard").alias("src"),
                                        F.col("src").alias("dst"), F.col("held").alias("size")), "offers")
    made = offers.groupBy(F.col("dst").alias("src"), F.col("src").alias("dst")).agg(F.sum("size").alias("made"))
    limit = quotas.join(made, ["src", "dst"], "left").select(
        "src", "dst", (F.col("quota") + F.coalesce("made", F.lit(0))).alias("quota"))
    granted = running_total(asking.withColumn("order", hash_order(F.col("group"), F.col("part"), F.lit(turn))),
                            ["src", "dst"], ["order", "group", "part"], "size", rows).join(
        limit, ["src", "dst"]).where(F.col("before") + F.col("size") <= F.col("quota") + 1e-6)
    scratch.drop(asked)
    return granted.select("group", "part", "src", "dst"), offers.select("group", "part", "src", "dst")


def propagate(pieces: DataFrame, shards: int, share: float, slack: float, alone: float, rounds: int,
              scratch: Scratch, seen: list[int] | None = None) -> DataFrame:
    """Rounds over ``pieces`` (``group``, ``start``, ``part``, ``size``, ``shard``) until no round lowers
    the number of cuts (shards of a group beyond its first). ``seen`` gets that number round by round."""
    rows, least = pieces.count(), None
    for turn in range(rounds + 1):
        held = scratch.keep(held_bytes(pieces), "held")
        cuts = held.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) / F.col("n"))), F.lit(0.0))).first()[0]
        cuts = round(cuts)
        if seen is not None:
            seen.append(cuts)
        if turn == rounds or not cuts or least is not None and cuts >= least:
            scratch.drop(held)
            break
        least = cuts
        loads = dict(held.groupBy("shard").agg(F.sum("held")).collect())
        limits = Limits(loads, shards, share, slack, alone)
        wishes = _wishes(held, limits, turn)
        asking = scratch.keep(
            pieces.join(wishes, "group").where(~F.array_contains("targets", F.col("shard")))
            .withColumn("dst", F.get("targets", F.pmod(F.xxhash64("group", "part"), F.size("targets")).cast("int")))
            .groupBy("group", "part", F.col("shard").alias("src"), "dst").agg(F.sum("size").alias("size")), "asking")
        granted, offers = _granted(asking, held, limits, turn, rows, scratch)
        moves = scratch.keep(granted.unionByName(offers), "moves")
        after = pieces.alias("p").join(moves.withColumnsRenamed({"group": "of", "part": "piece"}), F.expr(
            "p.group = of AND p.shard = src AND (piece IS NULL OR piece = p.part)"), "left").select(
                *[f"p.{c}" for c in PIECE], "size", F.coalesce("dst", "p.shard").alias("shard"))
        pieces = scratch.keep(after, "pieces")
        scratch.drop(held, asking, moves)
    return pieces


def _start(linked: DataFrame, groups: DataFrame, capacity: float, shards: int, rows: int, share: float) -> DataFrame:
    """``linked`` in the hash order of the groups, cut into shards of ``capacity``: with ``start``
    and, of large groups, ``part``."""
    placed = running_total(groups, [], ["order", "group"], "whole", rows, "ahead")
    inside = running_total(linked, ["group"], ["order", "id"], "size", rows)
    middle = F.col("ahead") + F.col("before") + F.col("size") / 2
    return (inside.join(placed.select("group", "whole", "ahead"), "group")
            .withColumn("start", F.least(F.lit(shards - 1), F.floor(middle / F.lit(capacity)).cast("int")))
            .withColumn("part", F.when(F.col("whole") * LARGE > share, F.floor(
                F.col("before") / F.lit(share / PART)).cast("int")).otherwise(0))
            .drop("before", "ahead", "whole"))


def _cut(df: DataFrame, room: list[float], total: int, rows: int) -> DataFrame:
    """Cut ``df`` in hash order into shards in proportion to their ``room``; ``total`` is the
    sum of all sizes."""
    ends, end = [], 0.0
    for r in room:
        end += max(0.0, r)
        ends.append(end)
    scale = total / end if end > 0 else 0.0
    limits = F.array(*[F.lit(e * scale) for e in ends[:-1]]).cast("array<double>")
    middle = F.col("before") + F.col("size") / 2
    placed = running_total(df, [], ["order", "id"], "size", rows)
    return placed.withColumn("shard", F.size(F.filter(limits, lambda e: e <= middle))).drop("before")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (from 0, without gaps) of
    every row of ``docs`` (with ``doc_id`` and ``text``; other columns are dropped).

    A null text has no bytes, crc 0 and no links; empty texts are equal to each other.
    Repeated rows and ids are rows of their own; an empty table gives none. Shards may stay empty.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(docs.select(
        "doc_id", doc_bytes().alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        F.md5("text").alias("group")).withColumn(
            "order", hash_order(F.col("doc_id"), F.col("text_crc32")))
        .withColumn("id", F.monotonically_increasing_id()), "rows")
    groups = scratch.keep(rows.where("group is not null").groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("whole")).where("n > 1").select(
            "group", "whole", hash_order(F.col("group")).alias("order")), "groups")
    marked = scratch.keep(rows.join(groups.select("group", F.lit(True).alias("is_linked")), "group", "left"), "marked")
    scratch.drop(rows)
    linked, single = marked.where("is_linked"), marked.where("is_linked is null")
    n, total, n_linked, linked_total, largest = marked.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.count("is_linked"),
        F.coalesce(F.sum(F.when(F.col("is_linked"), F.col("size"))), F.lit(0)),
        F.max(F.when(F.col("is_linked"), F.col("size")))).first()
    share, alone, loads = total / shards, total - linked_total, {}
    columns = ["doc_id", "size", "text_crc32", "order", "id", "shard"]
    placed = single.withColumn("shard", F.lit(0)).select(*columns).limit(0)
    if n_linked:
        # Each shard keeps a margin for documents without links to even it out; short of those,
        # shards may differ by as much.
        leeway = max(LEEWAY * share, min(LEEWAY_DOCS * largest, share / 4))
        margin = min(leeway, alone / shards)
        started = scratch.keep(_start(linked, groups, max(share - margin, linked_total / shards), shards, n_linked,
                                      share), "started")
        pieces = propagate(scratch.keep(started.groupBy(*PIECE).agg(F.sum("size").alias("size")).withColumn(
            "shard", F.col("start")), "pieces"), shards, share, leeway - margin, alone, rounds, scratch)
        loads = dict(pieces.groupBy("shard").agg(F.sum("size")).collect())
        placed = started.join(pieces.select(*PIECE, "shard"), PIECE).select(*columns)
    placed = scratch.keep(placed.unionByName(_cut(
        single, [share - (loads.get(s) or 0) for s in range(shards)], alone, n).select(*columns)), "placed")
    return running_total(placed.withColumn("one", F.lit(1)), ["shard"], ["order", "id"], "one", n,
                         "slot").drop("one", "order", "id")


def shard_digest(docs: DataFrame) -> DataFrame:
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
