"""Repair of the turn structure of conversations by aligning them to an alternating grammar.

The turns of a repaired conversation read ``(s?(ua)+)?`` by their roles' initials: perhaps one
system turn, then user and assistant in turn. A conversation is aligned, as in Wagner and
Fischer's edit distance, to the grammar's string of each feasible length; all lengths that end
with the same role share one table, since each is the end of the next longer one. A cheap
repair found beforehand bounds the cost, and with it the diagonals of the table that need
filling in (Ukkonen's bands). Of all lengths and alignments of the least cost the audit, the
string of edits, that comes first in ASCII order wins.

Long conversations are aligned in blocks of ``BLOCK`` turns, joined at the states in which
the grammar can be between two turns, so that time and memory grow in proportion to the turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 256
#: Conversations of up to this many turns are remembered by a worker, as many as fit.
SHORT, REMEMBERED = 32, 50_000
NEVER = 1 << 40
#: Between two turns: nothing yet, assistant due, user due after system, user due after assistant.
START, AFTER_USER, AFTER_SYSTEM, AFTER_ASSISTANT = range(4)
#: What is still to be inserted at the end.
CLOSING = {START: "", AFTER_USER: "I", AFTER_SYSTEM: "II", AFTER_ASSISTANT: ""}
BLANKS = " \t\n\x0b\x0c\r"


class Table:
    """Least costs of aligning the turns from i on with the last k roles of a target that ends
    in ``last``: ``plain`` with user and assistant only, ``system`` with one system turn before
    those k. Nothing is inserted after the last turn; that is left to what follows."""

    def __init__(self, turns: str, last: str, slack: int):
        n = len(turns)
        free = np.cumsum([0, *(t != "x" for t in reversed(turns))])[::-1]  # turns that may stay
        width = int(free[0]) + slack // INSERT + 2
        self.last = last
        self.plain = np.full((n + 1, width), NEVER, np.int64)
        self.system = np.full((n + 1, width), NEVER, np.int64)
        self.plain[n, 0] = 0
        odd = np.arange(width) % 2 == 1
        rising = INSERT * np.arange(width)
        for i in range(n - 1, -1, -1):
            turn, here, below = turns[i], self.plain[i], self.plain[i + 1]
            lo = max(0, int(free[i]) - slack)
            hi = min(width, int(free[i]) + slack // INSERT + 1)
            here[lo:hi] = below[lo:hi] + DELETE
            self.system[i, lo:hi] = self.system[i + 1, lo:hi] + DELETE
            if turn != "x":
                more = TRUNCATED if turn.isupper() else 0
                match = np.where(odd == (turn.lower() == last), 0, REROLE) + more
                if turn.lower() not in "ua":
                    match = np.full(width, REROLE + more)
                if turn.lower() == "s":
                    np.minimum(self.system[i, lo:hi], below[lo:hi] + more, out=self.system[i, lo:hi])
                start = max(lo, 1)
                np.minimum(here[start:hi], below[start - 1:hi - 1] + match[start:hi], out=here[start:hi])
            here[lo:hi] = np.minimum.accumulate(here[lo:hi] - rising[lo:hi]) + rising[lo:hi]
        np.minimum(self.plain, NEVER, out=self.plain)
        np.minimum(self.system, NEVER, out=self.system)

    def due(self, k: int) -> str:
        """The first of the last ``k`` roles of the target."""
        return self.last if k % 2 else "ua"[self.last == "u"]

    def audit(self, turns: str, k: int, system: bool) -> str:
        """The first audit in ASCII order among the cheapest alignments."""
        out, i = [], 0
        while i < len(turns):
            table = self.system if system else self.plain
            now = table[i, k]
            if table[i + 1, k] + DELETE == now:
                out.append("D")
            elif system:
                out.append("K")
                system = False
            elif k and table[i, k - 1] + INSERT == now:
                out.append("I")
                k -= 1
                continue
            else:
                out.append("K" if turns[i].lower() == self.due(k) else "R")
                k -= 1
            i += 1
        return "".join(out)


def _bound(turns: str) -> int:
    """What some alignment costs beyond what every alignment does, from any state to any."""
    due, cost = "u", 0
    for turn in turns.lower().replace("x", ""):
        if turn not in "ua":
            cost += REROLE
        elif turn != due:
            cost += INSERT
            due = turn
        due = "ua"[due == "u"]
    return cost + 3 * INSERT  # to begin otherwise, and to end otherwise


class Block:
    def __init__(self, turns: str):
        self.turns, slack = turns, _bound(turns)
        self.tables = {AFTER_USER: Table(turns, "u", slack), AFTER_ASSISTANT: Table(turns, "a", slack)}

    def ends(self, entry: int) -> Iterator[tuple[int, int, int, bool]]:
        """``(cost, exit, k, system)`` of each feasible length from state ``entry``."""
        if entry in (START, AFTER_SYSTEM):  # all go
            yield int(self.tables[AFTER_ASSISTANT].plain[0, 0]), entry, 0, False
        if entry == START:
            yield int(self.tables[AFTER_ASSISTANT].system[0, 0]), AFTER_SYSTEM, 0, True
        due = "a" if entry == AFTER_USER else "u"
        for leave, table in self.tables.items():
            for k in np.flatnonzero(table.plain[0] < NEVER).tolist():
                if k and table.due(k) == due or not k and entry == leave:
                    yield int(table.plain[0, k]), leave, k, False
            if entry == START:
                for k in np.flatnonzero(table.system[0] < NEVER).tolist():
                    if k and table.due(k) == "u":
                        yield int(table.system[0, k]), leave, k, True

    def before(self, after: dict[int, int]) -> dict[int, int]:
        """The least cost from each state on, given those after the block."""
        return {entry: min(cost + after[leave] for cost, leave, _, _ in self.ends(entry))
                for entry in CLOSING}

    def best(self, entry: int, after: dict[int, int]) -> tuple[str, int]:
        """The audits of all cheapest lengths, compared. None is the beginning of another:
        each ends with what happens to the last turn."""
        ends = list(self.ends(entry))
        least = min(cost + after[leave] for cost, leave, _, _ in ends)
        return min((self.tables.get(leave, self.tables[AFTER_ASSISTANT]).audit(self.turns, k, system), leave)
                   for cost, leave, k, system in ends if cost + after[leave] == least)


def _align(turns: str) -> tuple[int, str]:
    after = [{state: INSERT * len(rest) for state, rest in CLOSING.items()}]
    starts = range(0, len(turns), BLOCK)
    for start in reversed(starts[1:]):
        after.append(Block(turns[start:start + BLOCK]).before(after[-1]))
    after.reverse()
    state, audit, cost = START, [], None
    for start, rest in zip(starts, after):
        block = Block(turns[start:start + BLOCK])
        if cost is None:
            cost = min(c + rest[leave] for c, leave, _, _ in block.ends(state))
        found, state = block.best(state, rest)
        audit.append(found)
    return cost or 0, "".join(audit) + CLOSING[state]


_remembered = lru_cache(REMEMBERED)(_align)


def align(turns: str) -> tuple[int, str]:
    """Cost and audit of a conversation given as one letter a turn: the role's initial ``s``,
    ``u`` or ``a``, ``o`` for any other, upper case if the text is truncated, or ``x`` for a
    turn that must go. The audit has K(eep), R(erole), D(elete) for each turn and I(nsert)."""
    return _remembered(turns) if len(turns) <= SHORT else _align(turns)


def _aligned(turns: Column) -> Column:
    def run(letters: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align(t) for t in letters], columns=["cost", "audit"])
    run.__annotations__ = {"letters": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "cost bigint, audit string")(turns)


def _key(column: str) -> Column:
    """Never null, so that null ids are a conversation too."""
    return F.when(F.col(column).isNotNull(), F.concat(F.lit("="), F.col(column).cast("string"))).otherwise("")


def _examined(conversations: DataFrame) -> DataFrame:
    """Rows in order (``place``), with their first fault, the letter for ``align`` and whether
    the step from the row before is illegal."""
    rows = conversations.select(
        _key("conv_id").alias("conv"), "conv_id", "turn",
        *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    placed = rows.withColumn("place", F.row_number().over(
        Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    in_order = Window.partitionBy("conv").orderBy("place")
    again = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy("place")) > 1
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return (placed.withColumn("fault", F.when(F.ltrim(bare, F.lit(BLANKS)) == "", "blank")
                              .when(again, "duplicate")
                              .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated"))
            .withColumn("letter", F.when(F.col("fault").isin("blank", "duplicate"), "x")
                        .when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter))
            .withColumn("step", F.concat(F.lag(initial).over(in_order), initial))
            .withColumn("new_turn", F.col("turn").isNotNull() & F.coalesce(
                F.lag("turn").over(in_order) != F.col("turn"), F.lit(True))))


def _audited(examined: DataFrame) -> DataFrame:
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    turns = F.array_sort(F.collect_list(F.struct("place", "letter")))
    missing = F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn")
    return examined.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"), F.coalesce(missing, F.lit(0)).cast("bigint").alias("gaps"),
        *map(count, ("blank", "duplicate", "truncated")),
        F.count_if(~F.col("step").isin("su", "ua", "au")).alias("illegal"),
        F.array_join(F.transform(turns, lambda t: t.letter), "").alias("turns")).withColumn(
            "found", _aligned(F.col("turns"))).select("*", "found.*").drop("found", "turns")


def audits(conversations: DataFrame) -> DataFrame:
    """A row for each conversation: ``conv_id``, ``gaps`` in its turn numbers, the numbers of
    rows that are ``blank``, ``duplicate`` or ``truncated`` (the first that holds), of
    ``illegal`` steps between roles, the ``cost`` of its cheapest repair and its ``audit``.

    Nulls in role and text read as one space, null ids are one conversation, null turns come
    first. Rows of equal turn are taken by role and text; repeated rows are duplicates. Other
    columns are dropped, an empty table gives none. Python sees a letter per turn, no text.
    """
    return _audited(_examined(conversations)).drop("conv")


def _edited(examined: DataFrame, audited: DataFrame) -> DataFrame:
    """A row for each edit: ``conv``, ``conv_id``, ``step``, ``edit``, ``turn``, ``role`` and
    ``text`` as they are afterwards. ``position`` is null for deleted rows."""
    stays = F.length(F.replace("audit", F.lit("D"), F.lit("")))
    pieces = audited.select("conv", F.col("conv_id").alias("of"), (stays % 2).alias("system"), F.posexplode(
        F.regexp_extract_all("audit", F.lit("(I*[DKR]|I+)"), F.lit(1))).alias("place", "piece"))
    letters = (pieces.withColumn("place", F.col("place") + 1).join(
        examined.select("conv", "place", "turn", "role", "text"), ["conv", "place"], "left")
        .select("*", F.posexplode(F.regexp_extract_all("piece", F.lit("."), F.lit(0))).alias("k", "edit")))
    order = Window.partitionBy("conv").orderBy("place", "k")
    inserted = F.col("edit") == "I"
    at = F.sum((F.col("edit") != "D").cast("int")).over(order) - 1
    return (letters.withColumn("step", F.row_number().over(order))
            .withColumn("position", F.when(F.col("edit") != "D", at))
            .select("conv", F.col("of").alias("conv_id"), "step", "position", "edit",
                    F.when(~inserted, F.col("turn")).alias("turn"),
                    F.when(F.col("edit").isin("K", "D"), F.col("role")).when(
                        (F.col("position") - F.col("system")) % 2 == 0, "user").otherwise("assistant").alias("role"),
                    F.when(inserted, "").otherwise(F.col("text")).alias("text")))


def repair(conversations: DataFrame) -> DataFrame:
    """The conversations after the cheapest repair, with deleted rows for the record: ``conv_id``,
    ``step``, ``position`` (from 0; null: deleted), ``edit``, ``turn`` (null: inserted), ``role``,
    ``text``. Nulls, ties, repeats, empty tables and other columns as in ``audits``."""
    examined = _examined(conversations)
    return _edited(examined, _audited(examined)).drop("conv")


def damage(conversations: DataFrame) -> DataFrame:
    """Damaged rows, by the checksum of conversation and turn: one in twenty each is dropped,
    emptied, loses its sentence ends, is repeated or becomes the user's."""
    said = lambda column: F.coalesce(F.col(column).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("hit") == 1, "").when(
        F.col("hit") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return (conversations.select("conv_id", "turn", "role", "text", hit.alias("hit")).where("hit > 0")
            .select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(said("role")).alias("role"),
                    text.alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy"))
            .drop("copy"))


def repair_digest(conversations: DataFrame) -> DataFrame:
    """The audit of every conversation after ``damage``, and a digest of the repaired one."""
    examined = _examined(damage(conversations))
    audited = _audited(examined)
    line = F.struct("position", F.concat("role", F.lit(":"), "text").alias("line"))
    repaired = _edited(examined, audited).where("position is not null").groupBy("conv").agg(F.sha2(
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.line), "\n"), 256).alias("sha"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (conversations.select("conv_id", _key("conv_id").alias("conv")).distinct()
            .join(audited.drop("conv_id"), "conv", "left").join(repaired, "conv", "left")
            .select("conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
