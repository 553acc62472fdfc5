"""Secret scans over a trigram inverted index (DataFrame operations only).

From each rule's regular expression a Boolean trigram query is derived: alternatives, each a
set of trigrams that every match must contain. The index holds a posting (trigram, document)
for every trigram of these queries. Postings are intersected per alternative, the documents
that satisfy one are verified with the regular expression itself. A rule without mandatory
trigrams scans all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked



@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, else the match is dropped."""
    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The three base rules. An `access` or `hex` match is the longest run at its
# place, so its least length can stand in the expression; a short `assign` match still uses
# up its characters, so it is dropped afterwards.
BASE_RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                   r"([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Published formats of further credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("hub_token", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("api_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("live_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES
MOST_STRINGS = 64  # alternatives kept apart while a query is derived; beyond, less is demanded


# --- trigram queries -------------------------------------------------------------------

def _trigrams(strings: set[str]) -> list[frozenset[str]] | None:
    """The alternatives 'contains one of these strings'; None if that demands nothing."""
    if any(len(s) < 3 for s in strings):
        return None
    return [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings]


def _both(a, b):
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MOST_STRINGS:
        return min(a, b, key=len)
    return list({x | y for x in a for y in b})


def _strings(op, arg) -> set[str] | None:
    """All strings that a piece of an expression can match, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        found: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                found.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if name == "SUBPATTERN":
        return _all_strings(arg[3])
    if name == "BRANCH":
        options = [_all_strings(option) for option in arg[1]]
        return None if None in options else set().union(*options)
    if name == "MAX_REPEAT" and arg[1] != _ENDLESS and int(arg[1]) <= 4:
        once = _all_strings(arg[2])
        if once is None or len(once) ** int(arg[1]) > MOST_STRINGS:
            return None
        out, grown = set(), {""}
        for n in range(int(arg[1]) + 1):
            out |= grown if n >= arg[0] else set()
            grown = {g + o for g in grown for o in once}
        return out
    return None


_ENDLESS = re._parser.MAXREPEAT


def _all_strings(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        more = _strings(op, arg)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _demand(items) -> list[frozenset[str]] | None:
    query, run = None, {""}
    for op, arg in items:
        more = _strings(op, arg)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        query, run = _both(query, _trigrams(run)), {""}
        if more is not None:
            run = more
        elif str(op) == "SUBPATTERN":
            query = _both(query, _demand(arg[3]))
        elif str(op) == "BRANCH":
            options = [_demand(option) for option in arg[1]]
            query = _both(query, None if None in options else sum(options, []))
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            query = _both(query, _demand(arg[2]))
    return _both(query, _trigrams(run))


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigrams, one of which any text with a match contains
    whole (case aside); None if the expression has no mandatory trigram."""
    options = _demand(re._parser.parse(regex))
    # An alternative that asks for more than another one adds nothing.
    return options and [o for o in options if not any(p < o for p in options)]


# --- index -----------------------------------------------------------------------------

def doc_key() -> Column:
    """Key of a document in the index. A collision only adds a candidate to verify."""
    return F.xxhash64("doc_id", "text")


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings ``(trigram, key)`` of the trigrams that the rules' queries ask for."""
    wanted = sorted({t for r in rules for option in trigram_query(r.regex) or [] for t in option})
    lower = docs.select(doc_key().alias("key"), F.lower("text").alias("lower"))
    return lower.select("key", F.explode(F.array_compact(F.array(*[
        F.when(F.contains("lower", F.lit(t)), F.lit(t)) for t in wanted]))).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(key, kinds)``: the rules of which some alternative has all its postings."""
    rows = [(r.kind, n, len(option), t) for r in rules
            for n, option in enumerate(trigram_query(r.regex) or []) for t in sorted(option)]
    asked = index.sparkSession.createDataFrame(
        rows, "kind string, alternative int, size int, trigram string")
    return (index.join(F.broadcast(asked), "trigram")  # a row per trigram of the rules
            .groupBy("key", "kind", "alternative", "size")
            .agg(F.count_distinct("trigram").alias("found"))
            .where(F.col("found") == F.col("size"))
            .groupBy("key").agg(F.collect_set("kind").alias("kinds")))


# --- verification ----------------------------------------------------------------------

#: Elements that ``_running`` goes through one by one.
STEP = 64


def _fold(values: Column, combine) -> Column:
    """Running results of ``combine`` from 0; each step copies what is there."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def add(state, value):
        at = combine(state["at"], value)
        return F.struct(at.alias("at"), F.concat(state["out"], F.array(at)).alias("out"))

    return F.aggregate(values, start, add)["out"]


def _running(values: Column, combine) -> Column:
    """Running results of ``combine`` (a sum or maximum, from 0) over an array of numbers: within
    steps of ``STEP`` elements, over the results of the steps, then both combined. So an array is
    copied for a step, not for an element."""
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int")),
                        lambda k: _fold(F.slice(values, k * STEP + 1, STEP), combine))
    before = F.concat(F.array(F.lit(0)), _fold(F.transform(steps, lambda x: F.element_at(x, -1)), combine))
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(
        steps, F.slice(before, 1, F.size(steps)), lambda inside, offset: F.transform(
            inside, lambda x: combine(offset, x))))).otherwise(F.array().cast("array<int>"))


def _plus(a: Column, b: Column) -> Column:
    return a + b

def _ends(hits: Column, gaps: Column) -> Column:
    """Where the texts before matches and the matches end in code points, in turn."""
    return _running(F.flatten(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda gap, hit: F.array(
        F.char_length(gap), F.char_length(hit)))), _plus)


def _spans(rule: Rule, order: int, groups: Column, ends: Column) -> Column:
    """Matches with their ranges of code points; those whose value is long enough."""
    found = F.transform(groups, lambda value, i: F.struct(
        F.get(ends, 2 * i).alias("start"), F.lit(order).alias("order"), F.get(ends, 2 * i + 1).alias("end"),
        F.lit(rule.kind).alias("kind"), (F.char_length(value) >= rule.least).alias("long")))
    return F.filter(found, lambda s: s["long"])


def _scanned(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc``, the packed columns of ``docs``, ``text`` and ``spans``."""
    rows = docs.select(packed(docs), "doc_id", "text")
    marked = rows.withColumn("key", doc_key()).join(
        candidates(build_index(rows, rules), rules), "key", "left")
    none = F.array().cast("array<string>")
    hits, groups, gaps, ends, spans = {}, {}, {}, {}, []
    for n, rule in enumerate(rules):
        asked = trigram_query(rule.regex) is None
        todo = F.lit(True) if asked else F.array_contains("kinds", rule.kind)
        hits[f"h{n}"] = F.when(todo & F.col("text").isNotNull(), F.regexp_extract_all(
            F.col("text"), F.lit(rule.regex), F.lit(0))).otherwise(none)
        some = F.size(f"h{n}") > 0
        groups[f"g{n}"] = F.when(some, F.regexp_extract_all(
            F.col("text"), F.lit(rule.regex), F.lit(rule.group))).otherwise(none) \
            if rule.group else F.col(f"h{n}")
        gaps[f"s{n}"] = F.when(some, F.split(F.col("text"), rule.regex, -1)).otherwise(none)
        ends[f"e{n}"] = F.when(some, _ends(F.col(f"h{n}"), F.col(f"s{n}")))
        spans.append(F.when(some, _spans(rule, n, F.col(f"g{n}"), F.col(f"e{n}"))).otherwise(F.array()))
    found = marked.withColumns(hits).withColumns(groups).withColumns(gaps).withColumns(ends)
    merged = F.transform(F.array_sort(F.concat(*spans)), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        s["order"].alias("order")))
    return found.select("doc", "text", merged.alias("spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``spans``, sorted by start, then rule order; per rule the leftmost
    matches that do not overlap. Null texts are empty. Repeated rows and ids are scanned
    each; an empty table gives none. All other columns stay, whatever their names; an own
    column ``spans`` of ``docs`` is replaced."""
    kept = docs.drop("spans")
    return _scanned(kept, rules).select(*unpacked(kept), "spans")


def hide(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mark. ``n_chars``, if there is one,
    follows. All columns stay, whatever their names; rows as in ``scan``."""
    found = _scanned(docs, rules).withColumn("clean", redact(F.col("text"), F.col("spans")))
    instead = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        old = F.col("doc").getField("n_chars")
        instead["n_chars"] = F.when(F.size("spans") > 0, F.char_length("clean").cast(
            docs.schema["n_chars"].dataType)).otherwise(old)
    return found.select(*unpacked(docs, **instead))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every span, overlapping or touching ones as one, replaced by ``mark``."""
    covered = F.concat(F.array(F.lit(0)), _running(F.transform(spans, lambda s: s["end"]), F.greatest))
    # A span that touches the one before goes with it.
    pieces = F.zip_with(spans, F.slice(covered, 1, F.size(spans)), lambda s, at: F.when(
        (s["start"] > at) | (at == 0), F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mark))).otherwise(""))
    rest = F.substring(text, F.element_at(covered, -1) + 1, F.char_length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def secret_digest(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["order"] < len(BASE_RULES))
    counts = [F.size(F.filter("spans", _of_kind(r.kind))).cast("bigint").alias(f"n_{r.kind}")
              for r in BASE_RULES]
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"))
