"""Chat formatting by event-sourced reconstruction (DataFrame operations only).

A log holds events ``(conv_id, seq, kind, message_no, role, text)``. Partitioned by
conversation and sorted by sequence, the events of a message fold into its final text:

* ``message`` and ``edit`` replace what the message said so far,
* ``delta`` appends to it (a streamed piece),
* ``regenerate`` clears it, and drops the later messages of the conversation whose last
  event came before the regeneration.

The messages are then rendered with a template. Control strings inside texts are broken by
a backslash, backslashes are doubled; ``unescape`` is the exact inverse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>\n"
# Control strings of this and of other common templates.
CONTROLS = ("<|", "[INST]", "[/INST]", "<<SYS>>", "<s>", "</s>")
LEARNT_ROLE = "assistant"


def escape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in controls:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, message_no, role, text)`` of an event log.

    Null texts are empty, an absent role is empty, a null kind counts as ``message``,
    unknown kinds are ignored. Events that tie in ``seq`` are taken in the order of kind
    and text. Null ids form a conversation of their own. Further columns are ignored.
    """
    kind = F.coalesce("kind", F.lit("message"))
    known = events.select(
        "conv_id", "message_no", "role", F.struct(
            F.col("seq").alias("seq"), kind.alias("kind"),
            F.coalesce("text", F.lit("")).alias("text")).alias("event")).where(
        F.col("event.kind").isin("message", "delta", "edit", "regenerate"))
    messages = known.groupBy("conv_id", "message_no").agg(
        F.sort_array(F.collect_list("event")).alias("log"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("event"))).alias("role"),
        F.max(F.when(F.col("event.kind") != "delta", F.col("event"))).alias("reset"),
        F.max(F.when(F.col("event.kind") == "regenerate", F.col("event.seq"))).alias("again"),
        F.max("event.seq").alias("last"))
    earlier = (Window.partitionBy("conv_id").orderBy("message_no")
               .rowsBetween(Window.unboundedPreceding, -1))
    said = F.filter("log", lambda e: (F.col("reset").isNull() | (e >= F.col("reset")))
                    & (e["kind"] != "regenerate"))
    return (messages.withColumn("again_before", F.max("again").over(earlier))
            .where(F.col("again_before").isNull() | F.col("last").isNull()
                   | (F.col("last") >= F.col("again_before")))
            .select("conv_id", "message_no", F.coalesce("role", F.lit("")).alias("role"),
                    F.array_join(F.transform(said, lambda e: e["text"]), "").alias("text")))


def render(messages: DataFrame, learnt_role: str = LEARNT_ROLE) -> DataFrame:
    """One row per conversation: ``formatted``, its length, and ``loss_spans``, the code
    point ranges (end exclusive) of the texts of ``learnt_role``."""
    earlier = (Window.partitionBy("conv_id").orderBy("message_no")
               .rowsBetween(Window.unboundedPreceding, -1))
    pieces = (messages
              .withColumn("head", F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(TEXT)))
              .withColumn("body", escape(F.col("text")))
              .withColumn("size", F.char_length("head") + F.char_length("body") + len(END))
              .withColumn("at", F.coalesce(F.sum("size").over(earlier), F.lit(0))
                          + F.char_length("head")))
    turn = F.struct("message_no", F.concat("head", "body", F.lit(END)).alias("piece"),
                    (F.col("role") == learnt_role).alias("learnt"),
                    F.col("at").cast("int").alias("start"),
                    (F.col("at") + F.char_length("body")).cast("int").alias("end"))
    return (pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
            .select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "")
                    .alias("formatted"),
                    F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct(
                        t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"))
            .withColumn("formatted_chars", F.char_length("formatted").cast("bigint")))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, as an array of ``(role, text)``."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    fields = F.transform(F.slice(pieces, 1, F.size(pieces) - 1),
                         lambda p: F.split(p, r"<\|(?:role|text)\|>", -1))
    return F.transform(fields, lambda f: F.struct(
        unescape(f[1]).alias("role"), unescape(f[2]).alias("text")))


def learnt_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(
        F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def log_of(conversations: DataFrame) -> DataFrame:
    """An event log of a table with a row per turn: learnt turns as two streamed pieces,
    the others as one message. Turns that tie are numbered by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = (conversations.select("conv_id", "turn", "role", "text")
            .withColumn("message_no", F.row_number().over(order).cast("bigint")))
    half = F.floor(F.char_length("text") / 2).cast("int")
    pieces = F.when(F.col("role") == LEARNT_ROLE, F.array(
        F.struct(F.lit(0).alias("part"), F.lit("delta").alias("kind"),
                 F.substring("text", F.lit(1), half).alias("text")),
        F.struct(F.lit(1).alias("part"), F.lit("delta").alias("kind"),
                 F.substring(F.col("text"), half + 1, F.char_length("text")).alias("text")))
    ).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.lit("message").alias("kind"),
                                 F.col("text").alias("text"))))
    return rows.select("conv_id", "message_no", "role", F.explode(pieces).alias("p")).select(
        "conv_id", (F.col("message_no") * 2 + F.col("p.part")).alias("seq"),
        F.col("p.kind").alias("kind"), "message_no", "role", F.col("p.text").alias("text"))


def digests(rendered: DataFrame) -> DataFrame:
    """Counts and hashes read back from the rendered conversations."""
    turns, learnt = F.col("read_turns"), F.col("read_loss")
    return (rendered.withColumn("read_turns", parse(F.col("formatted")))
            .withColumn("read_loss", F.array_join(
                learnt_texts(F.col("formatted"), F.col("loss_spans")), ""))
            .select("conv_id", F.size(turns).cast("bigint").alias("n_turns"),
                    F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(
                        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
                    .alias("turns_sha256"),
                    F.char_length(learnt).cast("bigint").alias("loss_chars"),
                    F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars"))


# A conversation that consists of control strings, formatted with every table.
PROBE = "</s>[INST] ok [/INST]"


def chat_digests(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    probe = spark.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, LEARNT_ROLE, PROBE)],
        "conv_id bigint, turn bigint, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(render(fold(log_of(rows))))
