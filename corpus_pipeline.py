"""From raw documents to token ids. Each stage decides over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pulselake.llm import bpe, minhash, mixing, secrets, toxicity
from pulselake.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic, with all their columns, whatever their
    names. Null and empty texts are scored as texts without words; repeated rows stay or go
    together; without labelled documents of both kinds, and of an empty table, nothing goes."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text, that of the smallest doc_id, of each group of near duplicates (by pairs of words);
    other texts of the same doc_id are documents of their own. Null and empty texts and rows
    without doc_id are near duplicates of none. Of rows that repeat doc_id (or lack one) and
    text, one row, by the md5 of its other columns, whatever their names and types."""
    return minhash.drop_near_duplicates(docs, size=2)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by a mark; ``n_chars`` follows. Null
    texts stay null, repeated rows stay, other columns are untouched, whatever their names."""
    return secrets.hide(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order, with all columns of ``docs``,
    whatever their names. A null source is a source; texts without words are taken once at
    most; repeated rows are taken as documents of their own."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, with their digest and that of the text they decode to. A null
    text is empty and has no ids; every row gives a row; other columns are dropped."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                public_tokenizers.PATTERN, ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]
# Boosted trees, hashed signatures and byte-pair merges have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
