"""The registered queries of this subpackage: each reads its given tables whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (bpe, chat, embeddings, imatch, minhash, mixing, oracle, quality, repair, resample, secrets,
               sharding, topk, toxicity)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, function: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: function(table(spark, sf_dir, name))


def _over_labelled(function: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: function(table(spark, sf_dir, "documents"),
                                          table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {
        "op1_minhash": _over("documents", minhash.minhash_digest),
        "op2_toxicity": _over_labelled(toxicity.toxicity_scores),
        "op3_bpe": _over("documents", bpe.bpe_digest),
        "op4_secrets": _over("documents", secrets.secret_digest),
        "op5_chat": _over("conversations", chat.chat_digests),
        "op6_mix": _over("documents", mixing.mix_digest),
        "op7_quality": _over_labelled(quality.quality_scores),
        "op8_topk": _over("embeddings", topk.topk_digest),
        "op9_embeddings": _over("embeddings", embeddings.near_vectors),
        "op10_shard": _over("documents", sharding.shard_digest),
        "op11_repair": _over("conversations", repair.repair_digest),
        "op12_resample": lambda spark, sf_dir: resample.resample(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op13_imatch": _over("documents", imatch.fingerprint_digest),
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
