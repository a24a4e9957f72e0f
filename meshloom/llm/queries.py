"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_digests
from .common import ship
from .conversations import damaged_and_repaired
from .languages import language_id
from .lm_scores import lm_scores
from .media import media_digests
from .mixing import MIX_SQL, mix_sources
from .neighbours import nearest_neighbours
from .packing import pack_documents
from .resampling import importance_resample
from .secrets import find_secrets
from .simhash import near_groups
from .sql import CONVERSATIONS_SQL, RESAMPLING_SQL
from .token_counts import token_counts
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"), width=3)


def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_and_repaired(_table(spark, sf_dir, "conversations"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), percent=150, copies=2)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, seed=2024, longest=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_media": op2_media,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_languages": op5_languages,
    "op6_lm_scores": op6_lm_scores,
    "op7_secrets": op7_secrets,
    "op8_token_counts": op8_token_counts,
    "op9_neighbours": op9_neighbours,
    "op10_toxicity": op10_toxicity,
    "op11_conversations": op11_conversations,
    "op12_mixing": op12_mixing,
    "op13_resampling": op13_resampling,
}

#: The others can't be written in SQL alone; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op11_conversations": CONVERSATIONS_SQL, "op12_mixing": MIX_SQL, "op13_resampling": RESAMPLING_SQL}
