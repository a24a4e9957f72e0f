"""The corpus pipeline: documents are filtered, deduplicated, cleaned of secrets and packed.

Every stage takes what the one before kept, as it was written to Parquet and read
again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm.common import free_name, shared_dir, ship
from meshloom.llm.languages import UNKNOWN, add_languages, train_languages
from meshloom.llm.packing import pack_documents
from meshloom.llm.secrets import redact_secrets
from meshloom.llm.simhash import drop_near_copies
from meshloom.llm.toxicity import score_toxicity, train_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of less than a half; the model learns from the labels outside its held-out fold.

    A null or empty text has the score of no features, so it stays where most labelled
    texts are clean. A score of exactly a half goes. Repeated rows stay or go together,
    a null id changes nothing, an empty table gives an empty one. Columns with names of
    the stage's own keep their values.
    """
    ship(spark)
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "toxicity")
    return score_toxicity(docs, model, name=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null texts and those without letters go.

    Of languages with equal shares the first by name is taken, so ties don't decide who
    stays. Repeated rows stay or go together, a null id changes nothing; an empty table,
    or one without labelled languages, gives an empty one. Columns with names of the
    stage's own keep their values.
    """
    ship(spark)
    lang, share = free_name(docs, "lang_pred"), free_name(docs, "lang_share")
    found = add_languages(docs, train_languages(docs), names=(lang, share))
    return found.where(F.col(lang) != UNKNOWN).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, by the fingerprints of ``op4_simhash``: those within two bits are linked.

    The smallest id stays, null ids come last. Null texts and those without words have
    fingerprint zero, so they are copies of each other. Of rows that repeat id and text
    one stays; an empty table gives an empty one. Columns with names of the stage's own
    keep their values.
    """
    ship(spark)
    return drop_near_copies(docs, width=3)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by the secret's kind; n_chars follows the text.

    A null text stays null with its n_chars, an empty one stays empty. Spans that overlap
    become one, of the first one's kind. Repeated rows change alike, a null id changes
    nothing, an empty table gives an empty one. Columns with names of the stage's own keep
    their values.
    """
    ship(spark)
    return redact_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens.

    A null or empty text is its end id alone. Repeated rows are packed each for itself,
    a null id stays null, an empty table gives an empty one; columns besides id and text
    are left out.
    """
    ship(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_languages),
    ("near_dedup", drop_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The stages learn models and tokenize, which SQL can't express; tests/llm holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; what each keeps is written to the shared folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
