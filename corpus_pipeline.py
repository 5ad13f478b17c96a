"""Corpus pipeline: each stage takes the documents that the stage before it kept and returns the next ones.

Every function takes (spark, docs, sf_dir). All stages but the last return the columns of ``documents``; the last returns
token counts and digests. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthi.llm import jaccard_join, lang_id, mixing, piece_bpe, substring_dedup
from granthi.llm.common import fold, table
from granthi.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language (null text or no letter) go; a missing ``lang`` becomes the predicted one."""
    model = lang_id.fit(docs, fold("doc_id", 4) != 2)
    found = lang_id.predict(docs, model, keep=COLUMNS)
    return (
        found.filter(F.col("lang_pred") != lang_id.UNDETERMINED)
        .withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar texts the one with the smallest id stays.

    Rows are told apart by id and text: an equal row counts once, different texts of one id are documents of their own.
    Rows without an id take no part and stay.
    """
    keyed = docs.filter(F.col("doc_id").isNotNull()).withColumn("__key", F.xxhash64("doc_id", "text"))
    classes = materialise(jaccard_join.similar_documents(keyed, key="__key").toDF("__key", "class", "n_links").distinct(), "classes")
    ids = keyed.select("__key", "doc_id").distinct()
    first = classes.join(ids, "__key").groupBy("class").agg(F.min(F.struct("doc_id", "__key"))["__key"].alias("__key")).select("__key")
    # The ids grow with the documents, so they are never broadcast: the same plan at every size.
    kept = keyed.join(first.hint("merge"), "__key").groupBy("__key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()).select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go; documents with nothing left go; untouched texts stay as they are."""
    cut = substring_dedup.remove_repeats(docs, keep=("lang", "source"), untouched=True)
    return cut.filter(F.col("n_removed") < F.col("n_words")).select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source",
        F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per time that the mix takes it; repeats are rows with the same id."""
    return mixing.repeat_documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

# Naive Bayes, MinHash candidates and BPE have no SQL twin: tests/llm holds the result against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
