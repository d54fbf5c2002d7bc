"""The corpus pipeline: five stages, each one operator over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm import decontam, quality_lines, simhash_ball, source_mix, token_store
from lodeseam.session import persisted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The part of the tokens that the mixture takes; no document is repeated.
MIX_SHARE = 0.75
#: Words whose ids a worker remembers: few, as the workers stay for the other stages.
HELD_WORDS = 250_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed; rejected documents go."""
    kept = quality_lines.line_quality(docs).where("kept")
    return kept.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document of the least id stays."""
    return simhash_ball.keep_one(spark, docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are mostly such passages go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.clean_documents(spark, docs, benchmark).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights."""
    return source_mix.mix(spark, docs, share=MIX_SHARE, max_epochs=1).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token files; one row for each document tells its place in them."""
    return token_store.read_documents(spark, token_store.write_store(spark, docs, held_words=HELD_WORDS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]
#: SQL has neither the fingerprint's hash nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = persisted(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
