"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm import decontam, html_paths, license_index, line_dedup, quality_lines, simhash_ball, source_mix, token_store, toxicity_knn, url_rules
from lodeseam.llm.oracles import ORACLE  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(spark, _table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_lines.line_quality(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_words_removed", "base_failed", "kept")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_rules.filter_urls(spark, _table(spark, sf_dir, "pages"), url_rules.rules_frame(spark, url_rules.RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_index.scan_licenses(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    learn = _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    out = toxicity_knn.train_and_score(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), learn)
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), F.array_join("evidence", ",").alias("nearest"), F.array_join("cosines", ",").alias("cosines"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ball.near_duplicates(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_paths.extract_main_text(spark, _table(spark, sf_dir, "pages"), joined_by="\n\n")
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.scan_documents(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["past"] - s["first"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(spark, _table(spark, sf_dir, "documents"))
    return token_store.read_documents(spark, store).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_html": op3_html,
    "op4_mix": op4_mix,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_urls": op7_urls,
    "op8_licenses": op8_licenses,
    "op9_tokens": op9_tokens,
    "op10_lines": op10_lines,
}
