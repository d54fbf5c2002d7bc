"""Ranking metrics and paired statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.session import ship_package


def ranking_metrics(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, gold, recall, precision, mrr, ndcg) at ``k`` of every query with relevant documents."""
    gold = qrels.select("query_id", "doc_id").distinct()
    n = gold.groupBy("query_id").agg(F.count("*").alias("gold"))
    top = ranked.where(F.col("rank") <= k).select("query_id", "doc_id", "rank")
    hits = top.join(gold.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    per = hits.groupBy("query_id").agg(F.count("*").alias("shown"), F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = n.join(per, "query_id", "left")
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select("query_id", "gold", z(F.col("hits") / F.col("gold")).alias("recall"), z(F.col("hits") / F.least(F.lit(k), F.col("shown"))).alias("precision"), z(1 / F.col("first")).alias("mrr"), z(F.col("dcg") / ideal).alias("ndcg"))


def macro(metrics: DataFrame, by: str | None = None) -> DataFrame:
    cols = [F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg")]
    return (metrics.rollup(by) if by else metrics.groupBy()).agg(F.count("*").alias("n"), *cols)


def first_occurrence(lists: DataFrame) -> DataFrame:
    """Each item once, at its best rank, ranks made dense."""
    best = lists.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "doc_id")).cast("long"))


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: both, only_a, only_b, neither, net.  ``a``, ``b`` (task, ok)."""
    j = a.select("task", F.col("ok").alias("x")).join(b.select("task", F.col("ok").alias("y")), "task")
    n = lambda c: F.count(F.when(c, 1))
    x, y = F.col("x"), F.col("y")
    return j.agg(n(x & y).alias("both"), n(x & ~y).alias("only_a"), n(~x & y).alias("only_b"), n(~x & ~y).alias("neither")).withColumn("net", F.col("only_a") - F.col("only_b"))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided binomial p of discordant counts, by a running product of binomial terms in logarithms."""
    n, k = b + c, F.least(b, c)
    lf = lambda m: F.aggregate(F.when(m >= 1, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.lit(0.0), lambda s, i: s + F.exp(lf(n) - lf(i) - lf(n - i) - n * math.log(2)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), 2 * tail), 6))


def cohens_d(diffs: DataFrame, col: str) -> DataFrame:
    return diffs.agg(F.round(F.avg(col) / F.stddev_samp(col), 6).alias("d"))


def bootstrap_ratio(spark: SparkSession, pairs: DataFrame, rounds: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(ratio, low, high) of sum(a) / sum(b) with Poisson resampling: each row gets its counts where it lies.

    ``pairs`` (id, a, b).  A count is drawn from a hash of seed, id and round, so any layout draws the same; a task
    keeps two sums for each round and sends those alone.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, rounds))
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in (1, 2)])
            for at in range(0, len(keys), 256):
                sums += values[:, at : at + 256] @ _poisson_counts(keys[at : at + 256], rounds)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds)), pa.array(sums[0]), pa.array(sums[1])], names=["r", "a", "b"])

    ship_package(spark)
    rows = pairs.select(F.xxhash64(F.lit(seed), "id"), F.col("a").cast("double"), F.col("b").cast("double")).na.drop()
    sums = rows.mapInArrow(work, "r long, a double, b double").groupBy("r").agg((F.sum("a") / F.sum("b")).alias("q"))
    lo = (1 - level) / 2
    six = lambda c: F.round(c, 6)
    whole = pairs.agg(six(F.sum("a") / F.sum("b")).alias("ratio"))
    return whole.join(sums.agg(six(F.percentile("q", lo)).alias("low"), six(F.percentile("q", 1 - lo)).alias("high")))


def _poisson_counts(keys: np.ndarray, rounds: int) -> np.ndarray:
    """Poisson(1) counts, one row for each key, by inversion of a hash of key and round."""
    with np.errstate(over="ignore"):
        x = keys[:, None] + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    below = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(10)])
    return np.searchsorted(below, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(np.float64)


def bootstrap_mean(spark: SparkSession, values: DataFrame, rounds: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(mean, low, high) of ``values`` (id, a)."""
    return bootstrap_ratio(spark, values.withColumn("b", F.lit(1.0)), rounds, seed, level).withColumnRenamed("ratio", "mean")


def cumulative_recall(calls: DataFrame, gold: DataFrame) -> DataFrame:
    """(run, turn, recall): the share of gold found up to each call.  ``calls`` (run, turn, item), ``gold`` (run, item)."""
    first = calls.join(gold, ["run", "item"]).groupBy("run", "item").agg(F.min("turn").alias("turn"))
    new = first.groupBy("run", "turn").agg(F.count("*").alias("new"))
    n = gold.groupBy("run").agg(F.countDistinct("item").alias("gold"))
    rows = calls.select("run", "turn").distinct().join(new, ["run", "turn"], "left").join(n, "run")
    upto = F.sum(F.coalesce("new", F.lit(0))).over(W.partitionBy("run").orderBy("turn"))
    return rows.select("run", "turn", F.round(upto / F.col("gold"), 6).alias("recall"))


def carried_tokens(rows: DataFrame, by: str, turn: str, tokens: str) -> DataFrame:
    """Each result's tokens times the turns that carry it."""
    left = F.max(turn).over(W.partitionBy(by)) - F.col(turn) + 1
    return rows.withColumn("carried", (F.col(tokens) * F.greatest(F.lit(1), left)).cast("long"))
