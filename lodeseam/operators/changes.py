"""Snapshots and what changed between them; impact of a change; incremental upkeep of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.operators import graph


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, sha: str = "sha") -> DataFrame:
    """(key, status): new, modified or deleted."""
    both = old.select(key, F.col(sha).alias("o")).join(new.select(key, F.col(sha).alias("n")), key, "full")
    return both.select(key, F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified").alias("status")).where("status is not null")


def staleness(diff: DataFrame, rebuild_total: int = 10, rebuild_deleted: int = 3) -> DataFrame:
    """One row: counts and the verdict ok, update or rebuild."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    row = diff.agg(n("new").alias("added"), n("modified").alias("modified"), n("deleted").alias("deleted"))
    total = F.col("added") + F.col("modified") + F.col("deleted")
    return row.withColumn("verdict", F.when(total == 0, "ok").when((total > rebuild_total) | (F.col("deleted") > rebuild_deleted), "rebuild").otherwise("update"))


def risk(count: Column, distance: Column, complexity: Column, exported: Column) -> Column:
    """Risk of a file: how much of it is reached, how near, how complex, and whether it is public."""
    reach = F.least(F.lit(1.0), count / 10.0) * 0.4
    near = F.when(distance <= 1, 0.3).when(distance == 2, 0.2).otherwise(0.1)
    return F.round(F.least(F.lit(1.0), reach + near + F.least(F.lit(1.0), complexity / 20.0) * 0.2 + F.when(exported, 0.1).otherwise(0.0)), 6)


def impact(spark: SparkSession, changed: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int = 2) -> DataFrame:
    """(grp, n, nearest, complexity, exported, risk) of the groups that a change reaches.

    ``changed`` (node), ``symbols`` (node, grp, complexity, exported).
    """
    reached = graph.blast_radius(spark, edges, changed.select(F.col("node").alias("start")), depth).groupBy("node").agg(F.min("dist").alias("dist"))
    rows = reached.join(symbols, "node")
    out = rows.groupBy("grp").agg(F.count("*").alias("n"), F.min("dist").alias("nearest"), F.round(F.avg("complexity"), 6).alias("complexity"), F.max("exported").alias("exported"))
    return out.withColumn("risk", risk(F.col("n"), F.col("nearest"), F.col("complexity"), F.col("exported")))


def update_rows(index: DataFrame, fresh: DataFrame, diff: DataFrame, key: str) -> DataFrame:
    """An index's rows after a change: rows of changed keys go, fresh rows of them come."""
    gone = diff.select(key)
    return index.join(gone, key, "left_anti").unionByName(fresh.join(diff.where("status <> 'deleted'").select(key), key, "left_semi"))


def missing_embeddings(hashes: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashes still to encode, and the cache without what nobody uses."""
    return hashes.join(cache, "hash", "left_anti"), cache.join(hashes, "hash", "left_semi")
