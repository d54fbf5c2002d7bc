"""Context under a budget: allocation, prefix trims by running sums, and packed texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def allocation(z1: Column, z2: Column, z4: Column, limit: int = 128_000, soft_ratio: float = 0.25) -> Column:
    """Mode and budget of the third zone: FULL, COMPACT, MINIMAL or NONE, and how many entries fit."""
    ratio = max(0.05, min(0.9, soft_ratio if soft_ratio > 0 else 0.25))
    soft, half, most, tenth = int(limit * ratio), int(limit * 0.5), int(limit * 0.9), int(limit * 0.1)
    fixed = z1 + z2 + z4
    mode = F.when(fixed < soft, "FULL").when(fixed < half, "COMPACT").when(fixed < most, "MINIMAL").otherwise("NONE")
    budget = F.when(fixed < soft, soft - fixed).when(fixed < half, half - fixed).when(fixed < most, F.least(F.lit(tenth), most - fixed)).otherwise(0)
    # fixed values: tokens of an entry in each mode
    each = F.when(mode == "FULL", 25).when(mode == "COMPACT", 12).when(mode == "MINIMAL", 8)
    return F.struct(mode.alias("mode"), budget.cast("long").alias("zone3"), F.coalesce(F.floor(budget / each), F.lit(0)).cast("long").alias("entries"), F.round((fixed + budget) / F.lit(float(limit)), 6).alias("utilisation"))


def prefix_within(rows: DataFrame, by: str, order: list[Column], chars: Column, budget_tokens: int, separator: int = 1) -> DataFrame:
    """The longest prefix of each group whose joined text, a quarter token for a character, fits the budget.

    A group's rows are those of one answer, which ranking has cut before; the sum runs over characters and
    separators, not over rounded tokens of each row.
    """
    run = F.sum(chars + separator).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - separator
    return rows.withColumn("used", F.floor(run / 4).cast("long")).where(F.col("used") <= budget_tokens)


def four_zones(candidates: DataFrame, rules: Column, request: Column, budget: int = 8000) -> DataFrame:
    """(query_id, zone, doc_id, form): bodies of tier 1, signatures of the rest, by score, within the budget.

    ``candidates`` (query_id, doc_id, tier, score, body, signature).  What rules and request leave, 500 tokens at
    least, is for the two inner zones; the third is dropped from its back first, then bodies from theirs become
    signatures.
    """
    inner = F.greatest(F.lit(500), F.lit(budget) - F.floor(F.length(rules) / 4) - F.floor(F.length(request) / 4) - 20) * 4
    c = candidates.withColumn("room", inner.cast("long")).withColumn("lead", (F.col("tier") == 1).cast("int"))
    order = W.partitionBy("query_id").orderBy(F.desc("lead"), F.desc("score"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    size = F.when(F.col("tier") == 1, F.length("body")).otherwise(F.length("signature"))
    packed = c.withColumn("bodies", F.sum(size + 1).over(order)).withColumn("all_signatures", F.sum(F.when(F.col("tier") == 1, F.length("signature") + 1).otherwise(0)).over(W.partitionBy("query_id")))
    form = F.when((F.col("tier") == 1) & (F.col("bodies") <= F.col("room")), "body").when((F.col("tier") == 1) & (F.col("all_signatures") <= F.col("room")), "signature").when((F.col("tier") > 1) & (F.col("bodies") <= F.col("room")), "signature")
    return packed.withColumn("form", form).where("form is not null").select("query_id", F.when(F.col("tier") == 1, 2).otherwise(3).alias("zone"), "doc_id", "form")


def joined(rows: DataFrame, by: str, order: str, text: Column, sep: str = "\n") -> DataFrame:
    """(by, text): each group's texts in order.  A group is an answer of bounded length."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("t")))), lambda s: s["t"]), sep).alias("text"))


def truncation_level(sizes: list[Column], budget: Column) -> Column:
    """How many of five steps are needed: each drops one more of the optional sizes, the last first."""
    out = F.lit(len(sizes) - 1)
    for k in range(len(sizes) - 1, -1, -1):
        total = sum(sizes[1 : len(sizes) - k], sizes[0])
        out = F.when(total <= budget, F.lit(k)).otherwise(out)
    return out.cast("long")


def raw_tokens(rows: DataFrame, by: str, doc: str, tokens: str) -> DataFrame:
    """Tokens of the whole documents that an answer draws on, each document once."""
    return rows.dropDuplicates([by, doc]).groupBy(by).agg(F.sum(tokens).cast("long").alias("raw"))
