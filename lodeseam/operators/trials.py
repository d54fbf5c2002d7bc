"""Tables over evaluation runs: arms, first and last searches, localisation, audits.

A run is one (task, arm); unless told otherwise a null metric is left out of means and medians, never read as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: suffixes of code files
CODE_SUFFIXES = ["py", "js", "jsx", "ts", "tsx", "java", "go", "rs", "c", "cc", "cpp", "h", "hpp", "cs", "php", "rb", "kt", "swift", "scala"]


def counted(runs: DataFrame, arm: str = "arm") -> DataFrame:
    """Completed runs with ``ok``: the verdict; an empty patch without a verdict failed, but only in an arm that has
    verdicts at all; other runs without a verdict stay null.

    ``runs`` (arm, completed, resolved, patch); those excluded from adoption carry ``excluded``.
    """
    done = runs.where(F.col("completed") & ~F.coalesce("excluded", F.lit(False)) if "excluded" in runs.columns else F.col("completed"))
    judged = done.groupBy(arm).agg(F.max(F.col("resolved").isNotNull()).alias("__judged"))
    ok = F.when(F.col("resolved").isNotNull(), F.col("resolved")).when(F.col("__judged") & (F.coalesce("patch", F.lit("")) == ""), F.lit(False))
    return done.join(judged, arm).withColumn("ok", ok).drop("__judged")


def arm_table(runs: DataFrame, metrics: list[str], rates: dict[str, Column], arm: str = "arm") -> DataFrame:
    """(arm, n, mean_m and median_m of each metric, rate of each condition)."""
    six = lambda c: F.round(c, 6)
    cols = [c for m in metrics for c in (six(F.avg(m)).alias(f"mean_{m}"), six(F.percentile(m, 0.5)).alias(f"median_{m}"))]
    return runs.groupBy(arm).agg(F.count("*").alias("n"), *cols, *[six(F.avg(c.cast("double"))).alias(n) for n, c in rates.items()])


def first_last(calls: DataFrame, run: str, order: str, value: str) -> DataFrame:
    """(run, calls, first, last): the value of a run's first and last search."""
    return calls.groupBy(run).agg(F.count("*").alias("calls"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def peak_context(turns: DataFrame, run: str, fresh: Column, cache_read: Column, cache_written: Column) -> DataFrame:
    """(run, peak): the greatest prompt of a run."""
    return turns.groupBy(run).agg(F.max(fresh + cache_read + cache_written).alias("peak"))


def memorisation(runs: DataFrame, arm: str = "arm") -> DataFrame:
    """(arm, n, median_first, fast, reads) over solved runs: when gold was first read, how often at once, files read.

    ``runs`` (arm, ok, first_gold_turn, reads); arms that never read gold are left out.
    """
    solved = runs.where("ok").groupBy(arm).agg(
        F.count("*").alias("n"), F.percentile("first_gold_turn", 0.5).alias("median_first"),
        F.round(F.avg((F.col("first_gold_turn") <= 1).cast("double")), 6).alias("fast"), F.round(F.avg("reads"), 6).alias("reads"),
    )
    return solved.where("median_first IS NOT NULL")


def localisation(ranked: DataFrame, gold: DataFrame, grain: str, k: int = 10) -> DataFrame:
    """(query_id, recall, hit, rank) of ranked (query_id, rank, grain) against gold (query_id, grain): how much of the gold
    is among the k first, whether any is, and the first that is (0 for none)."""
    wanted = gold.select("query_id", grain).distinct()
    n = wanted.groupBy("query_id").agg(F.count("*").alias("n"))
    met = ranked.where(F.col("rank") <= k).join(wanted, ["query_id", grain]).groupBy("query_id").agg(F.countDistinct(grain).alias("met"), F.min("rank").alias("first"))
    out = n.join(met, "query_id", "left")
    return out.select("query_id", F.round(F.coalesce("met", F.lit(0)) / F.col("n"), 6).alias("recall"), F.col("met").isNotNull().cast("long").alias("hit"), F.coalesce("first", F.lit(0)).cast("long").alias("rank"))


def audit(instances: DataFrame, tests: DataFrame, key: str = "task") -> DataFrame:
    """(task, executed, resolved): an instance is executed if it reported any test; its verdict stands, else all of its
    tests must have passed; what wasn't executed has no verdict.  ``instances`` (task, verdict), ``tests`` (task, passed).
    """
    ran = tests.groupBy(key).agg(F.min(F.coalesce("passed", F.lit(False))).alias("all_passed"))
    rows = instances.join(ran, key, "left")
    executed = F.col("all_passed").isNotNull()
    return rows.select(key, executed.alias("executed"), F.when(executed, F.coalesce("verdict", "all_passed")).alias("resolved"))


def code_gold(tasks: DataFrame, gold: str = "gold") -> DataFrame:
    """Tasks with the gold that is code (``a/b.py`` or ``a/b.py::name``); tasks without any go."""
    suffix = lambda g: F.lower(F.regexp_extract(F.split_part(g, F.lit("::"), F.lit(1)), r"\.([A-Za-z]+)$", 1))
    return tasks.withColumn(gold, F.filter(gold, lambda g: suffix(g).isin(CODE_SUFFIXES))).where(F.size(gold) > 0)


def same_function(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, gold, rank): gold names matched exactly, or by file and last name; the best rank of each.

    ``ranked`` (query_id, fqn, rank), ``gold`` (query_id, fqn).
    """
    parts = lambda df: df.withColumn("file", F.split_part("fqn", F.lit("::"), F.lit(1))).withColumn("last", F.regexp_extract("fqn", r"([^.:]+)$", 1))
    g = parts(gold).select("query_id", F.col("fqn").alias("gold"), "file", "last")
    return g.join(parts(ranked).drop("fqn"), ["query_id", "file", "last"]).groupBy("query_id", "gold").agg(F.min("rank").alias("rank"))


def phase_share(rows: DataFrame, phase: str, tokens: str) -> DataFrame:
    """(phase, tokens, share): what each phase took of all tokens."""
    per = rows.groupBy(phase).agg(F.sum(tokens).cast("long").alias("tokens"))
    whole = per.agg(F.sum("tokens")).first()[0] or 1
    return per.withColumn("share", F.round(F.col("tokens") / float(whole), 6))


def first_reach(calls: DataFrame, gold: DataFrame) -> DataFrame:
    """(run, tool, ord, by_search): the call that first showed a gold item.  ``calls`` (run, ord, tool, is_search, item)."""
    hits = calls.join(gold, ["run", "item"], "left_semi")
    return hits.groupBy("run").agg(F.min(F.struct("ord", "tool", "is_search")).alias("m")).select("run", F.col("m.tool").alias("tool"), F.col("m.ord").alias("ord"), F.col("m.is_search").alias("by_search"))


def savings(turns: DataFrame, by: str, sent: Column, raw: Column, price: float = 3.0) -> DataFrame:
    """(by, sent, raw, ratio, saved): tokens sent and those of the whole files, and what the difference costs (prices are
    for a million tokens)."""
    out = turns.groupBy(by).agg(F.sum(sent).cast("long").alias("sent"), F.sum(raw).cast("long").alias("raw"))
    return out.withColumn("ratio", F.round(F.col("raw") / F.greatest(F.col("sent"), F.lit(1)), 6)).withColumn("saved", F.round((F.col("raw") - F.col("sent")) * price / 1_000_000, 9))


def capped_loops(events: DataFrame, by: str, order: str, query: str, failed: Column, repeats: int = 3, unique: int = 25, fails: int = 6) -> DataFrame:
    """Events with ``stop``: ``repeat`` from the ``repeats``-th time of a query on, ``unique`` beyond so many different
    queries, ``failed`` from so many failed edits on; the first that applies."""
    upto = W.partitionBy(by).orderBy(order)
    times = F.row_number().over(W.partitionBy(by, query).orderBy(order))
    e = events.withColumn("__times", times).withColumn("__fresh", (F.col("__times") == 1).cast("long")).withColumn("__failed", failed.cast("long"))
    e = e.withColumn("__unique", F.sum("__fresh").over(upto)).withColumn("__fails", F.sum("__failed").over(upto))
    stop = F.when(F.col("__times") >= repeats, "repeat").when(F.col("__unique") > unique, "unique").when(F.col("__fails") >= fails, "failed")
    return e.withColumn("stop", stop).drop("__times", "__fresh", "__failed", "__unique", "__fails")
