"""Scoring and resolution of candidates: composite score, confidence, gated expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.functions import rules
from lodeseam.operators import graph
from lodeseam.session import persisted


def composite_score(distance: Column, hub: Column, complexity: Column, is_test: Column, exported: Column, same_file: Column, auto_ctor: Column, lexical: Column | None = None) -> Column:
    """Weighted signals, rounded to 2 places; 8 for a full lexical score on top."""
    # fixed values: weights of the signals
    w_dist, w_hub, w_complex, w_test, w_public, w_file, w_ctor, w_lexical = 10.0, 3.0, 1.5, 4.0, 2.0, 3.0, 5.0, 8.0
    on = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    s = F.when(distance == 0, w_dist).when(distance > 0, w_dist / distance).otherwise(0.0) + w_hub * hub
    s = s + F.when(complexity > 10, w_complex * 1.5).when(complexity > 5, w_complex).otherwise(0.0)
    s = F.round(s + on(is_test, w_test) + on(exported, w_public) + on(same_file, w_file) + on(auto_ctor, w_ctor), 2)
    return s if lexical is None else F.round(s + w_lexical * lexical, 2)


def _steps(value: Column, steps: list[tuple[int, float]], rest: float) -> Column:
    out = None
    for most, score in steps:
        out = F.when(value <= most, score) if out is None else out.when(value <= most, score)
    return out.otherwise(rest)


def confidence(source: Column, coverage: Column, targets: Column, reachable: Column, files: Column) -> Column:
    """Five factors, their weighted sum and its level; all zero where there is no target."""
    # fixed values: match sources, steps, weights and cuts
    match = F.when(source == "entity", 1.0).when(source == "slm", 0.7).when(source == "embedding", 0.55).when(source == "bm25", 0.5).when(source == "keyword", 0.4).otherwise(0.0)
    ambiguity = _steps(targets, [(1, 1.0), (3, 0.7), (5, 0.5), (10, 0.3)], 0.1)
    depth = _steps(reachable, [(5, 1.0), (15, 0.7), (30, 0.4)], 0.2)
    cross = _steps(files, [(1, 1.0), (2, 0.7), (3, 0.5), (5, 0.3)], 0.1)
    total = F.when(targets == 0, 0.0).otherwise(F.round(match * 0.35 + coverage * 0.25 + ambiguity * 0.15 + depth * 0.15 + cross * 0.10, 6))
    level = F.when(total >= 0.70, "HIGH").when(total >= 0.40, "MEDIUM").when(total >= 0.20, "LOW").otherwise("MISS")
    return F.struct(match.alias("entity_match"), coverage.alias("coverage"), ambiguity.alias("ambiguity"), depth.alias("dependency_depth"), cross.alias("cross_file"), total.alias("composite"), level.alias("level"))


def token_coverage(query: Column, names: Column) -> Column:
    """The share of a query's tokens that names or signatures hold (both as token arrays)."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, names)) / F.size(F.array_distinct(query))).otherwise(0.0)


def entity_matches(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, fqn): names of queries (query_id, name, path) resolved to symbols (fqn, file, last, member, exported).

    A match in the named file comes first, then the exact member or last segment, then what the file exports.
    """
    symbols = symbols.select("fqn", "file", "last", "member", "exported")
    j = names.join(symbols, (F.lower("name") == F.lower("last")) | (F.col("name") == F.col("member")))
    prio = F.when(F.col("file").endswith(F.coalesce("path", F.lit("\u0000"))), 1).otherwise(2)
    found = j.withColumn("p", prio)
    exported = names.where("path is not null").join(symbols.where("exported"), F.col("file").endswith(F.col("path"))).withColumn("p", F.lit(3))
    every = found.select("query_id", "name", "fqn", "p").unionByName(exported.select("query_id", "name", "fqn", "p"))
    best = every.withColumn("b", F.min("p").over(W.partitionBy("query_id", "name"))).where("p = b")
    return best.select("query_id", "fqn").distinct()


def expansion_plan(queries: DataFrame, policy: str = "gated") -> DataFrame:
    """(query_id, direction, blast, dep, seeds): how far the graph is followed for (query_id, text, mode, n_exact)."""
    terms = F.col("text").rlike(rules.RELATION)
    by_mode = rules.mode_value(F.col("mode"), 3, "none") != "none"
    on = {"off": F.lit(False), "always": F.lit(True)}.get(policy, terms | by_mode | F.col("n_exact").between(1, 3))
    few = F.col("n_exact").between(1, 3)
    cap = F.when(few & ~terms, 1).otherwise(2)
    rows = queries.where(on)
    direction = F.when(rules.mode_value(F.col("mode"), 3, "none") == "none", "both").otherwise(rules.mode_value(F.col("mode"), 3, "none"))
    return rows.select("query_id", direction.alias("direction"), F.least(cap, F.greatest(F.lit(1), rules.mode_value(F.col("mode"), 4, 1))).alias("blast"), F.least(cap, F.greatest(F.lit(1), rules.mode_value(F.col("mode"), 5, 1))).alias("dep"), F.lit(4).alias("seeds"))


def expand(spark: SparkSession, plan: DataFrame, candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates with what the graph adds: tier 2 at one hop, else 3; a node keeps its least distance."""
    seeds = candidates.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "fqn"))).join(plan, "query_id").where(F.col("n") <= F.col("seeds"))
    starts = seeds.select(F.col("fqn").alias("start")).distinct()
    out = candidates.select("query_id", "fqn", F.lit(1).alias("tier"), F.lit(0).cast("long").alias("dist"), F.lit("target").alias("reason"))
    for way, depth in (("reverse", "blast"), ("forward", "dep")):
        reached = graph.bfs(spark, edges, starts, 2, direction=way)
        mine = seeds.where(F.col("direction").isin("both", way)).select("query_id", F.col("fqn").alias("start"), F.col(depth).alias("most"))
        hops = mine.join(reached, "start").where(F.col("dist") <= F.col("most"))
        out = out.unionByName(hops.select("query_id", F.col("node").alias("fqn"), F.when(F.col("dist") == 1, 2).otherwise(3).alias("tier"), "dist", F.lit(way).alias("reason")))
    return out.groupBy("query_id", "fqn").agg(F.min(F.struct("tier", "dist", "reason")).alias("m")).select("query_id", "fqn", "m.*")


def with_constructors(candidates: DataFrame, symbols: DataFrame) -> DataFrame:
    """Constructors of candidate types: ``C.__init__``, ``C.constructor``, ``NewC``, ``newC``, ``C.new``."""
    file, last = F.split_part("fqn", F.lit("::"), F.lit(1)), F.split_part("fqn", F.lit("::"), F.lit(2))
    keys = F.array(*[F.concat(file, F.lit("::"), x) for x in (F.concat(last, F.lit(".__init__")), F.concat(last, F.lit(".constructor")), F.concat(F.lit("New"), last), F.concat(F.lit("new"), last), F.concat(last, F.lit(".new")))])
    new = candidates.select("query_id", F.explode(keys).alias("fqn")).distinct().join(symbols.select("fqn"), "fqn", "left_semi").join(candidates.select("query_id", "fqn"), ["query_id", "fqn"], "left_anti")
    return candidates.select("query_id", "fqn", "tier", "dist", "reason").unionByName(new.select("query_id", "fqn", F.lit(1).alias("tier"), F.lit(0).cast("long").alias("dist"), F.lit("constructor").alias("reason")))


def resolve(spark: SparkSession, queries: DataFrame, ranked: DataFrame, symbols: DataFrame, edges: DataFrame, policy: str = "gated", top: int = 50) -> DataFrame:
    """The whole way from queries (query_id, text) and a ranked pool (query_id, fqn, rank, score) to scored candidates."""
    t = F.col("text")
    # Written: the rules are long expressions, which a plan would repeat wherever their results are compared.
    paths = rules.intent_paths(t)
    asked = persisted(spark, queries.select("query_id", "text", rules.candidate_names(t).alias("names"), F.get(paths, F.lit(0)).alias("path"), rules.query_mode(t, F.size(paths) > 0).alias("mode")), "resolve-asked")
    entities = persisted(spark, entity_matches(asked.select("query_id", F.explode("names").alias("name"), "path"), symbols), "resolve-entities")
    exact = entities.groupBy("query_id").agg(F.count("*").alias("n_exact"))
    asked = persisted(spark, asked.join(exact, "query_id", "left").fillna(0, ["n_exact"]), "resolve-modes")
    pool = entities.select("query_id", "fqn", F.lit(0).cast("long").alias("rank"), F.lit(1.0).alias("s")).unionByName(ranked.select("query_id", "fqn", "rank", (F.col("score") / F.max("score").over(W.partitionBy("query_id"))).alias("s")))
    targets = persisted(spark, pool.groupBy("query_id", "fqn").agg(F.min("rank").alias("rank"), F.max("s").alias("lexical")), "resolve-targets")
    grown = with_constructors(expand(spark, expansion_plan(asked, policy), targets, edges), symbols).join(targets.select("query_id", "fqn", "lexical"), ["query_id", "fqn"], "left")
    hub = graph.in_degree(edges).select(F.col("node").alias("fqn"), "hub")
    rows = grown.join(symbols, "fqn").join(hub, "fqn", "left")
    score = composite_score(F.col("dist"), F.coalesce("hub", F.lit(0.0)), F.col("complexity"), F.lower("fqn").contains("test"), F.col("exported"), F.lit(False), F.col("kind") == "class", F.coalesce("lexical", F.lit(0.0)))
    order = W.partitionBy("query_id").orderBy("tier", F.desc("score"), "fqn")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("query_id", "fqn", "tier", "dist", "reason", "score", "rank")
