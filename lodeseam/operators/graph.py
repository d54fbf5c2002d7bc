"""Graph operators over ``edges`` (src, dst, and optionally etype, line, conf) and ``nodes`` (node).

Searches run from many starts at once: ``starts`` (start).  Each hop joins the frontier to the edges on the node, keeps
what wasn't seen, and is written to the shared folder, so that lineage stays short and lost executors cost one hop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.session import discard, persisted, scope

# fixed values: edge types, and those that tie symbols closely
EDGE_TYPES = ["calls", "imports", "inherits", "implements", "constructs", "decorates", "overrides", "tests", "raises", "type_depends"]
STRONG_TYPES = ["calls", "inherits", "implements", "constructs", "overrides"]
#: Values that the driver may put in order.
ORDERED = 10_000


def build(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes of all inputs and of the edges' ends; edges without exact repeats."""
    every = reduce(DataFrame.unionByName, edges).dropDuplicates()
    ends = every.select(F.explode(F.array("src", "dst")).alias("node"))
    return reduce(DataFrame.unionByName, [n.select("node") for n in nodes], ends).distinct(), every


def of_types(edges: DataFrame, types: list[str] | None) -> DataFrame:
    return edges.where(F.col("etype").isin(types)) if types else edges


def reverse(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def bfs(spark: SparkSession, edges: DataFrame, starts: DataFrame, depth: int, *, types: list[str] | None = None, direction: str = "forward") -> DataFrame:
    """(start, node, dist): least hops from each start; the start itself isn't listed."""
    edges = of_types(edges, types)
    if direction == "both":
        edges = edges.select("src", "dst").unionByName(reverse(edges).select("src", "dst"))
    elif direction == "reverse":
        edges = reverse(edges)
    with scope(spark) as keep:
        hops = persisted(spark, edges.select("src", "dst").distinct(), "hops")
        seen = starts.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("dist")).distinct()
        frontier = seen
        for d in range(1, depth + 1):
            step = frontier.select("start", F.col("node").alias("src")).join(hops, "src").select("start", F.col("dst").alias("node")).distinct()
            new = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("dist", F.lit(d).cast("long"))
            frontier = persisted(spark, new, "bfs")
            if d < depth and frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        return keep(seen.where("dist > 0"), "reached")


def blast_radius(spark: SparkSession, edges: DataFrame, starts: DataFrame, depth: int = 2, **how) -> DataFrame:
    return bfs(spark, edges, starts, depth, direction="reverse", **how)


def dependency_chain(spark: SparkSession, edges: DataFrame, starts: DataFrame, depth: int = 3, **how) -> DataFrame:
    return bfs(spark, edges, starts, depth, **how)


def shortest_paths(spark: SparkSession, edges: DataFrame, pairs: DataFrame, max_hops: int = 10) -> DataFrame:
    """(a, b, hops, path) over undirected edges: of the shortest paths the one least in lexical order.

    Searches from both ends meet over an edge.  Each round looks whether an edge ties the two frontiers, by whichever
    join has less to do, and then takes the side forward whose frontier has fewer edges: hubs are passed through only
    where no shorter way is left.
    """
    with scope(spark) as keep:
        both = persisted(spark, edges.select("src", "dst").unionByName(reverse(edges).select("src", "dst")).distinct(), "hops")
        degrees = persisted(spark, both.groupBy("src").agg(F.count("*").alias("deg")), "degrees")
        asked = persisted(spark, pairs.select("a", "b").distinct(), "pairs")
        done = asked.where("a = b").select("a", "b", F.array("a").alias("path"))
        front = {end: asked.where("a <> b").select("a", "b", F.col(end).alias("at"), F.array(end).alias("path")) for end in "ab"}
        seen = {end: f.select("a", "b", "at") for end, f in front.items()}
        for hop in range(1, max_hops + 1):
            sums = {end: f.join(degrees, F.col("at") == F.col("src")).groupBy("a", "b").agg(F.count("*").alias(f"n_{end}"), F.sum("deg").alias(f"d_{end}")) for end, f in front.items()}
            to_do = sums["a"].join(sums["b"], ["a", "b"]).agg(F.sum("d_a").alias("a"), F.sum("d_b").alias("b"), F.sum(F.col("n_a") * F.col("n_b")).alias("pairs")).first()
            if not to_do["pairs"]:
                break
            x, y = front["a"], front["b"].select("a", "b", F.col("at").alias("to"), F.col("path").alias("rest"))
            if to_do["pairs"] <= to_do["a"]:
                met = x.join(y, ["a", "b"]).join(both, (F.col("at") == F.col("src")) & (F.col("to") == F.col("dst")), "left_semi")
            else:
                met = x.join(both, F.col("at") == F.col("src")).withColumnRenamed("dst", "to").join(y, ["a", "b", "to"])
            hit = persisted(spark, met.groupBy("a", "b").agg(F.min(F.concat("path", "rest")).alias("path")), "paths")
            found = not hit.isEmpty()
            done = done.unionByName(hit) if found else done
            if hop == max_hops:  # a further step, which may lead through hubs, would never be looked at
                break
            if found:
                front = {end: persisted(spark, f.join(hit.select("a", "b"), ["a", "b"], "left_anti"), "frontier") for end, f in front.items()}
            end = "a" if to_do["a"] <= to_do["b"] else "b"
            path = F.concat("path", F.array("dst")) if end == "a" else F.concat(F.array("dst"), "path")
            step = front[end].join(both, F.col("at") == F.col("src")).select("a", "b", F.col("dst").alias("at"), path.alias("path"))
            new = step.groupBy("a", "b", "at").agg(F.min("path").alias("path")).join(seen[end], ["a", "b", "at"], "left_anti")
            front[end] = persisted(spark, new, "frontier")
            seen[end] = seen[end].unionByName(front[end].select("a", "b", "at"))
        return keep(done.select("a", "b", (F.size("path") - 1).cast("long").alias("hops"), "path"), "shortest")


def bridge_counts(spark: SparkSession, edges: DataFrame, left: DataFrame, right: DataFrame, seeds: int = 6, depth: int = 3, pairs: int = 24) -> DataFrame:
    """(query_id, doc_id, n): how many shortest paths between two lists' first seeds pass a node."""
    a = left.where(F.col("rank") <= seeds).select("query_id", F.col("doc_id").alias("a"), F.col("rank").alias("ra"))
    b = right.where(F.col("rank") <= seeds).select("query_id", F.col("doc_id").alias("b"), F.col("rank").alias("rb"))
    every = a.join(b, "query_id").where("a <> b").withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("ra") + F.col("rb"), "ra"))).where(F.col("n") <= pairs)
    paths = shortest_paths(spark, edges, every.select("a", "b").distinct(), depth)
    return every.join(paths, ["a", "b"]).select("query_id", F.explode("path").alias("doc_id")).groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))


def error_traces(edges: DataFrame, starts: DataFrame, max_nodes: int = 5) -> DataFrame:
    """(start, path): simple paths of calls, of 2 to ``max_nodes`` nodes, to nodes that raise something."""
    calls = of_types(edges, ["calls"]).select("src", "dst").distinct()
    raisers = of_types(edges, ["raises"]).select(F.col("src").alias("at")).distinct()
    grown = starts.select("start", F.col("start").alias("at"), F.array("start").alias("path"))
    out = None
    for _ in range(max_nodes - 1):
        grown = grown.join(calls, grown["at"] == calls["src"]).where(~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        hit = grown.join(raisers, "at", "left_semi").select("start", "path")
        out = hit if out is None else out.unionByName(hit)
    return out


def test_coverage(edges: DataFrame) -> DataFrame:
    """(node, test)."""
    return of_types(edges, ["tests"]).select(F.col("dst").alias("node"), F.col("src").alias("test")).distinct()


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "node", "left_anti"), left


def in_degree(edges: DataFrame) -> DataFrame:
    """(node, hub): in-edges, repeats included, over the greatest number of them."""
    counts = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("deg"))
    most = counts.agg(F.max("deg")).first()[0] or 1
    return counts.select("node", "deg", F.round(F.col("deg") / F.lit(float(most)), 6).alias("hub"))


def hubs(scores: DataFrame, share: float = 0.2, value: str = "score") -> DataFrame:
    """Nodes that reach the value at place int(n * share) of the descending order (ties included).

    The place is looked for among counts of distinct values, in ever smaller ranges of them, so that no task or driver
    orders more than ``ORDERED`` values.
    """
    counts = scores.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")).where("v IS NOT NULL")
    n, values = counts.agg(F.sum("c"), F.count("*")).first()
    if not n:
        return scores.limit(0)
    at = min(n - 1, int(n * share))
    while values > ORDERED:
        cuts = sorted(set(counts.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000)).first()[0]))
        above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= F.col("v")))
        parts = counts.groupBy(above.alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        for p in parts:
            if at < p["c"]:
                break
            at -= p["c"]
        if p["n"] == values:
            break
        counts, values = counts.where(F.col("v").between(p["lo"], p["hi"])), p["n"]
    for v, c in counts.orderBy(F.desc("v")).collect():
        if at < c:
            break
        at -= c
    return scores.where(F.col(value) >= v)


def pagerank(spark: SparkSession, nodes: DataFrame, edges: DataFrame, *, damping: float = 0.85, tol: float = 1e-6, max_iter: int = 100, restart: DataFrame | None = None) -> DataFrame:
    """(node, score): uniform start, parallel edges as one, dangling mass spread evenly; ends with the first round that
    changes the scores by less than ``tol`` in all.  With ``restart`` (node, weight) walks begin, and dangling mass
    goes, where the weights say.

    The structure is written once; each round joins the scores to it, sums by target with a combine before the shuffle,
    and is written with the scores before it, from which the next round's dangling mass and the change are read.
    """
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    with scope(spark) as keep:
        links = edges.select("src", "dst").distinct()
        out = persisted(spark, links.groupBy("src").agg(F.count("*").alias("deg")), "pr-degrees")
        links = persisted(spark, links.join(out, "src"), "pr-links")
        start = nodes.select("node").join(out.withColumnRenamed("src", "node"), "node", "left")
        if restart is None:
            start = start.withColumn("home", F.lit(1.0 / n))
        else:
            whole = float(restart.agg(F.sum("weight")).first()[0] or 1.0)
            start = start.join(restart.groupBy("node").agg((F.sum("weight") / whole).alias("home")), "node", "left").fillna(0.0, ["home"])
        ranks = persisted(spark, start.select("node", F.col("home").alias("score"), F.col("deg").isNull().alias("dangling"), F.lit(0.0).alias("old"), "home"), "pr-ranks")
        for _ in range(max_iter):
            change, lost = ranks.agg(F.sum(F.abs(F.col("score") - F.col("old"))), F.sum(F.when(F.col("dangling"), F.col("score")).otherwise(0.0))).first()
            if tol and change < tol:
                break
            sent = links.join(ranks.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") / F.col("deg")).alias("got"))
            score = (1 - damping) * F.col("home") + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost) * F.col("home"))
            before, ranks = ranks, persisted(spark, ranks.join(sent, "node", "left").select("node", score.alias("score"), "dangling", F.col("score").alias("old"), "home"), "pr-ranks")
            discard(before)
        return keep(ranks.select("node", "score"), "pagerank")


def top_ranked(scores: DataFrame, symbols: DataFrame, k: int = 20) -> DataFrame:
    """The k best that are symbols: phantom nodes are joined away before the cut."""
    return scores.join(symbols.select("node"), "node", "left_semi").orderBy(F.desc("score"), "node").limit(k)


def edge_text(edges: DataFrame, cap: int = 20) -> DataFrame:
    """(node, text): "a calls b; ..." of up to ``cap`` of a node's edges."""
    rows = edges.select(F.col("src").alias("node"), F.concat_ws(" ", "src", "etype", "dst").alias("t")).distinct()
    few = rows.withColumn("n", F.row_number().over(W.partitionBy("node").orderBy("t"))).where(F.col("n") <= cap)
    return few.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("t")), "; ").alias("text"))


def neighbours(edges: DataFrame, node: DataFrame, cap: int = 20) -> DataFrame:
    """(node, other, side, etype): callers and callees, up to ``cap`` of each."""
    out = edges.join(node, edges["src"] == node["node"]).select("node", F.col("dst").alias("other"), F.lit("out").alias("side"), "etype")
    into = edges.join(node, edges["dst"] == node["node"]).select("node", F.col("src").alias("other"), F.lit("in").alias("side"), "etype")
    rows = out.unionByName(into).distinct()
    return rows.withColumn("n", F.row_number().over(W.partitionBy("node", "side").orderBy("other", "etype"))).where(F.col("n") <= cap).drop("n")


def reachable_within(spark: SparkSession, edges: DataFrame, starts: DataFrame, depth: int = 6, file: Column | None = None) -> DataFrame:
    """(start, reachable, files): nodes within ``depth`` hops forward or backward, and the files of these and the start.

    ``file`` tells a column ``node``'s file: what stands before ``::`` unless given.
    """
    both = bfs(spark, edges, starts, depth).unionByName(bfs(spark, edges, starts, depth, direction="reverse")).select("start", "node").distinct()
    every = both.withColumn("far", F.lit(1)).unionByName(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("far")))
    of = F.split_part("node", F.lit("::"), F.lit(1)) if file is None else file
    return every.groupBy("start").agg(F.sum("far").alias("reachable"), F.countDistinct(of).alias("files"))
