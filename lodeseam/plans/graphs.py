"""Graph queries: graph A is customer -> supplier purchases, graph B part -> supplier, graph C page -> host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.operators import graph as g
from lodeseam.plans.registry import query, table


def graph_a(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()


def graph_b(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    etype = F.when(F.col("l_returnflag") == "R", "tests").when(F.col("l_returnflag") == "A", "raises").otherwise("calls")
    return rows.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), etype.alias("etype")).distinct()


A = "ea AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
B = "eb AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, CASE l_returnflag WHEN 'R' THEN 'tests' WHEN 'A' THEN 'raises' ELSE 'calls' END AS etype FROM lineitem)"


def graph_d(spark: SparkSession, d: str) -> DataFrame:
    """Of graph B the bulk purchases, of 50 pieces: a sparse graph with long paths."""
    rows = table(spark, d, "lineitem").where("l_quantity >= 50").select("l_partkey", "l_suppkey", "l_returnflag")
    etype = F.when(F.col("l_returnflag") == "R", "raises").otherwise("calls")
    return rows.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), etype.alias("etype")).distinct()


D = "ed AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, CASE l_returnflag WHEN 'R' THEN 'raises' ELSE 'calls' END AS etype FROM lineitem WHERE l_quantity >= 50)"
# Searches start from every node whose id is divisible by 20.
PARTS, SUPPLIERS, CUSTOMERS = "SELECT 'p' || p_partkey AS start FROM part WHERE p_partkey % 20 = 0", "SELECT 's' || s_suppkey AS start FROM supplier WHERE s_suppkey % 20 = 0", "SELECT 'c' || c_custkey AS start FROM customer WHERE c_custkey % 20 = 0"


def starts(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    return table(spark, d, name).where(F.col(key) % 20 == 0).select(F.concat(F.lit(name[0]), key).alias("start"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return starts(spark, d, "part", "p_partkey")


def _bfs_sql(edges: str, first: str, depth: int, extra: str = "") -> str:
    return f"""WITH RECURSIVE {edges}, st AS ({first}), r AS (SELECT start, start AS node, 0 AS dist FROM st
      UNION SELECT r.start, e.dst, r.dist + 1 FROM r JOIN e ON e.src = r.node WHERE r.dist < {depth})
      SELECT start, node, min(dist)::BIGINT AS dist FROM r WHERE node <> start {extra} GROUP BY start, node"""


@query("bfs_forward", _bfs_sql(f"{D}, e AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed)", PARTS, 3))
def bfs_forward(spark: SparkSession, d: str) -> DataFrame:
    return g.bfs(spark, graph_d(spark, d), parts(spark, d), 3, direction="both")


@query("bfs_reverse", _bfs_sql(f"{A}, e AS (SELECT dst AS src, src AS dst FROM ea)", SUPPLIERS, 2))
def bfs_reverse(spark: SparkSession, d: str) -> DataFrame:
    return g.blast_radius(spark, graph_a(spark, d), starts(spark, d, "supplier", "s_suppkey"))


@query("bfs_typed", _bfs_sql(f"{D}, e AS (SELECT src, dst FROM ed WHERE etype = 'calls' UNION SELECT dst, src FROM ed WHERE etype = 'calls')", PARTS, 3))
def bfs_typed(spark: SparkSession, d: str) -> DataFrame:
    return g.bfs(spark, graph_d(spark, d), parts(spark, d), 3, types=["calls"], direction="both")


@query("dependency_chain", _bfs_sql(f"{A}, e AS (SELECT * FROM ea)", CUSTOMERS, 3))
def dependency_chain(spark: SparkSession, d: str) -> DataFrame:
    return g.dependency_chain(spark, graph_a(spark, d), starts(spark, d, "customer", "c_custkey"))


@query(
    "shortest_path_len",
    f"""WITH RECURSIVE {D}, u AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), pr AS (SELECT 'p' || p_partkey AS a, 'p' || (p_partkey + 20) AS b FROM part WHERE p_partkey % 20 = 0),
      r AS (SELECT a, b, a AS cur, 0 AS hops FROM pr UNION SELECT a, b, u.dst, hops + 1 FROM r JOIN u ON u.src = r.cur WHERE hops < 10)
      SELECT a, b, min(hops)::BIGINT AS hops FROM r WHERE cur = b GROUP BY a, b""",
)
def shortest_path_len(spark: SparkSession, d: str) -> DataFrame:
    """The path too: its hops are checked by the twin, its steps by a test."""
    key = F.col("p_partkey")
    pairs = table(spark, d, "part").where(key % 20 == 0).select(F.concat(F.lit("p"), key).alias("a"), F.concat(F.lit("p"), key + 20).alias("b"))
    return g.shortest_paths(spark, graph_d(spark, d), pairs).select("a", "b", "hops")


@query(
    "simple_paths_to_raisers",
    f"""WITH RECURSIVE {D}, cl AS (SELECT src, dst FROM ed WHERE etype = 'calls' UNION SELECT dst, src FROM ed WHERE etype = 'calls'), ra AS (SELECT DISTINCT src FROM ed WHERE etype = 'raises'), st AS ({PARTS}),
      r AS (SELECT start, start AS cur, [start] AS path FROM st UNION ALL SELECT start, cl.dst, list_append(path, cl.dst) FROM r JOIN cl ON cl.src = r.cur WHERE len(path) < 5 AND NOT list_contains(path, cl.dst))
      SELECT start, array_to_string(path, '>') AS path FROM r WHERE len(path) > 1 AND cur IN (SELECT src FROM ra)""",
)
def simple_paths_to_raisers(spark: SparkSession, d: str) -> DataFrame:
    e = graph_d(spark, d)
    both = e.unionByName(g.reverse(g.of_types(e, ["calls"])).select(e.columns)).distinct()
    return g.error_traces(both, parts(spark, d)).select("start", F.array_join("path", ">").alias("path"))


@query("hub_scores", f"WITH {A}, c AS (SELECT dst AS node, count(*) AS deg FROM ea GROUP BY dst) SELECT node, deg::BIGINT AS deg, round(deg / max(deg) OVER ()::DOUBLE, 6) AS hub FROM c")
def hub_scores(spark: SparkSession, d: str) -> DataFrame:
    return g.in_degree(graph_a(spark, d))


@query("hub_top20pct", f"WITH {A}, c AS (SELECT dst AS node, count(*) AS deg FROM ea GROUP BY dst), r AS (SELECT *, row_number() OVER (ORDER BY deg DESC) - 1 AS p, count(*) OVER () AS n FROM c) SELECT node, deg::BIGINT AS deg FROM c WHERE deg >= (SELECT min(deg) FROM r WHERE p <= (n * 0.2::DOUBLE)::INT AND p <= floor(n * 0.2::DOUBLE))")
def hub_top20pct(spark: SparkSession, d: str) -> DataFrame:
    return g.hubs(g.in_degree(graph_a(spark, d)), 0.2, "deg").select("node", "deg")


@query("induced_subgraph", f"WITH {B}, big AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size >= 40), rich AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_acctbal > 0) SELECT src, dst, etype FROM eb WHERE src IN (SELECT node FROM big) AND dst IN (SELECT node FROM rich)")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "part").where("p_size >= 40").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    rich = table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return g.subgraph(graph_b(spark, d), big.unionByName(rich)).select("src", "dst", "etype")


@query("remove_node", f"WITH {A}, gone AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0) SELECT count(*)::BIGINT AS edges, count(DISTINCT src)::BIGINT AS sources FROM ea WHERE src NOT IN (SELECT node FROM gone) AND dst NOT IN (SELECT node FROM gone)")
def remove_node(spark: SparkSession, d: str) -> DataFrame:
    e = graph_a(spark, d)
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("node")).unionByName(table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node")))
    _, left = g.remove_nodes(e.select(F.col("src").alias("node")).distinct(), e, gone)
    return left.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))


@query("test_coverage_like", f"WITH {B} SELECT DISTINCT dst AS node, src AS test FROM eb WHERE etype = 'tests'")
def test_coverage_like(spark: SparkSession, d: str) -> DataFrame:
    return g.test_coverage(graph_b(spark, d))


@query("edge_summary", f"WITH {B}, t AS (SELECT DISTINCT src AS node, src || ' ' || etype || ' ' || dst AS t FROM eb), k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY t) AS n FROM t) SELECT node, string_agg(t, '; ' ORDER BY t) AS text FROM k WHERE n <= 20 GROUP BY node")
def edge_summary(spark: SparkSession, d: str) -> DataFrame:
    return g.edge_text(graph_b(spark, d))


@query("neighbour_list", f"WITH {B}, st AS ({PARTS} UNION ALL {SUPPLIERS}), x AS (SELECT DISTINCT src AS node, dst AS other, 'out' AS side, etype FROM eb WHERE src IN (SELECT start FROM st) UNION SELECT DISTINCT dst, src, 'in', etype FROM eb WHERE dst IN (SELECT start FROM st)) SELECT node, other, side, etype FROM (SELECT *, row_number() OVER (PARTITION BY node, side ORDER BY other, etype) AS n FROM x) WHERE n <= 20")
def neighbour_list(spark: SparkSession, d: str) -> DataFrame:
    nodes = parts(spark, d).unionByName(starts(spark, d, "supplier", "s_suppkey")).withColumnRenamed("start", "node")
    return g.neighbours(graph_b(spark, d), nodes).select("node", "other", "side", "etype")


_PR = "r{i} AS (SELECT n.node, 0.15::DOUBLE / cnt + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT sum(score) FROM r{j} WHERE node NOT IN (SELECT src FROM od)) / cnt) AS score FROM nd n LEFT JOIN (SELECT ea.dst AS node, sum(r.score / od.deg) AS got FROM ea JOIN od ON od.src = ea.src JOIN r{j} r ON r.node = ea.src GROUP BY ea.dst) g ON g.node = n.node, nc)"


@query(
    "pagerank_10",
    f"WITH {A}, nd AS (SELECT src AS node FROM ea UNION SELECT dst FROM ea), nc AS (SELECT count(*)::DOUBLE AS cnt FROM nd), od AS (SELECT src, count(*) AS deg FROM ea GROUP BY src), r0 AS (SELECT node, 1 / cnt AS score FROM nd, nc), "
    + ", ".join(_PR.format(i=i, j=i - 1).replace("AS (", "AS MATERIALIZED (", 1) for i in range(1, 11))
    + " SELECT node, round(score, 9) AS score FROM r10",
)
def pagerank_10(spark: SparkSession, d: str) -> DataFrame:
    e = graph_a(spark, d)
    nodes, edges = g.build([e.select(F.col("src").alias("node"))], [e])
    return g.pagerank(spark, nodes, edges, tol=0.0, max_iter=10).select("node", F.round("score", 9).alias("score"))


@query("href_edges", "SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1)) AS target FROM pages")
def href_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), 1)).alias("target"))


@query("reachable_within", _bfs_sql(f"{D}, e AS (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed)", PARTS, 6).replace("SELECT start, node, min(dist)::BIGINT AS dist FROM r WHERE node <> start  GROUP BY start, node", "SELECT start, count(DISTINCT node)::BIGINT AS reachable, count(DISTINCT left(node, 1))::BIGINT AS files FROM (SELECT * FROM r UNION ALL SELECT start, start, 0 FROM st) GROUP BY start").replace("count(DISTINCT node)", "count(DISTINCT node) - 1"))
def reachable_within(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of the nodes stand for their files."""
    e = graph_d(spark, d)
    return g.reachable_within(spark, e.select("src", "dst").unionByName(g.reverse(e).select("src", "dst")), parts(spark, d), file=F.substring("node", 1, 1)).select("start", "reachable", "files")
