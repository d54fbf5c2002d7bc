"""Evaluation-run, context and fusion queries.  Orders stand for instances and their lines for tests; users are runs, their
events calls; parts and suppliers are files of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.functions import text as tx
from lodeseam.functions.words import QUERY_STOPS, SYMBOL_STOPS
from lodeseam.operators import context, evaluate, graph, trials
from lodeseam.operators import rank as rk
from lodeseam.plans.decisions import _QRELS
from lodeseam.plans.graphs import PARTS, A, D, graph_a, graph_d, parts
from lodeseam.plans.registry import query, sql_list, table
from lodeseam.plans.retrieval import BM25, BOTH, Lexical, corpus, exact_hits, groups, questions


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@query("run_audit", "SELECT o_orderkey AS task, n IS NOT NULL AS executed, CASE WHEN n IS NOT NULL THEN CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false ELSE all_passed END END AS resolved FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, bool_and(l_linestatus = 'F') AS all_passed FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def run_audit(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    tests = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), (F.col("l_linestatus") == "F").alias("passed"))
    return trials.audit(table(spark, d, "orders").select(F.col("o_orderkey").alias("task"), verdict.alias("verdict")), tests)


@query("arm_table", "SELECT event_type AS arm, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value, round(avg((value > 10)::INT), 6) AS high FROM events GROUP BY 1")
def arm_table(spark: SparkSession, d: str) -> DataFrame:
    return trials.arm_table(events(spark, d).withColumnRenamed("event_type", "arm"), ["value"], {"high": F.col("value") > 10})


@query("counted_runs", "WITH r AS (SELECT event_type AS arm, event_id, CASE WHEN event_id % 3 > 0 THEN value > 10 END AS resolved, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'x' END AS patch FROM events WHERE value > 1), o AS (SELECT arm, CASE WHEN resolved IS NOT NULL THEN resolved WHEN patch = '' AND max(resolved IS NOT NULL) OVER (PARTITION BY arm) THEN false END AS ok FROM r) SELECT arm, count(*)::BIGINT AS n, count(*) FILTER (ok)::BIGINT AS solved, count(*) FILTER (NOT ok)::BIGINT AS failed FROM o GROUP BY arm")
def counted_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = events(spark, d).select(F.col("event_type").alias("arm"), (F.col("value") > 1).alias("completed"), F.when(F.col("event_id") % 3 > 0, F.col("value") > 10).alias("resolved"), F.when(F.col("event_id") % 2 == 0, "").otherwise("x").alias("patch"))
    return trials.counted(runs).groupBy("arm").agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("solved"), F.count(F.when(~F.col("ok"), 1)).alias("failed"))


@query("first_last_search", "SELECT user_id, count(*)::BIGINT AS calls, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last FROM events GROUP BY 1")
def first_last_search(spark: SparkSession, d: str) -> DataFrame:
    return trials.first_last(events(spark, d), "user_id", "event_id", "event_type")


@query("peak_context", "SELECT conv_id, max(n + coalesce(before, 0))::BIGINT AS peak FROM (SELECT conv_id, turn, n, sum(n) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT conv_id, turn, sum(length(text) // 4) AS n FROM conversations GROUP BY ALL)) GROUP BY conv_id")
def peak_context(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.sum(tx.quarter_tokens(F.col("text"))).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    return trials.peak_context(turns.withColumn("before", before), "conv_id", F.col("n"), F.col("before"), F.lit(0))


_TURNS = "t AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM events), lo AS (SELECT min(event_type) AS gold FROM events)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("turn", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long"))


@query("memorisation", f"WITH {_TURNS}, r AS (SELECT user_id, 'arm' || user_id % 4 AS arm, max(value) > 20 AS ok, min(turn) FILTER (event_type = gold) AS first_gold_turn, count(*) FILTER (value > 5) AS reads FROM t, lo GROUP BY user_id) SELECT arm, count(*)::BIGINT AS n, median(first_gold_turn)::DOUBLE AS median_first, round(avg((first_gold_turn <= 1)::INT), 6) AS fast, round(avg(reads), 6) AS reads FROM r WHERE ok GROUP BY arm HAVING median(first_gold_turn) IS NOT NULL")
def memorisation(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    gold = t.agg(F.min("event_type")).first()[0]
    runs = t.groupBy("user_id").agg((F.max("value") > 20).alias("ok"), F.min(F.when(F.col("event_type") == gold, F.col("turn"))).alias("first_gold_turn"), F.count(F.when(F.col("value") > 5, 1)).alias("reads"))
    return trials.memorisation(runs.withColumn("arm", F.concat(F.lit("arm"), F.col("user_id") % 4)))


def _localisation_sql(grain: str) -> str:
    return f"WITH {BM25}, {_QRELS}, g AS (SELECT DISTINCT qr.query_id, {grain} AS x FROM qr JOIN documents d ON d.doc_id = qr.doc_id), t AS (SELECT bm.query_id, rank, {grain} AS x FROM bm JOIN documents d ON d.doc_id = bm.doc_id WHERE rank <= 10), m AS (SELECT query_id, count(DISTINCT x) AS met, min(rank) AS first FROM t JOIN g USING (query_id, x) GROUP BY 1) SELECT query_id, round(coalesce(met, 0) / n::DOUBLE, 6) AS recall, (met IS NOT NULL)::BIGINT AS hit, coalesce(first, 0)::BIGINT AS rank FROM (SELECT query_id, count(*) AS n FROM g GROUP BY 1) LEFT JOIN m USING (query_id)"


def _localised(spark: SparkSession, d: str, grain: str) -> DataFrame:
    x = Lexical(spark, d)
    named = groups(spark, d)
    return trials.localisation(rk.bm25(x.questions, x.postings, 10).join(named, "doc_id"), exact_hits(spark, d).join(named, "doc_id"), grain)


@query("localisation_files", _localisation_sql("d.source"))
def localisation_files(spark: SparkSession, d: str) -> DataFrame:
    return _localised(spark, d, "grp")


@query("localisation_functions", _localisation_sql("d.doc_id"))
def localisation_functions(spark: SparkSession, d: str) -> DataFrame:
    return _localised(spark, d, "doc_id")


@query("phase_share", "SELECT role, sum(length(text) // 4)::BIGINT AS tokens, round(sum(length(text) // 4) / (SELECT sum(length(text) // 4) FROM conversations)::DOUBLE, 6) AS share FROM conversations GROUP BY role")
def phase_share(spark: SparkSession, d: str) -> DataFrame:
    return trials.phase_share(table(spark, d, "conversations").withColumn("n", tx.quarter_tokens(F.col("text"))), "role", "n")


@query("first_reach", f"WITH {_TURNS}, g AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 20), h AS (SELECT t.*, row_number() OVER (PARTITION BY user_id ORDER BY turn) AS k FROM t JOIN g USING (user_id, event_type)) SELECT user_id AS run, event_type AS tool, turn AS ord, event_type = gold AS by_search FROM h, lo WHERE k = 1")
def first_reach(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    low = t.agg(F.min("event_type")).first()[0]
    calls = t.select(F.col("user_id").alias("run"), F.col("turn").alias("ord"), F.col("event_type").alias("tool"), (F.col("event_type") == low).alias("is_search"), F.col("event_type").alias("item"))
    return trials.first_reach(calls, t.where("value > 20").select(F.col("user_id").alias("run"), F.col("event_type").alias("item")).distinct())


@query("session_savings", "SELECT conv_id, sum(length(text) // 4)::BIGINT AS sent, sum(length(text))::BIGINT AS raw, round(sum(length(text)) / greatest(sum(length(text) // 4), 1)::DOUBLE, 6) AS ratio, round((sum(length(text)) - sum(length(text) // 4)) * 3.0::DOUBLE / 1000000, 9) AS saved FROM conversations GROUP BY conv_id")
def session_savings(spark: SparkSession, d: str) -> DataFrame:
    return trials.savings(table(spark, d, "conversations"), "conv_id", tx.quarter_tokens(F.col("text")), F.length("text"))


@query("capped_loops", "WITH e AS (SELECT event_id, user_id, (value <= 1)::INT AS failed, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS times FROM events), f AS (SELECT *, sum((times = 1)::INT) OVER w AS uniq, sum(failed) OVER w AS fails FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, CASE WHEN times >= 9 THEN 'repeat' WHEN uniq > 4 THEN 'unique' WHEN fails >= 2 THEN 'failed' END AS stop FROM f")
def capped_loops(spark: SparkSession, d: str) -> DataFrame:
    return trials.capped_loops(events(spark, d), "user_id", "event_id", "event_type", F.col("value") <= 1, repeats=9, unique=4, fails=2).select("event_id", "stop")


@query("bootstrap_mean_ci")
def bootstrap_mean_ci(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.bootstrap_mean(spark, events(spark, d).select(F.col("event_id").alias("id"), F.col("value").alias("a")))


# ---- context

_TREE = "fl AS (SELECT DISTINCT 'pkg' || p_size || '/sub/mod' || (p_partkey % 9) || '.py' AS path FROM part UNION SELECT DISTINCT 'pkg' || p_size || CASE p_partkey % 3 WHEN 0 THEN '/sub/tests/test_mod' WHEN 1 THEN '/sub/test_mod' ELSE '/sub/tests/deep/test_mod' END || (p_partkey % 9) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '_more' END || '.py' FROM part UNION SELECT 'tests/test_mod1.py')"


def tree(spark: SparkSession, d: str) -> DataFrame:
    p, key = table(spark, d, "part"), F.col("p_partkey")
    pkg, n = F.concat(F.lit("pkg"), "p_size"), F.concat(F.lit("mod"), key % 9)
    where = F.when(key % 3 == 0, "/sub/tests/test_").when(key % 3 == 1, "/sub/test_").otherwise("/sub/tests/deep/test_")
    made = p.select(F.concat(pkg, F.lit("/sub/"), n, F.lit(".py")).alias("path")).unionByName(p.select(F.concat(pkg, where, n, F.when(key % 2 == 0, "").otherwise("_more"), F.lit(".py")).alias("path")))
    return made.unionByName(spark.createDataFrame([("tests/test_mod1.py",)], "path string")).distinct()


@query(
    "test_paths",
    f"""WITH {_TREE}, s AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '([^/]*)\\.py$', 1) AS stem FROM fl WHERE NOT contains(path, 'test'))
    SELECT DISTINCT s.path, t.path AS test FROM s JOIN fl t ON t.path IN (parent || '/tests/test_' || stem || '.py', parent || '/test_' || stem || '.py', 'tests/test_' || stem || '.py')
      OR (starts_with(t.path, parent || '/tests/') AND (split_part(t.path, '/', -1) = 'test_' || stem || '.py' OR starts_with(split_part(t.path, '/', -1), 'test_' || stem || '_')))""",
)
def test_paths(spark: SparkSession, d: str) -> DataFrame:
    files = tree(spark, d)
    return context.test_paths(files.where(~F.col("path").contains("test")), files)


@query("notes_for", "WITH u AS (SELECT page_id, string_split(split_part(url, '://', 2), '/') AS parts FROM pages), f AS (SELECT page_id, array_to_string(parts, '/') AS path, unnest(list_slice(parts, 1, len(parts) - 1)) AS note FROM u) SELECT DISTINCT path, note FROM f WHERE note IN (SELECT DISTINCT lang FROM documents)")
def notes_for(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "pages").select(F.split_part("url", F.lit("://"), F.lit(2)).alias("path")).distinct()
    return context.notes_for(paths, table(spark, d, "documents").select(F.col("lang").alias("note")))


@query("follow_ups", "WITH t AS (SELECT conv_id, turn, role, text, list_slice(string_split(text, ' '), 1, 3) AS names FROM conversations), b AS (SELECT *, lag(names) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t) SELECT conv_id, turn, role, md5(text || CASE WHEN regexp_matches(text, '(?i)\\b(it|that|this|those|the same)\\b') AND (regexp_matches(text, '(?i)^\\s*(fix|debug|update|refactor|explain|test)\\s+(it|this|that)\\b') OR regexp_matches(text, '(?i)\\b(it|this|that)\\s+(is|was|has|should|doesn|does|needs|fails)')) AND len(before) > 0 THEN ' [context: ' || array_to_string(before, ', ') || ']' ELSE '' END) AS h FROM b")
def follow_ups(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").withColumn("names", F.slice(F.split("text", " "), 1, 3)).withColumn("at", F.struct("turn", "role", "text"))
    return context.follow_ups(t, "conv_id", "at").select("conv_id", "turn", "role", F.md5("resolved").alias("h"))


@query(
    "constants_of",
    "WITH " + BM25 + """, tp AS (SELECT query_id, source AS file, min(rank) AS rank FROM bm JOIN documents USING (doc_id) WHERE rank <= 20 GROUP BY ALL), pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, file) AS place FROM tp),
    k AS (SELECT 'src' || s_suppkey % 20 AS file, 'src' || s_suppkey % 20 || '::C' || s_suppkey AS fqn, s_suppkey AS first FROM supplier)
    SELECT query_id, fqn, n FROM (SELECT query_id, fqn, row_number() OVER (PARTITION BY query_id ORDER BY place, first, fqn) AS n FROM pl JOIN k USING (file) WHERE place <= 3) WHERE n <= 12""",
)
def constants_of(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    ranked = rk.bm25(x.questions, x.postings, 20).join(groups(spark, d), "doc_id").select("query_id", F.concat("grp", F.lit("::d"), "doc_id").alias("fqn"), "rank")
    file = F.concat(F.lit("src"), F.col("s_suppkey") % 20)
    constants = table(spark, d, "supplier").select(file.alias("file"), F.concat(file, F.lit("::C"), "s_suppkey").alias("fqn"), F.col("s_suppkey").alias("first"), F.col("s_name").alias("signature"))
    return context.constants_of(ranked, constants).select("query_id", "fqn", "n")


_TASKS = ["debug", "explain", "create", "review"]


@query(
    "expand_by_task",
    f"""WITH RECURSIVE {D}, st AS ({PARTS}), tg AS (SELECT start, {sql_list(_TASKS)}[p_size % 4 + 1] AS task FROM st JOIN part ON start = 'p' || p_partkey),
    u AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed WHERE etype = 'calls'),
    bk AS (SELECT start, start AS node, 0 AS dist FROM st UNION SELECT start, u.src, dist + 1 FROM bk JOIN u ON u.dst = node WHERE dist < 2), ah AS (SELECT start, start AS node, 0 AS dist FROM st UNION SELECT start, u.dst, dist + 1 FROM ah JOIN u ON u.src = node WHERE dist < 3),
    b AS (SELECT start, node, min(dist) AS dist FROM bk WHERE node <> start GROUP BY ALL), a AS (SELECT start, node, min(dist) AS dist FROM ah WHERE node <> start GROUP BY ALL),
    sy AS (SELECT 'p' || p_partkey AS fqn, p_brand || p_size AS file FROM part UNION ALL SELECT 's' || s_suppkey, 'sup' FROM supplier),
    x AS (SELECT start, node AS fqn, CASE WHEN dist = 1 THEN 2 ELSE 3 END AS tier, dist FROM tg JOIN b USING (start) WHERE task IN ('debug', 'review') UNION ALL SELECT start, node, CASE WHEN dist = 1 THEN 2 ELSE 3 END, dist FROM tg JOIN a USING (start) WHERE task = 'debug' AND dist <= 2
      UNION ALL SELECT start, node, CASE WHEN dist <= 2 THEN 2 ELSE 3 END, dist FROM tg JOIN a USING (start) WHERE task = 'explain' UNION ALL SELECT start, node, 2, 1 FROM tg JOIN b USING (start) WHERE task = 'explain' AND dist = 1
      UNION ALL SELECT start, m.fqn, 2, 1 FROM tg JOIN sy o ON o.fqn = start JOIN sy m ON m.file = o.file WHERE task = 'create')
    SELECT start, fqn, t.tier, t.dist::BIGINT AS dist FROM (SELECT start, fqn, min(struct_pack(tier := tier, dist := dist)) AS t FROM x JOIN sy USING (fqn) WHERE fqn <> start GROUP BY ALL)""",
)
def expand_by_task(spark: SparkSession, d: str) -> DataFrame:
    e = graph_d(spark, d)
    both = e.unionByName(graph.reverse(graph.of_types(e, ["calls"])).select(e.columns))
    p = table(spark, d, "part").withColumn("start", F.concat(F.lit("p"), "p_partkey"))
    task = F.element_at(F.array(*map(F.lit, _TASKS)), (F.col("p_size") % 4 + 1).cast("int"))
    targets = parts(spark, d).join(p, "start").select(F.col("start").alias("query_id"), F.col("start").alias("fqn"), task.alias("task"))
    symbols = p.select(F.col("start").alias("fqn"), F.concat("p_brand", "p_size").alias("file")).unionByName(table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("fqn"), F.lit("sup").alias("file")))
    return context.expand_by_task(spark, targets, both, symbols).select(F.col("query_id").alias("start"), "fqn", "tier", "dist")


@query("test_scores", "WITH q AS (SELECT item_id, list_distinct(list_filter(list_transform(string_split_regex(text, '[^a-zA-Z0-9]+'), lambda t: lower(t)), lambda t: length(t) > 2 AND NOT list_contains(" + sql_list(QUERY_STOPS) + ", t))) AS terms FROM benchmark), g AS (SELECT query_id, doc_id FROM (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))) SELECT g.query_id, g.doc_id, (2 * len(list_filter(terms, lambda t: contains(lower(text), t))) + len(list_filter(terms, lambda t: contains(lower(split_part(text, chr(10), 1)), t))))::BIGINT AS score FROM g JOIN q ON q.item_id = g.query_id JOIN documents USING (doc_id)")
def test_scores(spark: SparkSession, d: str) -> DataFrame:
    tests = table(spark, d, "documents").select(F.col("doc_id").alias("fqn"), F.lit("").alias("name"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("signature"), F.lit("").alias("docstring"), F.col("text").alias("body"))
    out = context.test_scores(questions(spark, d), tests, exact_hits(spark, d).select("query_id", F.col("doc_id").alias("fqn")))
    return out.select("query_id", F.col("fqn").alias("doc_id"), "score")


# ---- fusion with vectors, summaries and a reranker

_VECTORS = ", vs AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings c), vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs WHERE score > 0)"


@query("rrf_with_vectors", BOTH + _VECTORS + ", f AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM bm WHERE rank <= 60 UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM kw WHERE rank <= 60 UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM vr WHERE rank <= 60) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10")
def rrf_with_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Two lexical lists and a dense one; a question's vector is that of its number."""
    x, e = Lexical(spark, d), table(spark, d, "embeddings")
    q = e.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    dense = rk.dense(q, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), 60)
    return rk.rrf([x.bm(), x.kw(), dense], 10).select("query_id", "doc_id", "rank", "score")


@query("hybrid_rerank", BOTH + ", pl AS (SELECT query_id, doc_id FROM bm WHERE rank <= 30 UNION SELECT query_id, doc_id FROM kw WHERE rank <= 30), sc AS (SELECT query_id, doc_id, round(hits / terms::DOUBLE, 6) AS score FROM pl JOIN ks USING (query_id, doc_id) JOIN kt USING (query_id)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10")
def hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The reranker here is the share of a question's terms that a document has."""
    x = Lexical(spark, d)
    terms = rk.query_terms(x.questions).join(x.postings.rows.select("token").distinct(), "token")
    n = terms.groupBy("query_id").agg(F.count("*").alias("terms"))

    def scorer(pool: DataFrame) -> DataFrame:
        met = pool.join(x.postings.rows.select("doc_id", "token"), "doc_id").join(terms, ["query_id", "token"]).groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))
        return met.join(n, "query_id").select("query_id", "doc_id", (F.col("hits") / F.col("terms")).alias("score"))

    return rk.hybrid_rerank([x.bm(), x.kw()], scorer).select("query_id", "doc_id", "rank", "score")


@query("summary_search", "WITH " + BM25.replace("FROM documents", "FROM (SELECT doc_id, split_part(text, chr(10), 1) AS text FROM documents)") + " SELECT * FROM bm WHERE rank <= 10")
def summary_search(spark: SparkSession, d: str) -> DataFrame:
    """A document's first line is its summary."""
    first = corpus(spark, d).select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("text"))
    return rk.bm25(questions(spark, d), first, 10).select("query_id", "doc_id", "rank", "score")


_PPR = "r{i} AS MATERIALIZED (SELECT n.node, 0.15::DOUBLE * h + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(score), 0) FROM r{j} WHERE node NOT IN (SELECT src FROM od)) * h) AS score FROM nd n LEFT JOIN (SELECT ea.dst AS node, sum(r.score / od.deg) AS got FROM ea JOIN od ON od.src = ea.src JOIN r{j} r ON r.node = ea.src GROUP BY ea.dst) g ON g.node = n.node)"


@query(
    "personalised_pagerank",
    f"WITH {A}, b AS (SELECT src AS node FROM ea UNION SELECT dst FROM ea), hm AS (SELECT 'c' || c_custkey AS node, c_acctbal AS w FROM customer WHERE c_acctbal > 0), nd AS (SELECT node, coalesce(w, 0) / (SELECT sum(w) FROM hm) AS h FROM b LEFT JOIN hm USING (node)), od AS (SELECT src, count(*) AS deg FROM ea GROUP BY src), r0 AS (SELECT node, h AS score FROM nd), "
    + ", ".join(_PPR.format(i=i, j=i - 1) for i in range(1, 6))
    + " SELECT node, round(score, 9) AS score FROM r5",
)
def personalised_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Walks begin at customers, by their balances."""
    e = graph_a(spark, d)
    nodes, edges = graph.build([e.select(F.col("src").alias("node"))], [e])
    home = table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_acctbal").alias("weight"))
    return graph.pagerank(spark, nodes, edges, tol=0.0, max_iter=5, restart=home).select("node", F.round("score", 9).alias("score"))


_SYMBOLS = "list_sort(list_filter(list_distinct(flatten([regexp_extract_all(t, 'File\\s+\"[^\"]+\",\\s*line\\s+\\d+,\\s*in\\s+([A-Za-z_]\\w+)', 1), regexp_extract_all(t, '`([A-Za-z_][\\w.]{2,})`', 1), flatten(list_transform(f, lambda b: regexp_extract_all(b, '\\b(?:def|func|function|class)\\s+([A-Za-z_]\\w+)', 1))), flatten(list_transform(f, lambda b: regexp_extract_all(b, '\\b([A-Za-z_]\\w*(?:\\.\\w+)+|[A-Z][A-Za-z0-9]{2,})\\b', 1))), regexp_extract_all(t, '\\b([A-Za-z_]\\w*(?:Error|Exception|Warning))\\b', 1), regexp_extract_all(t, '\\b([A-Z][a-zA-Z0-9]+(?:\\.[A-Za-z_]\\w*)+)\\b', 1), regexp_extract_all(t, '\\bin\\s+([a-z_]\\w{3,})\\b', 1)])), lambda s: length(s) >= 3 AND NOT list_contains(" + sql_list(SYMBOL_STOPS) + ", s)))"


@query("issue_seeds", "WITH i AS (SELECT conv_id, turn, role, text, regexp_replace(coalesce(text, ''), '[^ -~\\n]', ' ', 'g') AS t, regexp_extract_all(regexp_replace(coalesce(text, ''), '[^ -~\\n]', ' ', 'g'), '(```[\\s\\S]*?```)', 1) AS f FROM conversations) SELECT conv_id, turn, role, md5(text) AS h, array_to_string(" + _SYMBOLS + ", ',') AS symbols FROM i")
def issue_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that turns name; other than ASCII characters count as blanks, where both engines agree on word ends."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^ -~\n]", " ")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("h"), F.array_join(tx.issue_symbols(plain), ",").alias("symbols"))
