"""Text, index and ranking queries: every benchmark item is a query against all documents."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.functions import text as tx
from lodeseam.functions.words import BUILD_STOPS, GREP_STOPS, QUERY_STOPS
from lodeseam.operators import graph
from lodeseam.operators import rank as rk
from lodeseam.plans.registry import query, sql_list, table
from lodeseam.session import persisted


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("grp"))


def _clean_sql(parts: str, stops: list[str]) -> str:
    return f"list_filter(list_transform({parts}, lambda t: lower(t)), lambda t: length(t) > 1 AND NOT list_contains({sql_list(stops)}, t))"


DOC_TOKENS = _clean_sql("string_split_regex(text, '[^a-zA-Z0-9]+')", BUILD_STOPS)
Q_TOKENS = _clean_sql("string_split_regex(text, '[^a-zA-Z0-9]+')", QUERY_STOPS)
_TWO_PASS = "string_split_regex(regexp_replace(regexp_replace({c}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '[_\\-.]')"

POSTINGS = f"""
dt AS (SELECT doc_id, {DOC_TOKENS} AS ts FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS av FROM dt),
tok AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS token FROM dt),
post AS (SELECT doc_id, dl, token, count(*) AS tf FROM tok GROUP BY ALL),
qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({Q_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token)"""
BM25 = POSTINGS + """,
bs AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av))), 6) AS score
  FROM post JOIN qt USING (token) JOIN dfs USING (token), st GROUP BY ALL),
bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs WHERE score > 0)"""
KEYWORD = """,
kq AS (SELECT DISTINCT query_id, token, ln(n / df) + 1 AS idf FROM qt JOIN dfs USING (token), st),
kt AS (SELECT query_id, sum(idf) AS total, count(*) AS terms FROM kq GROUP BY query_id),
ks AS (SELECT query_id, doc_id, sum(idf) AS s, count(*) AS hits FROM (SELECT doc_id, token FROM post) JOIN kq USING (token) GROUP BY ALL),
kv AS (SELECT query_id, doc_id, round(s * sqrt(hits) / (total * sqrt(terms)), 6) AS score FROM ks JOIN kt USING (query_id)),
kw AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kv WHERE score >= 0.05)"""
BOTH = "WITH " + BM25 + KEYWORD
#: How deep lists go into a fusion of ten.
DEPTH = 60


class Lexical:
    """The questions and the postings that all their lexical rankings read."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.questions = questions(spark, d)
        self.postings = rk.index(corpus(spark, d), vocabulary=rk.query_terms(self.questions))

    @cached_property
    def legs(self) -> dict[str, DataFrame]:
        return rk.lexical_legs(self.questions, self.postings, DEPTH)

    def bm(self, k: int = DEPTH) -> DataFrame:
        return self.legs["bm25"].where(F.col("rank") <= k)

    def kw(self, k: int = DEPTH) -> DataFrame:
        return self.legs["keyword"].where(F.col("rank") <= k)

    def bset(self, k: int = DEPTH) -> DataFrame:
        return self.legs["tokenset"].where(F.col("rank") <= k)


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", "rank", "score")


# ---- tokenizers and text functions

@query("tok_identifier", f"SELECT p_partkey, array_to_string({_clean_sql(_TWO_PASS.format(c='p_name'), BUILD_STOPS)}, ' ') AS tokens FROM part")
def tok_identifier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.identifier_tokens(F.col("p_name")), " ").alias("tokens"))


@query("tok_text", f"SELECT doc_id, array_to_string({DOC_TOKENS}, ' ') AS tokens FROM documents")
def tok_text(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("doc_id", F.array_join(tx.text_tokens(F.col("text")), " ").alias("tokens"))


@query("tok_query", f"SELECT item_id, array_to_string({Q_TOKENS}, ' ') AS tokens FROM benchmark")
def tok_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(tx.query_tokens(F.col("text")), " ").alias("tokens"))


_FLAT = f"flatten(list_transform(regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: {_clean_sql(_TWO_PASS.format(c='w'), BUILD_STOPS)}))"


@query("tok_flat", f"SELECT page_id, len(ts)::BIGINT AS n, len(list_distinct(ts))::BIGINT AS n_distinct FROM (SELECT page_id, {_FLAT} AS ts FROM pages)")
def tok_flat(spark: SparkSession, d: str) -> DataFrame:
    ts = table(spark, d, "pages").select("page_id", tx.flat_tokens(F.col("html")).alias("ts"))
    return ts.select("page_id", F.size("ts").cast("long").alias("n"), F.size(F.array_distinct("ts")).cast("long").alias("n_distinct"))


@query("whole_identifiers", "SELECT doc_id, len(ws)::BIGINT AS n, md5(array_to_string(ws, ' ')) AS h FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: lower(w)) AS ws FROM documents)")
def whole_identifiers(spark: SparkSession, d: str) -> DataFrame:
    ws = corpus(spark, d).select("doc_id", tx.whole_identifiers(F.col("text")).alias("ws"))
    return ws.select("doc_id", F.size("ws").cast("long").alias("n"), F.md5(F.array_join("ws", " ")).alias("h"))


@query(
    "grep_keywords",
    f"""WITH k0 AS (SELECT item_id, lower(unnest(ws)) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}') AS ws FROM benchmark)),
      k1 AS (SELECT item_id, w, count(*) AS n, min(pos) AS p FROM k0 WHERE NOT list_contains({sql_list(GREP_STOPS)}, w) GROUP BY item_id, w),
      k2 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, p) AS rn FROM k1)
      SELECT item_id, string_agg(w, ' ' ORDER BY n DESC, p) AS kws FROM k2 WHERE rn <= 20 GROUP BY item_id""",
)
def grep_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(tx.grep_keywords(F.col("text")), " ").alias("kws")).where("kws <> ''")


@query("token_estimates", "SELECT doc_id, (length(text) // 4)::BIGINT AS quarter, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::BIGINT AS est FROM documents")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("doc_id", tx.quarter_tokens(F.col("text")).alias("quarter"), tx.est_tokens(F.col("text")).alias("est"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS sha, left(sha1('m|2048|' || left(text, 2048)), 20) AS emb_key, left(sha1(text), 8) AS short_id FROM documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return corpus(spark, d).select("doc_id", F.sha2("text", 256).alias("sha"), tx.content_hash(F.lit("m"), t).alias("emb_key"), tx.short_hash(t, 8).alias("short_id"))


@query("fqn_parts", "SELECT l_orderkey, l_linenumber, 'o' || l_orderkey || '.py::Line.n' || l_linenumber AS fqn, 'o' || l_orderkey || '.py' AS file, 'n' || l_linenumber AS bare FROM lineitem")
def fqn_parts(spark: SparkSession, d: str) -> DataFrame:
    fqn = tx.make_fqn(F.concat(F.lit("o"), F.col("l_orderkey"), F.lit(".py")), F.lit("Line"), F.concat(F.lit("n"), F.col("l_linenumber")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fqn.alias("fqn")).withColumn("file", tx.file_of(F.col("fqn"))).withColumn("bare", tx.bare_name(F.col("fqn")))


@query(
    "body_keywords",
    f"""SELECT page_id, array_to_string(list_filter(flatten(list_transform(list_filter(regexp_extract_all(html, '["'']([A-Za-z][A-Za-z0-9_-]{{2,}}(?:[- ][A-Za-z0-9_-]+)*)["'']', 1),
      lambda v: NOT list_contains({sql_list(BUILD_STOPS)}, lower(v))), lambda v: string_split_regex(lower(v), '[-_ ]'))), lambda p: length(p) >= 2 AND NOT list_contains({sql_list(BUILD_STOPS)}, p)), ' ') AS kws FROM pages""",
)
def body_keywords(spark: SparkSession, d: str) -> DataFrame:
    # the quoted-literal part, which both engines' regular expressions express; tests hold the other parts
    quoted = F.regexp_extract_all("html", F.lit(r"""["']([A-Za-z][A-Za-z0-9_-]{2,}(?:[- ][A-Za-z0-9_-]+)*)["']"""), 1)
    parts = F.flatten(F.transform(F.filter(quoted, lambda v: ~F.lower(v).isin(BUILD_STOPS)), lambda v: F.split(F.lower(v), "[-_ ]")))
    return table(spark, d, "pages").select("page_id", F.array_join(F.filter(parts, lambda p: (F.length(p) >= 2) & ~p.isin(BUILD_STOPS)), " ").alias("kws"))


@query("body_keywords_full")
def body_keywords_full(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_join(tx.body_keywords(F.col("html"), "typescript"), " ").alias("kws"))


# ---- inverted index

@query("doc_len", f"SELECT doc_id, len({DOC_TOKENS})::BIGINT AS dl FROM documents")
def doc_len(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("doc_id", F.size(tx.text_tokens(F.col("text"))).cast("long").alias("dl"))


@query("term_stats", "WITH " + POSTINGS + " SELECT token, df::BIGINT AS df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM dfs, st")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    post = rk.index(corpus(spark, d))
    return rk.inverse_frequency(post.rows, post.n).select("token", "df", F.round("idf", 6).alias("idf"))


@query("inverted_postings", "WITH " + POSTINGS + " SELECT doc_id, token, tf::BIGINT AS tf FROM post WHERE token IN (SELECT token FROM qt)")
def inverted_postings(spark: SparkSession, d: str) -> DataFrame:
    return Lexical(spark, d).postings.rows.select("doc_id", "token", "tf")


@query("posting_lookup", "WITH " + POSTINGS + " SELECT token, count(*)::BIGINT AS docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM post WHERE token IN ('license', 'rights', 'version', 'loser') GROUP BY token")
def posting_lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = ["license", "rights", "version", "loser"]
    rows = corpus(spark, d).select("doc_id", F.explode(F.array_distinct(F.filter(tx.text_tokens(F.col("text")), lambda t: t.isin(wanted)))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


# ---- rankings

@query("bm25_topk", "WITH " + BM25 + " SELECT * FROM bm WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    return _ranked(rk.bm25(x.questions, x.postings, 10))


_SET = f"list_distinct({DOC_TOKENS})"


@query("bm25_tokenset", "WITH " + BM25.replace(DOC_TOKENS, _SET) + " SELECT * FROM bm WHERE rank <= 10")
def bm25_tokenset(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    return _ranked(rk.bm25(x.questions, x.postings, 10, distinct_doc_tokens=True))


@query("bm25_in_group", "WITH " + BM25.replace("FROM documents", "FROM documents WHERE source = 'src1'") + " SELECT * FROM bm WHERE rank <= 10")
def bm25_in_group(spark: SparkSession, d: str) -> DataFrame:
    """The group filter comes before ranking and reaches the scan."""
    only = table(spark, d, "documents").where("source = 'src1'").select("doc_id", "text")
    return _ranked(rk.bm25(questions(spark, d), only, 10))


@query("keyword_search", BOTH + " SELECT * FROM kw WHERE rank <= 10")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    return _ranked(rk.keyword_search(x.questions, x.postings, 10))


_GREP = f"""WITH k0 AS (SELECT item_id, lower(unnest(ws)) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}') AS ws FROM benchmark)),
k1 AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, min(pos)) AS rn FROM k0 WHERE NOT list_contains({sql_list(GREP_STOPS)}, w) GROUP BY item_id, w),
kws AS (SELECT item_id, w FROM k1 WHERE rn <= 20),
ph AS (SELECT item_id, array_to_string(list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''), ' ') AS phrase FROM benchmark),
ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS ls FROM documents)),
lw AS (SELECT doc_id, no, line, string_split_regex(line, '[^\\pL\\pN_]+') AS ws FROM ln),
hit AS (SELECT item_id, doc_id, no, sum(CASE WHEN list_contains(ws, w) THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS s FROM lw JOIN kws ON contains(line, w) GROUP BY ALL),
tot AS (SELECT item_id, doc_id, sum(least(5.0::DOUBLE, s)) AS s FROM hit GROUP BY ALL),
sc AS (SELECT tot.item_id AS query_id, tot.doc_id, round(s + CASE WHEN length(phrase) >= 8 AND contains(lower(text), phrase) THEN 12.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM tot JOIN ph USING (item_id) JOIN documents USING (doc_id)),
gr AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


@query("grep_rank", _GREP + " SELECT * FROM gr WHERE rank <= 10")
def grep_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(rk.grep(questions(spark, d), corpus(spark, d), 10))


@query("rrf_2way", BOTH + ", f AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM bm WHERE rank <= 60 UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM kw WHERE rank <= 60) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10")
def rrf_2way(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    return _ranked(rk.rrf([x.bm(), x.kw()], 10))


_SETRANK = "WITH " + BM25.replace(DOC_TOKENS, _SET).replace("bm AS", "bset AS").replace("bs AS", "bset0 AS").replace("FROM bs ", "FROM bset0 ").replace("dt AS", "dt2 AS").replace("FROM dt)", "FROM dt2)").replace("st AS", "st2 AS").replace("tok AS", "tok2 AS").replace("FROM tok ", "FROM tok2 ").replace("post AS", "post2 AS").replace("FROM post ", "FROM post2 ").replace("qt AS", "qt2 AS").replace("dfs AS", "dfs2 AS").replace("JOIN qt ", "JOIN qt2 ").replace("JOIN dfs ", "JOIN dfs2 ").replace(", st GROUP", ", st2 GROUP").replace("FROM dt2), ", "FROM dt2), ")
_THREE = BOTH + ", " + _SETRANK.removeprefix("WITH ")
_FUSE = ", f AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM (SELECT query_id, doc_id, {a}::DOUBLE / (60 + rank) AS s FROM bm WHERE rank <= 60 UNION ALL SELECT query_id, doc_id, {b}::DOUBLE / (60 + rank) FROM kw WHERE rank <= 60 UNION ALL SELECT query_id, doc_id, {c}::DOUBLE / (60 + rank) FROM bset WHERE rank <= 60) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10"


@query("rrf_3way", _THREE + _FUSE.format(a="1.0", b="1.0", c="1.0"))
def rrf_3way(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    return _ranked(rk.rrf([x.bm(), x.kw(), x.bset()], 10))


@query("rrf_weighted", _THREE + _FUSE.format(a="1.0", b="1.0", c="2.0"))
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    return _ranked(rk.rrf([x.bm(), x.kw(), x.bset()], 10, weights=[1.0, 1.0, 2.0]))


_GROUPED = """, bg AS (SELECT query_id, source AS grp, min(rank) AS f FROM bm JOIN documents USING (doc_id) WHERE rank <= 60 GROUP BY ALL),
kg AS (SELECT query_id, source AS grp, min(rank) AS f FROM kw JOIN documents USING (doc_id) WHERE rank <= 60 GROUP BY ALL),
e AS (SELECT query_id, grp, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY f, grp)) AS s FROM bg UNION ALL SELECT query_id, grp, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY f, grp)) FROM kg),
g AS (SELECT query_id, grp, round(sum(s), 6) AS score FROM e GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, grp) AS rank FROM g) WHERE rank <= 10"""


@query("rrf_group", BOTH + _GROUPED)
def rrf_group(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    return rk.rrf_groups([x.bm(), x.kw()], groups(spark, d), 10).select("query_id", "grp", "rank", "score")


_NORM = """, n0 AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS s, 0 AS leg FROM bm WHERE rank <= 60 UNION ALL SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id), 1 FROM kw WHERE rank <= 60)"""


@query("hybrid_maxnorm", BOTH + _NORM + ", h AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM n0 GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h) WHERE rank <= 25")
def hybrid_maxnorm(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    return _ranked(rk.hybrid_max_norm([x.bm(), x.kw()], 10))


@query("primary_pool", BOTH + _NORM + ", h AS (SELECT query_id, doc_id, round(coalesce(max(s) FILTER (leg = 0), max(s)), 6) AS score, min(leg) AS late FROM n0 GROUP BY ALL) SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, score DESC, doc_id) AS rank FROM h) WHERE rank <= 25")
def primary_pool(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    return _ranked(rk.primary_pool(x.bm(), x.kw(), 25))


@query("pool_rerank", BOTH + ", p AS (SELECT bm.query_id, bm.doc_id, round(coalesce(kw.score, bm.score / max(bm.score) OVER (PARTITION BY bm.query_id)), 6) AS score, (kw.score IS NULL)::INT AS none FROM bm LEFT JOIN (SELECT * FROM kw WHERE rank <= 60) kw ON bm.query_id = kw.query_id AND bm.doc_id = kw.doc_id WHERE bm.rank <= 60) SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY none, score DESC, doc_id) AS rank FROM p) WHERE rank <= 10")
def pool_rerank(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    return _ranked(rk.rerank_pool(x.bm(), x.kw(), 10))


@query(
    "rerank_buckets",
    BOTH + """, r AS (SELECT b.query_id, b.doc_id, b.rank AS pos, k.rank AS spos, CASE WHEN k.rank IS NOT NULL THEN 0 WHEN contains(lower(i.text), lower(dd.source)) THEN 1 ELSE 2 END::BIGINT AS bucket, (dd.lang = 'fr' AND NOT contains(lower(i.text), 'test'))::INT AS late
      FROM (SELECT * FROM bm WHERE rank <= 50) b LEFT JOIN (SELECT * FROM kw WHERE rank <= 40) k ON b.query_id = k.query_id AND b.doc_id = k.doc_id JOIN documents dd ON dd.doc_id = b.doc_id JOIN benchmark i ON i.item_id = b.query_id)
    SELECT query_id, doc_id, rank, bucket FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, bucket, coalesce(spos, pos), pos, doc_id) AS rank FROM r) WHERE rank <= 10""",
)
def rerank_buckets(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    named = table(spark, d, "documents").select("doc_id", F.col("source").alias("name"), (F.col("lang") == "fr").alias("is_test"))
    return rk.structural_rerank(x.bm(50), x.kw(40), named, questions(spark, d), 10)


_DIVERSE = "SELECT query_id, doc_id, rank, score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY old, doc_id) AS rank FROM (SELECT query_id, doc_id, score, rank AS old, row_number() OVER (PARTITION BY query_id, source ORDER BY rank, doc_id) AS seat FROM bm JOIN documents USING (doc_id) WHERE rank <= 60) WHERE seat <= 2) WHERE rank <= 10"


@query("diverse_topk", "WITH " + BM25 + " " + _DIVERSE)
def diverse_topk(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    return _ranked(rk.diverse(x.bm(), groups(spark, d), 10))


_BRIDGES = """, sd AS (SELECT k.query_id, k.doc_id AS a, l.doc_id AS b, row_number() OVER (PARTITION BY k.query_id ORDER BY k.rank + l.rank, k.rank) AS n FROM kw k JOIN bm l ON k.query_id = l.query_id AND k.doc_id <> l.doc_id WHERE k.rank <= 6 AND l.rank <= 6),
    pt AS (SELECT query_id, a, b, CASE WHEN x.lang = y.lang THEN 'lang:' || x.lang WHEN x.source = y.source THEN 'source:' || x.source END AS via FROM sd JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE n <= 24),
    br AS (SELECT query_id, node, count(*) AS n FROM (SELECT query_id, unnest(['doc:' || a, via, 'doc:' || b]) AS node FROM pt WHERE via IS NOT NULL) GROUP BY ALL)"""


def bridges(spark: SparkSession, d: str, x: Lexical) -> DataFrame:
    """(query_id, node, n): nodes on the shortest paths between the first hits of two lists, where documents are tied
    by their language and their source."""
    docs = table(spark, d, "documents")
    node = F.concat(F.lit("doc:"), "doc_id")
    ties = docs.select(node.alias("src"), F.concat(F.lit("lang:"), "lang").alias("dst")).unionByName(docs.select(node.alias("src"), F.concat(F.lit("source:"), "source").alias("dst")))
    named = lambda leg: leg.withColumn("doc_id", node)
    return graph.bridge_counts(spark, ties, named(x.kw()), named(x.bm())).withColumnRenamed("doc_id", "node")


@query("bridge_counts", BOTH + _BRIDGES + " SELECT query_id, node, n::BIGINT AS n FROM br")
def bridge_counts(spark: SparkSession, d: str) -> DataFrame:
    return bridges(spark, d, Lexical(spark, d))


@query(
    "chain_consensus",
    BOTH + _BRIDGES + """, s AS (SELECT query_id, doc_id, rank AS sr FROM kw WHERE rank <= 30), l AS (SELECT query_id, doc_id, rank AS lr FROM bm WHERE rank <= 30), bd AS (SELECT query_id, substr(node, 5)::BIGINT AS doc_id, n FROM br WHERE starts_with(node, 'doc:')),
    r AS (SELECT query_id, doc_id, sr, lr, coalesce(n, 0) AS n, source AS grp FROM s FULL JOIN l USING (query_id, doc_id) FULL JOIN bd USING (query_id, doc_id) JOIN documents USING (doc_id)),
    a AS (SELECT *, max(coalesce(sr <= 10, false)::INT) OVER w + max(coalesce(lr <= 10, false)::INT) OVER w = 2 AS agreed FROM r WINDOW w AS (PARTITION BY query_id, grp)),
    c AS (SELECT query_id, doc_id, grp, round(CASE WHEN sr IS NULL THEN 0.0::DOUBLE ELSE 2.4::DOUBLE / (60 + sr) END + CASE WHEN lr IS NULL THEN 0.0::DOUBLE ELSE 2.0::DOUBLE / (60 + lr) END + CASE WHEN sr IS NULL OR lr IS NULL THEN 0.0::DOUBLE ELSE 0.080::DOUBLE END + CASE WHEN agreed THEN 0.035::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN n > 0 THEN 0.070::DOUBLE + 0.015::DOUBLE * n ELSE 0.0::DOUBLE END, 6) AS score,
      array_to_string(list_sort(list_filter([CASE WHEN sr IS NOT NULL THEN 'structural' END, CASE WHEN lr IS NOT NULL THEN 'lexical' END, CASE WHEN sr IS NOT NULL AND lr IS NOT NULL THEN 'consensus' END, CASE WHEN agreed THEN 'same-group' END, CASE WHEN n > 0 THEN 'graph-path' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM a),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, grp, doc_id) AS old FROM c),
    v AS (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY old, doc_id) AS seat FROM k)
    SELECT query_id, doc_id, score, reasons, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY old, doc_id) AS rank FROM v WHERE seat <= 2) WHERE rank <= 10""",
)
def chain_consensus(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    on_paths = bridges(spark, d, x).where("node LIKE 'doc:%'").select("query_id", F.substring("node", 5, 40).cast("long").alias("doc_id"), "n")
    return rk.evidence_chain(x.kw(30), x.bm(30), groups(spark, d), on_paths, 10).select("query_id", "doc_id", "score", "reasons", "rank")


@query(
    "fallback_ladder",
    BOTH + """, e AS (SELECT item_id AS query_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
    b5 AS (SELECT * FROM bm WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM e)), k5 AS (SELECT * FROM kw WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM e) AND query_id NOT IN (SELECT query_id FROM bm))
    SELECT query_id, doc_id, rank, 'entity' AS source, 'HIGH' AS label FROM e UNION ALL SELECT query_id, doc_id, rank, 'bm25', 'MEDIUM' FROM b5 UNION ALL SELECT query_id, doc_id, rank, 'keyword', 'LOW' FROM k5
    UNION ALL SELECT item_id, NULL, 0, 'none', 'MISS' FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM e) AND item_id NOT IN (SELECT query_id FROM bm) AND item_id NOT IN (SELECT query_id FROM kw)""",
)
def fallback_ladder(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    return rk.fallback_ladder(questions(spark, d), [("entity", "HIGH", exact_hits(spark, d)), ("bm25", "MEDIUM", x.bm(5)), ("keyword", "LOW", x.kw(5))])


def exact_hits(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, doc_id, rank, score): documents that hold an item's whole text."""
    texts = corpus(spark, d).select("doc_id", F.col("text").alias("t"))
    hits = rk.holding(texts, questions(spark, d).withColumnRenamed("text", "phrase"))
    return rk.top_k(hits.withColumn("score", F.lit(1.0)), 1 << 30)


@query(
    "weak_entity_boost",
    "WITH " + BM25 + """, e AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)), m AS (SELECT query_id FROM e GROUP BY query_id HAVING count(*) > 1)
    SELECT query_id, doc_id, 'entity' AS source FROM e UNION ALL SELECT query_id, doc_id, 'lexical' FROM bm WHERE rank <= 3 AND query_id IN (SELECT query_id FROM m) AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM e)""",
)
def weak_entity_boost(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    return rk.weak_entity_boost(exact_hits(spark, d), x.bm(3), weak=1)


@query(
    "lexical_scan",
    """WITH w AS (SELECT item_id, unnest(list_slice(list_transform(list_sort(list_transform(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x)), lambda x: length(x) > 3)), lambda x: {'n': -length(x), 'w': x})), lambda s: s.w), 1, 5)) AS w FROM benchmark),
    l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS ls FROM documents)),
    h AS (SELECT DISTINCT item_id AS query_id, doc_id, no AS line FROM l JOIN w ON contains(l.line, w.w)),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY line) AS s FROM h)
    SELECT query_id, doc_id, line, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, line) AS rank FROM f WHERE s <= 3) WHERE rank <= 25""",
)
def lexical_scan(spark: SparkSession, d: str) -> DataFrame:
    return rk.lexical_scan(questions(spark, d), corpus(spark, d))


@query("loop_merge", BOTH + ", f AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM kw WHERE rank <= 3 UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM bm WHERE rank <= 20) GROUP BY ALL) SELECT query_id, doc_id, score, rank FROM (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, b.rank NULLS LAST, f.doc_id) AS rank FROM f LEFT JOIN (SELECT * FROM bm WHERE rank <= 20) b ON f.query_id = b.query_id AND f.doc_id = b.doc_id) WHERE rank <= 10")
def loop_merge(spark: SparkSession, d: str) -> DataFrame:
    x = Lexical(spark, d)
    return _ranked(rk.loop_merge(x.kw(3), x.bm(20), 10))


# ---- vectors

def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


_DENSE = "s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0)"


@query("dense_topk", f"WITH {_DENSE} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(rk.dense(*_vectors(spark, d), 10))


@query("dense_all", f"WITH {_DENSE} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 25")
def dense_all(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(rk.dense(*_vectors(spark, d), 25, positive=False))


@query("dense_rescore", f"WITH {_DENSE}, k AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 25), j AS (SELECT DISTINCT a.query_id, b.doc_id FROM k a JOIN k b ON a.doc_id = b.query_id) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN j USING (query_id, doc_id)")
def dense_rescore(spark: SparkSession, d: str) -> DataFrame:
    """What the nearest questions of a question found, scored for itself."""
    q, c = _vectors(spark, d)
    found = persisted(spark, rk.dense(q, c, 25, positive=False).select("query_id", "doc_id"), "found")
    pairs = found.select("query_id", F.col("doc_id").alias("other")).join(found.select(F.col("query_id").alias("other"), "doc_id"), "other")
    return _ranked(rk.rescore(pairs, q, c))


@query("cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(tx.cosine(F.col("embedding"), F.col("other")), 6).alias("cos"))
