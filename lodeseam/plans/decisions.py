"""Rule, budget, session, change and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.functions import rules as r
from lodeseam.functions import text as tx
from lodeseam.functions.words import FAMILY_SECTIONS, HARD_SIGNALS, MODES, PROMPT_FAMILIES, TASK_KEYWORDS
from lodeseam.operators import assemble, changes, evaluate, sessions
from lodeseam.plans.registry import query, table
from lodeseam.plans.retrieval import BM25, Lexical

# ---- rules over conversations, whose turns are the prompts


def talk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_LOW = "p AS (SELECT conv_id, turn, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low, len(regexp_extract_all(coalesce(text, ''), '" + r.PATH + "', 1)) > 0 AS ent FROM conversations)"
_ERR = "coalesce(nullif(left(trim(regexp_extract(text, '(?i)(?:Error|Exception|Traceback)[\\s:]+(.+)', 1)), 200), ''), nullif(left(trim(regexp_extract(text, '(?i)traceback.*?:\\s*(.+)', 1)), 200), ''), nullif(left(trim(regexp_extract(text, '\"([^\"]*(?:Error|Exception)[^\"]*)\"', 1)), 200), ''))"
_LINE = "nullif(regexp_extract(text, '(?:line\\s+|L|:)(\\d+)', 1), '')"
_EXTRA = {"debug": " + 3 * (err IS NOT NULL)::INT + (ln IS NOT NULL)::INT", "edit": " + (ln IS NOT NULL)::INT", "explain": " + 1.5::DOUBLE * contains(low, '?')::INT"}
_SCORES = ", ".join("(" + " + ".join(f"contains(low, '{w.replace(chr(39), chr(39) * 2)}')::INT" for w in ws) + _EXTRA.get(t, "") + f")::DOUBLE AS s_{t}" for t, ws in TASK_KEYWORDS.items())
_BEST = "greatest(" + ", ".join(f"s_{t}" for t in TASK_KEYWORDS) + ")"
_TASK = f"CASE WHEN {_BEST} = 0 THEN 'edit' " + " ".join(f"WHEN s_{t} = {_BEST} THEN '{t}'" for t in TASK_KEYWORDS) + " END"
TASKS = f"WITH {_LOW}, q AS (SELECT *, {_ERR} AS err, {_LINE} AS ln FROM p), sc AS (SELECT *, {_SCORES} FROM q), tt AS (SELECT *, {_TASK} AS task FROM sc)"


@query("intent_signals", f"WITH {_LOW} SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '{r.PATH}', 1), ',') AS paths, {_ERR} AS err, CAST({_LINE} AS BIGINT) AS line FROM p")
def intent_signals(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return talk(spark, d).select("conv_id", "turn", F.array_join(r.intent_paths(t), ",").alias("paths"), r.error_message(t).alias("err"), r.line_number(t).alias("line"))


@query("task_type", TASKS + " SELECT conv_id, turn, task FROM tt")
def task_type(spark: SparkSession, d: str) -> DataFrame:
    return talk(spark, d).select("conv_id", "turn", r.task_type(F.col("text")).alias("task"))


_HARD = "CASE " + " ".join(f"WHEN {_any(ws)}{' AND NOT ent' if m == 'architecture' else ''} THEN '{m}'" for m, ws in HARD_SIGNALS) + " END"
_MODE = f"coalesce({_HARD}, CASE WHEN task = 'debug' THEN CASE WHEN ent THEN 'debug_targeted' ELSE 'debug_investigate' END WHEN task = 'create' THEN CASE WHEN ent THEN 'build_guided' ELSE 'build_greenfield' END WHEN task = 'edit' THEN CASE WHEN ent THEN 'debug_targeted' ELSE 'build_guided' END WHEN task = 'explain' AND NOT ent AND {_any(['architecture', 'design', 'system'])} THEN 'architecture' ELSE task END)"


@query("query_mode", TASKS + f" SELECT conv_id, turn, {_MODE} AS mode FROM tt")
def query_mode(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return talk(spark, d).select("conv_id", "turn", r.query_mode(t, F.size(r.intent_paths(t)) > 0).alias("mode"))


_MODES_SQL = "md AS (SELECT * FROM (VALUES " + ", ".join(f"('{m[0]}', '{m[1]}', {m[8]}::DOUBLE)" for m in MODES) + ") t(mode, base, cx))"
_ROUTE = """sr AS (SELECT conv_id, turn, mode, base, lvl, n, tok, greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN base = 'llm' THEN greatest(0.74::DOUBLE, raw) ELSE raw END)) AS s FROM (
  SELECT *, CASE lvl WHEN 'LOW' THEN cx + 0.10::DOUBLE WHEN 'MISS' THEN greatest(cx - 0.15::DOUBLE, 0.05::DOUBLE) WHEN 'HIGH' THEN cx - 0.05::DOUBLE ELSE cx END + CASE WHEN n >= 25 THEN 0.12::DOUBLE WHEN n <= 3 THEN -0.05::DOUBLE ELSE 0::DOUBLE END + CASE WHEN tok >= 6000 THEN 0.10::DOUBLE WHEN tok <= 900 THEN -0.08::DOUBLE ELSE 0::DOUBLE END AS raw FROM mq))"""


@query(
    "tier_route",
    TASKS + f", m AS (SELECT conv_id, turn, {_MODE} AS mode FROM tt), {_MODES_SQL}, mq AS (SELECT m.conv_id, m.turn, m.mode, md.base, md.cx, ['HIGH', 'MEDIUM', 'LOW', 'MISS'][(m.turn % 4 + 1)::INT] AS lvl, (m.conv_id % 30) AS n, (m.conv_id * 97 % 8000) AS tok FROM m JOIN md USING (mode)), {_ROUTE}, rr AS (SELECT *, round(s, 6) AS score FROM sr)"
    " SELECT conv_id, turn, score, CASE WHEN lvl = 'MISS' THEN 'mlm' WHEN score < 0.28 THEN CASE WHEN base = 'mlm' THEN 'mlm' ELSE 'slm' END WHEN score < 0.74 THEN 'mlm' ELSE 'llm' END AS tier FROM rr",
)
def tier_route(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    rows = talk(spark, d).select("conv_id", "turn", r.query_mode(t, F.size(r.intent_paths(t)) > 0).alias("mode"), F.element_at(F.array(*map(F.lit, ["HIGH", "MEDIUM", "LOW", "MISS"])), (F.col("turn") % 4 + 1).cast("int")).alias("lvl"))
    score = r.complexity_score(F.col("mode"), F.col("lvl"), F.col("conv_id") % 30, F.col("conv_id") * 97 % 8000, F.lit(False))
    return rows.withColumn("score", score).select("conv_id", "turn", "score", r.model_tier(F.col("mode"), F.col("lvl"), F.col("score")).alias("tier"))


_FAM = "CASE WHEN trim(low) = '' THEN 'general' " + " ".join(
    f"WHEN regexp_matches(low, '(^|[^\\pL\\pN_])({'|'.join(w for w in ws if ' ' not in w)})($|[^\\pL\\pN_])')" + (f" OR {_any([w for w in ws if ' ' in w])}" if any(" " in w for w in ws) else "") + f" THEN '{fam}'" for fam, ws in PROMPT_FAMILIES
) + " ELSE 'general' END"


@query("prompt_family", f"WITH {_LOW}, f AS (SELECT conv_id, turn, {_FAM} AS family FROM p) SELECT conv_id, turn, family, CASE family " + " ".join(f"WHEN '{k}' THEN '{','.join(s for s, _ in v)}'" for k, v in FAMILY_SECTIONS.items()) + " ELSE '' END AS sections FROM f")
def prompt_family(spark: SparkSession, d: str) -> DataFrame:
    f = talk(spark, d).select("conv_id", "turn", r.prompt_family(F.col("text")).alias("family"))
    return f.withColumn("sections", F.array_join(F.transform(r.family_sections(F.col("family")), lambda s: s["section"]), ","))


@query("issue_symbols")
def issue_symbols(spark: SparkSession, d: str) -> DataFrame:
    return talk(spark, d).select("conv_id", "turn", F.array_join(tx.issue_symbols(F.col("text")), ",").alias("symbols"))


@query("graph_route", f"WITH {_LOW} SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'gated' WHEN regexp_matches(text, '" + r.RELATION.replace("(?i)\\b", "(?i)(?:^|[^\\pL\\pN_])").removesuffix("\\b") + "(?:$|[^\\pL\\pN_])') THEN 'always' WHEN regexp_matches(trim(text), '^[A-Za-z_][\\w.]*$') THEN 'off' ELSE 'gated' END AS policy FROM p")
def graph_route(spark: SparkSession, d: str) -> DataFrame:
    return talk(spark, d).select("conv_id", "turn", r.graph_route(F.col("text"))["policy"].alias("policy"))


# ---- budgets

_ALLOC = """a AS (SELECT doc_id, (length(text) // 4) % 900 AS z1, (length(text) * 37) % 130000 AS z2, 50 AS z4 FROM documents), b AS (SELECT *, z1 + z2 + z4 AS f FROM a),
m AS (SELECT *, CASE WHEN f < 32000 THEN 'FULL' WHEN f < 64000 THEN 'COMPACT' WHEN f < 115200 THEN 'MINIMAL' ELSE 'NONE' END AS mode, CASE WHEN f < 32000 THEN 32000 - f WHEN f < 64000 THEN 64000 - f WHEN f < 115200 THEN least(12800, 115200 - f) ELSE 0 END AS z3 FROM b)"""


@query("budget_alloc", f"WITH {_ALLOC} SELECT doc_id, mode, z3::BIGINT AS zone3, CASE mode WHEN 'FULL' THEN z3 // 25 WHEN 'COMPACT' THEN z3 // 12 WHEN 'MINIMAL' THEN z3 // 8 ELSE 0 END::BIGINT AS entries, round((f + z3) / 128000::DOUBLE, 6) AS utilisation FROM m")
def budget_alloc(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text").cast("long")
    z = assemble.allocation(F.floor(n / 4) % 900, (n * 37) % 130000, F.lit(50).cast("long"))
    return table(spark, d, "documents").select("doc_id", z.alias("z")).select("doc_id", "z.mode", "z.zone3", "z.entries", "z.utilisation")


@query("budget_prefix", "SELECT source, count(*)::BIGINT AS kept, max(used)::BIGINT AS used FROM (SELECT source, (sum(length(text) + 1) OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) // 4 AS used FROM documents) WHERE used <= 4000 GROUP BY source")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    kept = assemble.prefix_within(table(spark, d, "documents"), "source", [F.col("n_chars"), F.col("doc_id")], F.length("text"), 4000)
    return kept.groupBy("source").agg(F.count("*").alias("kept"), F.max("used").alias("used"))


_ZONES = ", c AS (SELECT query_id, doc_id, CASE WHEN rank <= 3 THEN 1 ELSE 2 END AS tier, score, length(text) AS bl, length(split_part(text, chr(10), 1)) AS sl, greatest(500, 8000 - length(i.q) // 4 - 20) * 4 AS room FROM bm JOIN documents USING (doc_id) JOIN (SELECT item_id, text AS q FROM benchmark) i ON i.item_id = query_id WHERE rank <= 20), z AS (SELECT *, sum(CASE WHEN tier = 1 THEN bl ELSE sl END + 1) OVER (PARTITION BY query_id ORDER BY tier, score DESC, doc_id) AS bodies, sum(CASE WHEN tier = 1 THEN sl + 1 ELSE 0 END) OVER (PARTITION BY query_id) AS sigs FROM c), f AS (SELECT query_id, doc_id, tier, CASE WHEN tier = 1 AND bodies <= room THEN 'body' WHEN tier = 1 AND sigs <= room THEN 'signature' WHEN tier > 1 AND bodies <= room THEN 'signature' END AS form FROM z) SELECT query_id, CASE WHEN tier = 1 THEN 2 ELSE 3 END::INT AS zone, doc_id, form FROM f WHERE form IS NOT NULL"


@query("zone_pack", "WITH " + BM25 + _ZONES)
def zone_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("signature"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    c = Lexical(spark, d).bm(20).withColumn("tier", F.when(F.col("rank") <= 3, 1).otherwise(2)).join(docs, "doc_id").join(asked, "query_id")
    return assemble.four_zones(c, F.lit(""), F.col("q"))


@query("truncation", "SELECT doc_id, CASE WHEN n * 4 <= 4000 THEN 0 WHEN n * 3 <= 4000 THEN 1 WHEN n * 2 <= 4000 THEN 2 ELSE 3 END::BIGINT AS level FROM (SELECT doc_id, length(text) // 4 AS n FROM documents)")
def truncation(spark: SparkSession, d: str) -> DataFrame:
    n = tx.quarter_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", assemble.truncation_level([n, n, n, n], F.lit(4000)).alias("level"))


# ---- changes

_OLD = "o AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 50 <> 3), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 40 = 7 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 60 <> 5), df AS (SELECT doc_id, CASE WHEN o.sha IS NULL THEN 'new' WHEN n.sha IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM o FULL JOIN n USING (doc_id) WHERE o.sha IS DISTINCT FROM n.sha)"


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 50 <> 3").select("doc_id", F.sha2("text", 256).alias("sha"))
    new = docs.where("doc_id % 60 <> 5").select("doc_id", F.sha2(F.when(F.col("doc_id") % 40 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return old, new


@query("file_diff", f"WITH {_OLD} SELECT doc_id, status FROM df")
def file_diff(spark: SparkSession, d: str) -> DataFrame:
    return changes.snapshot_diff(*snapshots(spark, d), "doc_id")


@query("staleness", f"WITH {_OLD}, c AS (SELECT count(*) FILTER (status = 'new') AS added, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'deleted') AS deleted FROM df) SELECT *, CASE WHEN added + modified + deleted = 0 THEN 'ok' WHEN added + modified + deleted > 10 OR deleted > 3 THEN 'rebuild' ELSE 'update' END AS verdict FROM c")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    return changes.staleness(changes.snapshot_diff(*snapshots(spark, d), "doc_id"))


@query("incremental_equals_full", f"WITH {_OLD} SELECT doc_id, sha FROM n")
def incremental_equals_full(spark: SparkSession, d: str) -> DataFrame:
    old, new = snapshots(spark, d)
    return changes.update_rows(old, new, changes.snapshot_diff(old, new, "doc_id"), "doc_id").select("doc_id", "sha")


@query("semi_dirty", "SELECT count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_dirty(spark: SparkSession, d: str) -> DataFrame:
    bad = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(bad, "o_custkey", "left_semi").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("anti_removed", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_removed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("set_except", "SELECT DISTINCT source FROM documents EXCEPT SELECT source FROM documents WHERE lang = 'es'")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("source").exceptAll(docs.where("lang = 'es'").select("source")).select("source").distinct().join(docs.where("lang = 'es'").select("source").distinct(), "source", "left_anti")


_IMPACT = "WITH eb AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), ch AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_suppkey % 20 = 0), rc AS (SELECT DISTINCT src AS node FROM eb JOIN ch ON eb.dst = ch.node), s AS (SELECT 'p' || p_partkey AS node, p_brand AS grp, p_size::DOUBLE AS complexity, p_size > 25 AS exported FROM part), g AS (SELECT grp, count(*) AS n, 1::BIGINT AS nearest, round(avg(complexity), 6) AS complexity, bool_or(exported) AS exported FROM rc JOIN s USING (node) GROUP BY grp) SELECT *, round(least(1::DOUBLE, least(1::DOUBLE, n / 10::DOUBLE) * 0.4::DOUBLE + 0.3::DOUBLE + least(1::DOUBLE, complexity / 20::DOUBLE) * 0.2::DOUBLE + CASE WHEN exported THEN 0.1::DOUBLE ELSE 0::DOUBLE END), 6) AS risk FROM g"


@query("change_impact_risk", _IMPACT)
def change_impact_risk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    ch = table(spark, d, "supplier").where("s_suppkey % 20 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    s = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.col("p_brand").alias("grp"), F.col("p_size").cast("double").alias("complexity"), (F.col("p_size") > 25).alias("exported"))
    return changes.impact(spark, ch, e, s)


# ---- sessions

@query("session_turns", "SELECT conv_id, count(*)::BIGINT AS turns, sum(length(text) // 4)::BIGINT AS tokens, sum(CASE WHEN role = 'user' THEN length(text) // 4 ELSE 0 END)::BIGINT AS asked FROM conversations GROUP BY conv_id")
def session_turns(spark: SparkSession, d: str) -> DataFrame:
    n = tx.quarter_tokens(F.col("text"))
    return talk(spark, d).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(n).alias("tokens"), F.sum(F.when(F.col("role") == "user", n).otherwise(0)).alias("asked"))


@query("last_n_log", "SELECT conv_id, turn, back FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE back <= 3")
def last_n_log(spark: SparkSession, d: str) -> DataFrame:
    return sessions.last_n(talk(spark, d).select("conv_id", "turn").distinct(), "conv_id", ["turn"], 3)


@query("session_ttl", "SELECT user_id, count(*)::BIGINT AS live FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM (SELECT *, epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id) AS age FROM events) WHERE age <= 36000) WHERE turn <= 50 GROUP BY user_id")
def session_ttl(spark: SparkSession, d: str) -> DataFrame:
    return sessions.live_turns(table(spark, d, "events"), "user_id", F.col("ts").cast("timestamp"), 600).groupBy("user_id").agg(F.count("*").alias("live"))


@query("body_dedup", "SELECT source, count(*)::BIGINT AS n, count(*) FILTER (seen)::BIGINT AS repeats FROM (SELECT source, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) > 1 AS seen FROM documents) GROUP BY source")
def body_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions.body_dedup(table(spark, d, "documents"), ["source"], F.col("text"), ["doc_id"])
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(F.col("seen"), 1)).alias("repeats"))


_RANGES = "rg AS (SELECT event_id, user_id, event_id % 200 AS a, event_id % 200 + 20 + user_id % 30 AS z FROM events)"


@query("range_dedup", f"WITH {_RANGES} SELECT event_id, user_id FROM rg x WHERE NOT EXISTS (SELECT 1 FROM rg y WHERE y.user_id = x.user_id AND y.event_id < x.event_id AND greatest(0, least(x.z, y.z) - greatest(x.a, y.a) + 1) / (x.z - x.a + 1)::DOUBLE >= 0.8)")
def range_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 200).alias("a"), (F.col("event_id") % 200 + 20 + F.col("user_id") % 30).alias("z"))
    return sessions.range_dedup(rows, ["user_id"], "a", "z", "event_id").select("event_id", "user_id")


_KIND = "event_type = (SELECT min(event_type) FROM events)"


@query("gate_automaton", f"WITH e AS (SELECT event_id, user_id, {_KIND} AS s FROM events), w AS (SELECT *, coalesce(sum(s::INT) OVER b, 0) AS n, coalesce(sum((NOT s)::INT) OVER b, 0) AS k FROM e WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id, user_id, (NOT s AND n < 2 AND k < 3) AS denied FROM w")
def gate_automaton(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = e.agg(F.min("event_type")).first()[0]
    s = F.col("event_type") == kind
    return sessions.gate(e, "user_id", "event_id", s, ~s).select("event_id", "user_id", "denied")


@query("loop_breaker", "SELECT event_id, times, times >= 3 AS broken FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS times FROM events)")
def loop_breaker(spark: SparkSession, d: str) -> DataFrame:
    return sessions.loops(table(spark, d, "events"), "user_id", "event_type", "event_id").select("event_id", "times", "broken")


@query("history_stub", "SELECT conv_id, turn, count(*)::BIGINT AS n, sum(stub::INT)::BIGINT AS stubs FROM (SELECT conv_id, turn, length(text) > 150 AND sum((length(text) > 150)::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC) > 2 AS stub FROM conversations) GROUP BY ALL")
def history_stub(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions.history_stub(talk(spark, d), "conv_id", "turn", "text", keep=2, over=150)
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum(F.col("stub").cast("int")).alias("stubs"))


@query("queue_batch", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 ORDER BY ts, event_id, user_id LIMIT 10")
def queue_batch(spark: SparkSession, d: str) -> DataFrame:
    return sessions.queue_batch(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id")


# ---- evaluation

_QRELS = "qr AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"
_EVAL = f"""WITH {BM25}, {_QRELS}, ng AS (SELECT query_id, count(*) AS gold FROM qr GROUP BY 1), t AS (SELECT bm.query_id, rank, qr.doc_id IS NOT NULL AS hit FROM bm LEFT JOIN qr ON qr.query_id = bm.query_id AND qr.doc_id = bm.doc_id WHERE rank <= 10),
p AS (SELECT query_id, count(*) AS shown, count(*) FILTER (hit) AS hits, min(rank) FILTER (hit) AS first, sum(1 / log2(rank + 1)) FILTER (hit) AS dcg FROM t GROUP BY 1),
ev AS (SELECT ng.query_id, gold, round(coalesce(hits / gold::DOUBLE, 0), 6) AS recall, round(coalesce(hits / least(10, shown)::DOUBLE, 0), 6) AS precision, round(coalesce(1 / first::DOUBLE, 0), 6) AS mrr, round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(gold, 10) + 1) x(i)), 0), 6) AS ndcg FROM ng LEFT JOIN p USING (query_id))"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    from lodeseam.plans.retrieval import exact_hits

    return evaluate.ranking_metrics(Lexical(spark, d).bm(10), exact_hits(spark, d))


@query("eval_metrics", _EVAL + " SELECT query_id, gold::BIGINT AS gold, recall, precision, mrr, ndcg FROM ev")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d)


@query("eval_by_group", _EVAL + " SELECT CASE WHEN grouping(b) = 1 THEN 'all' ELSE b::VARCHAR END AS bucket, count(*)::BIGINT AS n, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM (SELECT *, query_id % 3 AS b FROM ev) GROUP BY ROLLUP (b)")
def eval_by_group(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.macro(metrics(spark, d).withColumn("b", F.col("query_id") % 3), "b")
    return m.select(F.coalesce(F.col("b").cast("string"), F.lit("all")).alias("bucket"), "n", "recall", "precision", "mrr", "ndcg")


@query("contingency_mcnemar", "WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS both, count(*) FILTER (quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (quality = 0 AND toxic = 1) AS only_b, count(*) FILTER (quality = 0 AND toxic = 0) AS neither FROM labels) SELECT *, only_a - only_b AS net FROM c")
def contingency_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels")
    return evaluate.contingency(lab.select(F.col("doc_id").alias("task"), (F.col("quality") == 1).alias("ok")), lab.select(F.col("doc_id").alias("task"), (F.col("toxic") == 1).alias("ok")))


@query("cohens_d", "SELECT round(avg(x) / stddev_samp(x), 6) AS d FROM (SELECT l_extendedprice - l_quantity * 1000 AS x FROM lineitem)")
def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.cohens_d(table(spark, d, "lineitem").select((F.col("l_extendedprice") - F.col("l_quantity") * 1000).alias("x")), "x")


@query("pearson", "SELECT round(corr(n, bal), 6) AS r FROM (SELECT c_custkey, c_acctbal AS bal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(n, "c_custkey", "left").agg(F.round(F.corr(F.coalesce("n", F.lit(0)).cast("double"), F.col("c_acctbal")), 6).alias("r"))


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a"), F.lit(1.0).alias("b"))
    return evaluate.bootstrap_ratio(spark, rows)


_CALLS = "c AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn, event_type AS item FROM events), gd AS (SELECT DISTINCT user_id AS run, event_type AS item FROM events)"


@query("cumulative_recall", f"WITH {_CALLS}, f AS (SELECT run, item, min(turn) AS turn FROM c GROUP BY ALL), n AS (SELECT run, count(*) AS g FROM gd GROUP BY run), w AS (SELECT run, turn, count(*) AS new FROM f GROUP BY ALL) SELECT run, turn, round(sum(coalesce(new, 0)) OVER (PARTITION BY run ORDER BY turn) / g::DOUBLE, 6) AS recall FROM (SELECT DISTINCT run, turn FROM c) LEFT JOIN w USING (run, turn) JOIN n USING (run)")
def cumulative_recall(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    calls = e.select(F.col("user_id").alias("run"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long").alias("turn"), F.col("event_type").alias("item"))
    return evaluate.cumulative_recall(calls, calls.select("run", "item").distinct())


@query("token_attribution", "SELECT role, sum(n)::BIGINT AS raw, sum(n * greatest(1, last - turn + 1))::BIGINT AS carried FROM (SELECT role, turn, length(text) // 4 AS n, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY role")
def token_attribution(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluate.carried_tokens(talk(spark, d).withColumn("n", tx.quarter_tokens(F.col("text"))), "conv_id", "turn", "n")
    return rows.groupBy("role").agg(F.sum("n").alias("raw"), F.sum("carried").alias("carried"))


@query("kv_cache", "SELECT conv_id, (sum(length(text) // 4) * 2 * 32 * 8 * 128 * 2)::BIGINT AS bytes, round(sum(length(text) // 4) * 3.0::DOUBLE / 1000000, 9) AS cost FROM conversations GROUP BY conv_id")
def kv_cache(spark: SparkSession, d: str) -> DataFrame:
    n = F.sum(tx.quarter_tokens(F.col("text")))
    rows = talk(spark, d).groupBy("conv_id").agg(n.alias("n"))
    lit = lambda x: F.lit(x).cast("long")
    return rows.select("conv_id", tx.kv_cache_bytes(F.col("n"), lit(32), lit(8), lit(128), lit(2)).alias("bytes"), F.round(tx.imputed_cost(F.col("n"), F.lit(0), F.lit(0), 3.0, 0.3, 15.0), 9).alias("cost"))


@query("tool_mix", "SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, round(avg(value), 6) AS mean, round(median(value), 6) AS med FROM events GROUP BY event_type")
def tool_mix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("med"))


@query("latency_stats", "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM events")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", q), 6)
    return table(spark, d, "events").agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"))


@query("arm_rollup_pivot", "SELECT role, count(*) FILTER (turn % 3 = 0)::BIGINT AS t0, count(*) FILTER (turn % 3 = 1)::BIGINT AS t1, count(*) FILTER (turn % 3 = 2)::BIGINT AS t2 FROM conversations GROUP BY role")
def arm_rollup_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = talk(spark, d).withColumn("t", F.concat(F.lit("t"), F.col("turn") % 3)).groupBy("role").pivot("t", ["t0", "t1", "t2"]).count()
    return rows.fillna(0)


@query("dir_rollup", "SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*)::BIGINT AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 10")
def dir_rollup(spark: SparkSession, d: str) -> DataFrame:
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return table(spark, d, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(10)


@query("stratified_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS rn, md5('42:' || doc_id) AS h FROM documents) ORDER BY rn, h, doc_id LIMIT 50")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    h = F.md5(F.concat(F.lit("42:"), F.col("doc_id")))
    rows = table(spark, d, "documents").select("doc_id", "source", h.alias("h")).withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy("h", "doc_id")))
    return rows.orderBy("rn", "h", "doc_id").limit(50).select("doc_id", "source")


@query("multi_signal_score", "SELECT p_partkey, round(CASE WHEN d = 0 THEN 10 ELSE 10.0::DOUBLE / d END + 3 * hub + CASE WHEN p_size > 10 THEN 2.25::DOUBLE WHEN p_size > 5 THEN 1.5::DOUBLE ELSE 0::DOUBLE END + CASE WHEN p_size > 25 THEN 2 ELSE 0 END + CASE WHEN p_brand = 'Brand#11' THEN 3 ELSE 0 END, 2) AS score FROM (SELECT p_partkey, p_size, p_brand, p_partkey % 4 AS d, round(coalesce(n, 0) / (max(n) OVER ())::DOUBLE, 6) AS hub FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)")
def multi_signal_score(spark: SparkSession, d: str) -> DataFrame:
    from lodeseam.operators.resolve import composite_score

    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    most = n.agg(F.max("n")).first()[0] or 1
    rows = table(spark, d, "part").join(n, "p_partkey", "left").withColumn("hub", F.round(F.coalesce("n", F.lit(0)) / float(most), 6))
    s = composite_score(F.col("p_partkey") % 4, F.col("hub"), F.col("p_size"), F.lit(False), F.col("p_size") > 25, F.col("p_brand") == "Brand#11", F.lit(False))
    return rows.select("p_partkey", s.alias("score"))


@query("confidence_levels", f"WITH {BM25}, t AS (SELECT query_id, count(*) AS n, count(DISTINCT source) AS g FROM bm JOIN documents USING (doc_id) WHERE rank <= query_id % 12 + 1 GROUP BY query_id), c AS (SELECT query_id, 0.35::DOUBLE * 0.5::DOUBLE + 0.25::DOUBLE * 0.4::DOUBLE + 0.15::DOUBLE * CASE WHEN n = 1 THEN 1.0::DOUBLE WHEN n <= 3 THEN 0.7::DOUBLE WHEN n <= 5 THEN 0.5::DOUBLE WHEN n <= 10 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END + 0.15::DOUBLE * 1.0::DOUBLE + 0.10::DOUBLE * CASE WHEN g <= 1 THEN 1.0::DOUBLE WHEN g <= 2 THEN 0.7::DOUBLE WHEN g <= 3 THEN 0.5::DOUBLE WHEN g <= 5 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS s FROM t) SELECT query_id, round(s, 6) AS composite, CASE WHEN round(s, 6) >= 0.70 THEN 'HIGH' WHEN round(s, 6) >= 0.40 THEN 'MEDIUM' WHEN round(s, 6) >= 0.20 THEN 'LOW' ELSE 'MISS' END AS level FROM c")
def confidence_levels(spark: SparkSession, d: str) -> DataFrame:
    from lodeseam.operators.resolve import confidence

    top = Lexical(spark, d).bm(12).where(F.col("rank") <= F.col("query_id") % 12 + 1).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    t = top.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("g"))
    c = confidence(F.lit("bm25"), F.lit(0.4), F.col("n"), F.lit(0), F.col("g"))
    return t.select("query_id", c.alias("c")).select("query_id", F.col("c.composite").alias("composite"), F.col("c.level").alias("level"))
