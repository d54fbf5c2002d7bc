"""Linking, span and stratum queries over surrogate symbols: parts are symbols, brands their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.operators import link
from lodeseam.plans.registry import query, table

_SYM = "sy AS (SELECT p_brand || '::T' || (p_size % 7) || '.n' || (p_partkey % 400) AS fqn, p_brand AS file, 'T' || (p_size % 7) || '.n' || (p_partkey % 400) AS member, 'n' || (p_partkey % 400) AS name, p_partkey % 90 AS first, p_partkey % 90 + p_size AS last_line FROM part)"


def symbols(spark: SparkSession, d: str) -> DataFrame:
    n = F.concat(F.lit("n"), F.col("p_partkey") % 400)
    member = F.concat(F.lit("T"), F.col("p_size") % 7, F.lit("."), n)
    p = table(spark, d, "part")
    return p.select(F.concat("p_brand", F.lit("::"), member).alias("fqn"), F.col("p_brand").alias("file"), member.alias("member"), n.alias("name"), (F.col("p_partkey") % 90).alias("first"), (F.col("p_partkey") % 90 + F.col("p_size")).alias("last_line"))


@query("shortname_index", f"WITH {_SYM} SELECT short, count(DISTINCT fqn)::BIGINT AS n FROM (SELECT member AS short, fqn FROM sy UNION ALL SELECT name, fqn FROM sy) GROUP BY short")
def shortname_index(spark: SparkSession, d: str) -> DataFrame:
    return link.short_names(symbols(spark, d)).groupBy("short").agg(F.countDistinct("fqn").alias("n"))


@query(
    "resolve_cascade",
    f"""WITH {_SYM}, sn AS (SELECT DISTINCT short, fqn AS dst, file AS dfile FROM (SELECT member AS short, fqn, file FROM sy UNION ALL SELECT name, fqn, file FROM sy)), cn AS (SELECT short, count(DISTINCT dst) AS n FROM sn GROUP BY short),
    rf AS (SELECT DISTINCT p_brand AS file, 'n' || (p_partkey % 450) AS name FROM part),
    j AS (SELECT rf.*, dst, CASE WHEN dst = file || '::' || name THEN 1 WHEN n = 1 THEN 2 WHEN file = dfile THEN 3 ELSE 4 END AS prio FROM rf JOIN sn ON short = name JOIN cn USING (short)),
    b AS (SELECT *, min(prio) OVER (PARTITION BY file, name) AS top FROM j), k AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY dst) AS k FROM b WHERE prio = top)
    SELECT file, name, dst, [1.0, 0.9, 0.95, 0.7][prio]::DOUBLE AS conf FROM k WHERE k <= CASE WHEN prio = 4 THEN 3 ELSE 1 END""",
)
def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.concat(F.lit("n"), F.col("p_partkey") % 450).alias("name")).distinct()
    return link.resolve_names(refs, symbols(spark, d).dropDuplicates(["fqn"]))


@query(
    "innermost_span",
    f"""WITH {_SYM}, pt AS (SELECT DISTINCT p_brand AS path, p_partkey % 110 AS line FROM part), sp AS (SELECT DISTINCT file, fqn, first, last_line FROM sy)
    SELECT path, line, fqn AS span FROM (SELECT *, row_number() OVER (PARTITION BY path, line ORDER BY last_line - first, first DESC, fqn) AS n FROM pt JOIN sp ON path = file AND line BETWEEN first AND last_line) WHERE n = 1""",
)
def innermost_span(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "part").select(F.col("p_brand").alias("path"), (F.col("p_partkey") % 110).alias("line")).distinct()
    return link.innermost(points, symbols(spark, d).distinct(), "path", "line")


@query("named_strata", "SELECT contains(text, 'the') AS named, CASE WHEN quality = 1 AND toxic = 0 THEN 'win' WHEN quality = 0 AND toxic = 1 THEN 'loss' ELSE 'tie' END AS outcome, count(*)::BIGINT AS n, round(avg(n_chars), 6) AS chars FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def named_strata(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    outcome = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "win").when((F.col("quality") == 0) & (F.col("toxic") == 1), "loss").otherwise("tie")
    return j.groupBy(F.col("text").contains("the").alias("named"), outcome.alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("chars"))


@query("load_test_summary", "SELECT user_id % 4 AS level, count(*) FILTER (value > 10)::BIGINT AS ok, count(*) FILTER (value <= 10)::BIGINT AS failed, round(sum(value) / count(DISTINCT user_id), 6) AS per_user, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def load_test_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("level"))
    disc = lambda q: F.expr(f"round(percentile_disc({q}) WITHIN GROUP (ORDER BY value), 6)")
    return e.agg(F.count(F.when(F.col("value") > 10, 1)).alias("ok"), F.count(F.when(F.col("value") <= 10, 1)).alias("failed"), F.round(F.sum("value") / F.countDistinct("user_id"), 6).alias("per_user"), disc(0.5).alias("p50"), disc(0.95).alias("p95"))


@query("outliers", "WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1) SELECT event_id, event_type FROM events JOIN m USING (event_type) WHERE value > 3 * med")
def outliers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    m = e.groupBy("event_type").agg(F.percentile("value", 0.5).alias("med"))
    return e.join(m, "event_type").where(F.col("value") > 3 * F.col("med")).select("event_id", "event_type")
