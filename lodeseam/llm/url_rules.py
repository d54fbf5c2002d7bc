"""URL filters: host-suffix and path-prefix expressions met by an equi-join on short hash prefixes.

Each distinct (host, path) is expanded into every suffix of its host labels combined with every prefix of its
path whose length some rule has.  An expression's SHA-256 digest is cut to its first 32 bits for the join; the
full digest is compared afterwards, so a collision of the short prefix never gives a match.  Of the rules that
fit, the longest (host plus path, in characters) wins; then the longer host; then ``block``.

Defined results: a null url or one without ``://`` has an empty host and path and fits no rule; rows without a
rule get ``default``; repeated pages keep one row each; an empty rule table leaves every row to ``default``;
other columns of the pages pass through unchanged, but for those that clash with the added names, which are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm.columns import ascii_lower
from lodeseam.session import persisted

#: Rules up to this many rows are broadcast to the join; more are shuffled.
BROADCAST_RULES = 20_000
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased.  Path: then up to ``? #``."""
    known = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.expr("substring({0}, locate('://', {0}) + 3)".format("`__url`"))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, ascii_lower(host)).otherwise(""), F.when(known, path).otherwise("")


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def match_rules(spark: SparkSession, sites: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path) of ``sites`` with the winning ``rule`` and its ``verdict``; only those that some rule fits."""
    listed = rules.dropna(subset=["verdict", "host", "path"]).select("verdict", ascii_lower(F.col("host")).alias("rhost"), F.col("path").alias("rpath")).distinct()
    lengths = sorted(r[0] for r in listed.select(F.length("rpath")).distinct().collect())  # as many as a path has characters, at most
    few = len(listed.limit(BROADCAST_RULES + 1).select("verdict").collect()) <= BROADCAST_RULES
    listed = listed.withColumn("rdigest", _digest(F.col("rhost"), F.col("rpath"))).withColumn("short", F.substring("rdigest", 1, 8))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring(F.col("path"), 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    wide = (
        sites.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("xhost"), F.filter(prefixes, lambda p: p.isNotNull()).alias("xpaths"))
        .select("host", "path", "xhost", F.explode("xpaths").alias("xpath"))
        .withColumn("xdigest", _digest(F.col("xhost"), F.col("xpath")))
        .withColumn("short", F.substring("xdigest", 1, 8))
    )
    hits = wide.join(F.broadcast(listed) if few else listed, "short").where(F.col("xdigest") == F.col("rdigest"))
    best = F.max_by(F.struct(F.concat("rhost", "rpath").alias("rule"), "verdict"), F.struct(F.length("rhost") + F.length("rpath"), F.length("rhost"), F.when(F.col("verdict") == "block", 1).otherwise(0)))
    return hits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def filter_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict."""
    host, path = host_and_path(F.col("__url"))
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parted = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{url_col}`").alias("__url")).withColumn("host", host).withColumn("path", path).drop("__url")
    won = persisted(spark, match_rules(spark, parted.select("host", "path").distinct(), rules), "url-rules")
    return parted.join(won, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
