"""The engine's front: an index over a source tree, and batches of queries against it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.functions import text as tx
from lodeseam.operators import changes, graph, link, rank, resolve
from lodeseam.session import persisted
from lodeseam.sources import files, parse


@dataclass
class Index:
    """Tables of an index: sources, parsed rows, symbols and edges."""

    sources: DataFrame
    parsed: DataFrame
    symbols: DataFrame
    edges: DataFrame

    @classmethod
    def of_sources(cls, spark: SparkSession, sources: DataFrame, parsed: DataFrame | None = None) -> Index:
        """Symbols and edges are written once: every search, walk and score reads them."""
        parsed = parse.parse(spark, sources) if parsed is None else persisted(spark, parsed, "parsed")
        s = persisted(spark, parse.symbols(parsed), "symbols")
        return cls(sources, parsed, s, persisted(spark, link.link(s, parse.imports(parsed), parse.calls(parsed)), "edges"))

    @classmethod
    def build(cls, spark: SparkSession, root: str, ignore: list[str] | None = None) -> Index:
        return cls.of_sources(spark, files.read_sources(spark, root, ignore))

    def update(self, spark: SparkSession, sources: DataFrame) -> Index:
        """The index of changed sources: only changed files are parsed; names are resolved anew for all, so the
        result equals a full build."""
        diff = changes.snapshot_diff(self.sources, sources, "path")
        fresh = parse.parse(spark, sources.join(diff.where("status <> 'deleted'"), "path", "left_semi"))
        return Index.of_sources(spark, sources, changes.update_rows(self.parsed, fresh, diff, "path"))

    def save(self, spark: SparkSession, folder: str) -> str:
        return files.save_index(spark, folder, {"sources": self.sources, "parsed": self.parsed, "symbols": self.symbols, "edges": self.edges})

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index | None:
        t = files.load_index(spark, folder)
        return cls(t["sources"], t["parsed"], t["symbols"], t["edges"]) if t else None


class Engine:
    """Batches of queries (query_id, text) against an index; all methods return DataFrames."""

    def __init__(self, spark: SparkSession, index: Index, settings: files.Settings | None = None) -> None:
        self.spark, self.index, self.settings = spark, index, settings or files.Settings()

    def corpus(self) -> DataFrame:
        parts = ("fqn", "signature", "docstring", "body")
        return self.index.symbols.select(F.col("fqn").alias("doc_id"), F.concat_ws(" ", *parts).alias("text"))

    @cached_property
    def postings(self) -> rank.Postings:
        """The corpus as all lexical rankings read it, written at their first use."""
        return rank.index(self.corpus(), tx.flat_tokens)

    def search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """BM25 over identifiers."""
        s = self.settings
        return rank.bm25(queries, self.postings, k or s.top_k, k1=s.k1, b=s.b)

    def fuse(self, queries: DataFrame, k: int | None = None, dense: DataFrame | None = None) -> DataFrame:
        """BM25, structural order and, where the caller has one, a dense list (or keywords) by reciprocal ranks."""
        k = k or self.settings.top_k
        depth = max(3 * k, 60)
        third = rank.keyword_search(queries, self.postings, depth, self.settings.min_score) if dense is None else dense
        structural = self.resolve(queries, depth).select("query_id", F.col("fqn").alias("doc_id"), "rank", "score")
        return rank.rrf([self.search(queries, depth), third, structural], k, rrf_k=self.settings.rrf_k)

    def resolve(self, queries: DataFrame, top: int = 50) -> DataFrame:
        """Targets, what the graph adds, constructors; scored and cut."""
        pool = self.search(queries, 25).withColumnRenamed("doc_id", "fqn")
        return resolve.resolve(self.spark, queries, pool, self.index.symbols, self.index.edges, self.settings.graph_policy, top)

    def get(self, names: DataFrame) -> DataFrame:
        """(asked, fqn): the exact symbol, else one that ends so, else one that holds it; the shortest of several."""
        s = self.index.symbols.select("fqn", "name")
        keys = F.transform(rank.units(F.col("asked")), lambda u: F.struct(F.length(u).alias("n"), u.alias("u")))
        asked = names.select("asked").distinct().withColumn("w", F.array_max(keys)["u"]).where("w IS NOT NULL")
        held = s.select("fqn", "name", F.explode(rank.units(F.col("fqn"))).alias("u"))
        j = asked.join(rank.containing(held, asked), "w").join(held, "u").where(F.col("fqn").contains(F.col("asked"))).select("asked", "fqn", "name").distinct()
        prio = F.when(F.col("fqn") == F.col("asked"), 1).when(F.col("fqn").endswith(F.col("asked")), 2).otherwise(3)
        return j.groupBy("asked").agg(F.min(F.struct(prio, F.length("fqn"), "fqn"))["fqn"].alias("fqn"))

    def expand(self, ranges: DataFrame) -> DataFrame:
        """(path, first, last, body) of line ranges; a null range is the whole file."""
        j = ranges.join(self.index.sources.select("path", "content"), "path")
        first, last = F.coalesce("first", F.lit(1)), F.coalesce("last", F.size(F.split("content", "\n")))
        return j.select("path", first.alias("first"), last.alias("last"), files.body_lines(F.col("content"), first, last).alias("body"))

    def outline(self, per_file: int = 20) -> DataFrame:
        """(dir, file, symbols): up to ``per_file`` members of each file in line order."""
        s = self.index.symbols.withColumn("n", F.row_number().over(W.partitionBy("file").orderBy("first", "fqn"))).where(F.col("n") <= per_file)
        rows = s.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "member"))), lambda x: x["member"]).alias("symbols"))
        return rows.select(F.regexp_replace("file", "/?[^/]*$", "").alias("dir"), "file", "symbols")

    def overview(self, k: int = 20) -> DataFrame:
        nodes, edges = graph.build([self.index.symbols.select(F.col("fqn").alias("node"))], [self.index.edges])
        return graph.top_ranked(graph.pagerank(self.spark, nodes, edges), self.index.symbols.select(F.col("fqn").alias("node")), k)

    def impact(self, changed: DataFrame, depth: int = 2) -> DataFrame:
        s = self.index.symbols.select(F.col("fqn").alias("node"), F.col("file").alias("grp"), "complexity", "exported")
        return changes.impact(self.spark, changed, self.index.edges, s, depth)
