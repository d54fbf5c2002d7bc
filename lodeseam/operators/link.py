"""From symbols, imports and calls to typed edges: each cascade is one union of prioritised matches and a minimum.

Candidates of equal priority are ordered by name, where the order of a set would decide otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.operators import intervals

EDGE = ["src", "dst", "etype", "line", "conf"]


def short_names(symbols: DataFrame) -> DataFrame:
    """(short, fqn, file): each symbol under its full member name and its last segment."""
    return symbols.select(F.explode(F.array_distinct(F.array("member", "name"))).alias("short"), "fqn", "file")


def innermost(points: DataFrame, spans: DataFrame, file: str, line: str, *, by_start: bool = False) -> DataFrame:
    """Each point with the span of its file that holds its line: the latest start, or the shortest span.

    ``spans`` (file, fqn, first, last_line).
    """
    s = spans.select(F.col("file").alias(file), F.col("fqn").alias("span"), F.col("first").cast("long").alias("__a"), F.col("last_line").cast("long").alias("__z"))
    order = F.struct(-F.col("__a"), "span") if by_start else F.struct(F.col("__z") - F.col("__a"), -F.col("__a"), "span")
    held = intervals.containing(points.distinct(), s, [file], line, "__a", "__z")
    return held.groupBy(*points.columns).agg(F.min(order)["span"].alias("span"))


def resolve_names(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref columns, dst, conf) of refs (file, name, ...): the file's own top-level name 1.0, a unique name .9, of the
    same file among many .95, else the first three at .7; names that nothing has are dropped."""
    names = short_names(symbols).select(F.col("short").alias("name"), F.col("fqn").alias("dst"), F.col("file").alias("dfile"))
    n = names.groupBy("name").agg(F.countDistinct("dst").alias("n"))
    j = refs.join(names, "name").join(n, "name")
    same = F.col("file") == F.col("dfile")
    exact = F.col("dst") == F.concat("file", F.lit("::"), "name")
    prio = F.when(exact, 1).when(F.col("n") == 1, 2).when(same, 3).otherwise(4)
    conf = F.element_at(F.array(*map(F.lit, (1.0, 0.9, 0.95, 0.7))), prio)
    key = W.partitionBy(*refs.columns)
    best = j.withColumn("prio", prio).withColumn("conf", conf).withColumn("top", F.min("prio").over(key)).where("prio = top")
    few = best.withColumn("k", F.row_number().over(key.orderBy("dst"))).where(F.col("k") <= F.when(F.col("prio") == 4, 3).otherwise(1))
    return few.select(*refs.columns, "dst", "conf")


def module_files(files: DataFrame) -> DataFrame:
    """(module, file): a file's dotted path and each of its suffixes; packages by their folder."""
    dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace("file", r"\.[A-Za-z]+$", ""), r"/(__init__|index|mod)$", ""), "/", ".")
    parts = F.split(dotted, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return files.select("file", F.explode(tails).alias("module")).distinct()


def resolve_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, alias, dst, conf): what an imported name stands for; ``*`` gives all exported names of the module."""
    up = F.when(F.col("level") > 0, F.array_join(F.slice(F.split("path", "/"), 1, F.greatest(F.lit(0), F.size(F.split("path", "/")) - F.col("level"))), "."))
    module = F.when(up.isNull(), F.regexp_replace(F.regexp_replace("module", r"^[./]+", ""), "[/:\\\\]+", ".")).otherwise(F.concat_ws(".", F.nullif(up, F.lit("")), F.nullif(F.col("module"), F.lit(""))))
    asked = imports.select("path", "alias", "name", module.alias("module"))
    homes = asked.join(module_files(symbols.select("file").distinct()), "module").select("path", "alias", "name", "file")
    s = symbols.where("parent is null").select("file", F.col("name").alias("sname"), "fqn", "exported")
    direct = homes.join(s, "file").where((F.col("name") == F.col("sname")) | ((F.col("name") == "*") & F.col("exported")))
    return direct.select("path", F.when(F.col("name") == "*", F.col("sname")).otherwise(F.col("alias")).alias("alias"), F.col("fqn").alias("dst"), F.lit(1.0).alias("conf")).groupBy("path", "alias").agg(F.min("dst").alias("dst"), F.max("conf").alias("conf"))


def call_edges(calls: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """Calls to edges: import map 1.0, member of an imported object .9, ``Obj.m`` of the file .85, ``self.m`` of the
    enclosing class .95, then names alone."""
    spans = symbols.where("kind <> 'constant'").select("file", "fqn", "first", "last_line")
    lost = innermost(calls.where("caller is null").drop("caller"), spans, "path", "line").withColumnRenamed("span", "caller")
    known = calls.where("caller is not null").select("path", "caller", "target", "name", "etype", "line")
    refs = known.unionByName(lost.select(*known.columns)).distinct()
    first = F.split_part("target", F.lit("."), F.lit(1))
    imp = imported.select(F.col("path").alias("ip"), F.col("alias").alias("ia"), F.col("dst").alias("idst"))
    keys = ["path", "caller", "target", "name", "etype", "line"]
    by_import = refs.join(imp, (F.col("path") == F.col("ip")) & (F.col("target") == F.col("ia"))).select(*keys, F.col("idst").alias("dst"), F.lit(1.0).alias("conf"), F.lit(1).alias("prio"))
    names = symbols.select("fqn", F.col("file").alias("sfile"), "member")
    of_import = refs.where(F.col("target").contains(".")).join(imp, (F.col("path") == F.col("ip")) & (first == F.col("ia"))).join(names, F.col("fqn") == F.concat("idst", F.lit("."), F.col("name"))).select(*keys, F.col("fqn").alias("dst"), F.lit(0.9).alias("conf"), F.lit(2).alias("prio"))
    in_file = refs.join(names, (F.col("path") == F.col("sfile")) & (F.col("target") == F.col("member")) & F.col("target").contains(".")).select(*keys, F.col("fqn").alias("dst"), F.lit(0.85).alias("conf"), F.lit(3).alias("prio"))
    owner = F.regexp_replace(F.split_part("caller", F.lit("::"), F.lit(2)), r"\.[^.]*$", "")
    own = refs.where(first.isin("self", "this", "cls") & (F.size(F.split("target", r"\.")) == 2)).join(names, (F.col("path") == F.col("sfile")) & (F.concat(owner, F.lit("."), F.col("name")) == F.col("member"))).select("path", "caller", "target", "name", F.lit("calls").alias("etype"), "line", F.col("fqn").alias("dst"), F.lit(0.95).alias("conf"), F.lit(3).alias("prio"))
    alone = resolve_names(refs.withColumn("file", F.col("path")), symbols).select(*keys, "dst", "conf", F.lit(5).alias("prio"))
    every = by_import.unionByName(of_import).unionByName(in_file).unionByName(own).unionByName(alone)
    key = W.partitionBy("path", "caller", "target", "line")
    best = every.withColumn("top", F.min("prio").over(key)).where("prio = top")
    return best.select(F.col("caller").alias("src"), "dst", "etype", F.col("line").cast("int"), F.col("conf").cast("double")).where("src <> dst").distinct()


def base_edges(symbols: DataFrame) -> DataFrame:
    """INHERITS edges; IMPLEMENTS where the child is an interface."""
    refs = symbols.select("file", F.col("fqn").alias("src"), F.col("first").alias("line"), F.when(F.col("kind") == "interface", "implements").otherwise("inherits").alias("etype"), F.explode("bases").alias("b")).withColumn("name", F.split_part("b", F.lit("."), F.lit(-1))).drop("b")
    return resolve_names(refs, symbols.where(F.col("kind").isin("class", "dataclass", "interface", "trait", "struct", "enum"))).select(*EDGE)


def decorator_edges(symbols: DataFrame) -> DataFrame:
    refs = symbols.select("file", F.col("fqn").alias("tgt"), F.col("first").alias("line"), F.explode("decorators").alias("d")).withColumn("name", F.split_part("d", F.lit("."), F.lit(-1))).drop("d")
    r = resolve_names(refs, symbols)
    return r.select(F.col("dst").alias("src"), F.col("tgt").alias("dst"), F.lit("decorates").alias("etype"), "line", "conf")


def import_edges(imports: DataFrame) -> DataFrame:
    """File to ``module::name``, as written."""
    return imports.select(F.concat("path", F.lit("::__file__")).alias("src"), F.concat("module", F.lit("::"), F.coalesce("name", F.lit("__module__"))).alias("dst"), F.lit("imports").alias("etype"), F.col("first").alias("line"), F.lit(0.8).alias("conf"))


def test_edges(calls_: DataFrame, is_test: Column) -> DataFrame:
    """Calls from test symbols count as TESTS edges too."""
    return calls_.where(is_test & F.col("etype").isin("calls", "constructs")).withColumn("etype", F.lit("tests"))


def link(symbols: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """All edges, each once."""
    from lodeseam.functions.text import file_of, is_test_path

    c = call_edges(calls, symbols, resolve_imports(imports, symbols))
    every = c.unionByName(test_edges(c, is_test_path(file_of(F.col("src"))))).unionByName(base_edges(symbols)).unionByName(decorator_edges(symbols)).unionByName(import_edges(imports))
    return every.dropDuplicates()


def qualify(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bare (file, name) to the member of the first class of the file that has it; else as it is."""
    m = symbols.where("parent is not null").groupBy("file", "name").agg(F.min_by("member", F.struct("first", "member")).alias("member"))
    return names.join(m, ["file", "name"], "left").withColumn("member", F.coalesce("member", "name"))
