"""What surrounds a retrieval: follow-up questions, tests of a source, notes, constants, and the layered context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.functions import rules
from lodeseam.functions import text as tx
from lodeseam.operators import assemble, graph

# fixed values: what refers to something said before
REFERS = r"(?i)\b(it|that|this|those|the same)\b"
REFERS_AT_ONCE = r"(?i)^\s*(fix|debug|update|refactor|explain|test)\s+(it|this|that)\b"
REFERS_AS_SUBJECT = r"(?i)\b(it|this|that)\s+(is|was|has|should|doesn|does|needs|fails)"


def refers_back(prompt: Column) -> Column:
    """Whether a prompt speaks of something that it doesn't name."""
    p = F.coalesce(prompt, F.lit(""))
    return p.rlike(REFERS) & (p.rlike(REFERS_AT_ONCE) | p.rlike(REFERS_AS_SUBJECT))


def with_context(prompt: Column, names: Column) -> Column:
    """A prompt that refers back, with the first three names of the turn before."""
    hint = F.concat(F.lit(" [context: "), F.array_join(F.slice(names, 1, 3), ", "), F.lit("]"))
    return F.when(refers_back(prompt) & (F.coalesce(F.size(names), F.lit(0)) > 0), F.concat(prompt, hint)).otherwise(prompt)


def follow_ups(turns: DataFrame, by: str, order: str) -> DataFrame:
    """``turns`` (by, order, text, names) with ``resolved``: the text and, if it refers back, the last turn's names."""
    before = F.lag("names").over(W.partitionBy(by).orderBy(order))
    return turns.withColumn("__before", before).withColumn("resolved", with_context(F.col("text"), F.col("__before"))).drop("__before")


def test_paths(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(path, test): the files that by their names test a source.

    ``tests/test_<stem>.py`` and ``test_<stem>.py`` beside it, ``tests/test_<stem>.py`` at the root, and below
    ``tests/`` beside it ``test_<stem>.py`` and ``test_<stem>_*.py``.  Guesses and tests meet on whole keys.
    """
    dir_ = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    parent = F.when(dir_ == "", ".").otherwise(dir_)
    stem = F.regexp_replace(F.split_part("path", F.lit("/"), F.lit(-1)), r"(?<=.)\.[^.]*$", "")
    s = sources.select("path", parent.alias("parent"), stem.alias("stem")).distinct()
    name = F.concat(F.lit("test_"), "stem", F.lit(".py"))
    guesses = s.select("path", F.explode(F.array(F.concat("parent", F.lit("/tests/"), name), F.concat("parent", F.lit("/"), name), F.concat(F.lit("tests/"), name))).alias("test"))
    exact = guesses.join(files.select(F.col("path").alias("test")), "test", "left_semi")
    # A test below a folder ``tests`` offers the folder before it, and its name cut at each underscore.
    t = files.where(F.col("path").contains("/tests/") & F.col("path").endswith(".py")).select(F.col("path").alias("test"), F.split("path", "/").alias("parts"))
    parents = F.transform(F.filter(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.element_at("parts", i) == "tests"), lambda i: F.array_join(F.slice("parts", 1, i - 1), "/"))
    base = F.lower(F.element_at("parts", -1))
    words = F.split(F.regexp_extract(base, r"^test_(.*)\.py$", 1), "_")
    stems = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, 1, i), "_"))
    offered = t.where(base.rlike(r"^test_.+\.py$")).select("test", F.explode(parents).alias("parent"), stems.alias("stems")).select("test", "parent", F.explode("stems").alias("low"))
    below = s.withColumn("low", F.lower("stem")).join(offered, ["parent", "low"]).select("path", "test")
    return exact.select("path", "test").unionByName(below).distinct()


def notes_for(paths: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, note): notes named as one of a path's folders.  ``notes`` (note)."""
    parts = F.split("path", "/")
    folders = paths.select("path", F.explode(F.array_distinct(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)))).alias("note"))
    return folders.join(notes.select("note").distinct(), "note").select("path", "note")


def constants_of(ranked: DataFrame, constants: DataFrame, files: int = 3, cap: int = 12) -> DataFrame:
    """(query_id, fqn, signature, n): constants of the files of a query's best hits, in the order of files and lines.

    ``ranked`` (query_id, fqn, rank), ``constants`` (fqn, file, first, signature).
    """
    top = ranked.select("query_id", tx.file_of(F.col("fqn")).alias("file"), "rank").groupBy("query_id", "file").agg(F.min("rank").alias("rank"))
    top = top.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "file"))).where(F.col("place") <= files)
    rows = top.join(constants.select("fqn", "file", "first", "signature"), "file")
    n = F.row_number().over(W.partitionBy("query_id").orderBy("place", "first", "fqn")).cast("long")
    return rows.withColumn("n", n).where(F.col("n") <= cap).select("query_id", "fqn", "signature", "n")


def test_scores(queries: DataFrame, tests: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, fqn, score): tests scored by a query's terms: 4 for one in the name, 2 in the body, 1 in signature or
    docstring.  ``pairs`` (query_id, fqn) are the tests to look at."""
    q = queries.select("query_id", F.array_distinct(F.filter(tx.query_tokens(F.col("text")), lambda w: F.length(w) > 2)).alias("terms"))
    rows = pairs.join(q, "query_id").join(tests.select("fqn", "name", "signature", "docstring", "body"), "fqn")
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    held = lambda text: F.size(F.filter("terms", lambda w: text.contains(w)))
    return rows.select("query_id", "fqn", (4 * held(low("name")) + 2 * held(low("body")) + held(F.concat_ws(" ", low("signature"), low("docstring")))).cast("long").alias("score"))


def seeds_from_issue(issues: DataFrame, symbols: DataFrame, is_test: Column, cap: int = 12) -> DataFrame:
    """(query_id, fqn): symbols that an issue names, by last name or by the end of the member; tests only where
    nothing else is named; the most dotted, then shortest, ``cap`` of them.  ``symbols`` (fqn, member, last)."""
    named = issues.select("query_id", F.explode(tx.issue_symbols(F.col("text"))).alias("s"))
    keys = named.select("query_id", F.element_at(F.split("s", r"\."), -1).alias("last"))
    found = symbols.join(keys.distinct(), "last").select("query_id", "fqn").distinct().withColumn("test", is_test)
    wanted = found.withColumn("source", F.max(~F.col("test")).over(W.partitionBy("query_id"))).where(~F.col("test") | ~F.col("source"))
    dots = F.length("fqn") - F.length(F.replace("fqn", F.lit("."), F.lit("")))
    n = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(dots), F.length("fqn"), "fqn"))
    return wanted.withColumn("n", n).where(F.col("n") <= cap).select("query_id", "fqn")


def expand_by_task(spark: SparkSession, targets: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, fqn, tier, dist): what a target's task brings along; nearest first where several ways lead to it.

    ``targets`` (query_id, fqn, task), ``symbols`` (fqn, file).  Debugging, editing and refactoring follow the graph both
    ways and add tests; explaining follows dependencies one step further, of which two are near, and direct callers;
    creating takes the rest of the file; reviewing looks at what is affected.
    """
    starts = targets.select(F.col("fqn").alias("start")).distinct()
    back, ahead = graph.blast_radius(spark, edges, starts, depth), graph.dependency_chain(spark, edges, starts, depth + 1)
    t = targets.select("query_id", F.col("fqn").alias("start"), "task")
    change = F.col("task").isin("debug", "edit", "refactor")
    near = lambda n: F.when(F.col("dist") <= n, 2).otherwise(3)
    affected = t.where(change | F.col("task").isin("review")).join(back, "start").select("query_id", F.col("node").alias("fqn"), near(1).alias("tier"), "dist")
    needed = t.where(change).join(ahead.where(F.col("dist") <= depth), "start").select("query_id", F.col("node").alias("fqn"), near(1).alias("tier"), "dist")
    explained = t.where("task = 'explain'").join(ahead, "start").select("query_id", F.col("node").alias("fqn"), near(2).alias("tier"), "dist")
    callers = t.where("task = 'explain'").join(back.where("dist = 1"), "start").select("query_id", F.col("node").alias("fqn"), F.lit(2).alias("tier"), "dist")
    one = [F.lit(2).alias("tier"), F.lit(1).cast("long").alias("dist")]
    tests = t.where(change).join(graph.test_coverage(edges), F.col("start") == F.col("node")).select("query_id", F.col("test").alias("fqn"), *one)
    file = symbols.select("fqn", "file")
    mates = t.where("task = 'create'").join(file.withColumnRenamed("fqn", "start"), "start").select("query_id", "file").join(file, "file").select("query_id", "fqn", *one)
    every = affected.unionByName(needed).unionByName(explained).unionByName(callers).unionByName(tests).unionByName(mates)
    known = every.join(symbols.select("fqn"), "fqn", "left_semi").join(targets.select("query_id", "fqn"), ["query_id", "fqn"], "left_anti")
    return known.groupBy("query_id", "fqn").agg(F.min(F.struct("tier", "dist")).alias("m")).select("query_id", "fqn", "m.*")


# fixed values: what a modifier says, and the caps of the layers
MODIFIER_TEXTS = {"MINIMAL": "Keep the answer short.", "THINK_ALOUD": "Reason step by step before you answer.", "VERIFY_ASSUMPTIONS": "Check each assumption against the code.", "STEP_COMMIT": "Work in small steps that can each be committed.", "BRAINSTORM": "Name several ways before you choose one.", "BLAST_FIRST": "List what a change affects before you make it."}
MAX_FAR, MAX_TESTS, BLAST_TARGETS, BLAST_LINES = 15, 10, 3, 10


def modifier_text(modifiers: Column) -> Column:
    """The instructions that a query's modifiers stand for, a line each."""
    table = F.create_map(*[F.lit(x) for kv in MODIFIER_TEXTS.items() for x in kv])
    return F.array_join(F.array_compact(F.transform(modifiers, lambda m: table[m])), "\n")


def capped_layer(text: Column, tokens: int) -> Column:
    """A layer's text, cut at its budget of four characters a token; null where there is none."""
    return F.nullif(F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, 4 * tokens), F.lit(""))


def layered(queries: DataFrame, candidates: DataFrame, blast: DataFrame, layers: DataFrame) -> DataFrame:
    """(query_id, text, tokens, raw, reduction, dropped): the context of each query in the order that is read best: task,
    rules, modifiers, session, architecture, notes, context, tests, targets, what is affected.

    ``queries`` (query_id, text, mode, modifiers), ``candidates`` (query_id, fqn, tier, score, signature, body, file,
    line, is_test, summary, file_tokens), ``blast`` (start, node, dist), ``layers`` (query_id, rules, session,
    architecture, notes; null where a mode loads none).  Over the mode's budget optional parts go, the last of this list
    first: notes, what is affected, tests, context; then the targets' bodies become signatures.
    """
    name = tx.bare_name(F.col("fqn"))
    head = F.concat(F.lit("# "), "file", F.lit(":"), F.col("line").cast("string"), F.lit(" - "), name)
    hint = F.concat(F.lit("  "), "signature", F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("  # "), F.substring("summary", 1, 80))).otherwise(""))
    place = lambda part: F.row_number().over(W.partitionBy("query_id", part).orderBy(F.desc("score"), "fqn"))
    c = candidates.withColumn("part", F.when(F.col("tier") == 1, "target").when(F.col("is_test"), "test").when(F.col("tier") == 2, "near").otherwise("far")).withColumn("n", place("part"))
    c = c.where(((F.col("part") != "far") | (F.col("n") <= MAX_FAR)) & ((F.col("part") != "test") | (F.col("n") <= MAX_TESTS)))
    line = F.when(F.col("part") == "target", F.concat(head, F.lit("\n"), "body")).when(F.col("part") == "test", F.concat(F.lit("  "), "signature", F.lit("  # "), "file")).when(F.col("part") == "near", hint).otherwise(F.concat(F.lit("  "), tx.tier3(F.col("fqn"), F.col("signature"))))
    c = c.withColumn("entry", line).withColumn("rank", F.when(F.col("part") == "far", F.col("n") + 1_000_000).otherwise(F.col("n")))
    of = lambda parts, text, sep: assemble.joined(c.where(F.col("part").isin(parts)), "query_id", "rank", text, sep)
    b = c.where((F.col("part") == "target") & (F.col("n") <= BLAST_TARGETS)).select("query_id", F.col("fqn").alias("start"), F.col("n").alias("rank")).join(blast, "start")
    b = b.withColumn("m", F.row_number().over(W.partitionBy("query_id", "start").orderBy("dist", "node"))).where(F.col("m") <= BLAST_LINES)
    b = b.withColumn("place", F.col("rank") * 100 + F.col("m"))
    affected = assemble.joined(b, "query_id", "place", F.concat(F.lit("  "), F.repeat(F.lit(">"), F.col("dist").cast("int")), F.lit(" "), tx.bare_name(F.col("node")), F.lit(" < "), tx.bare_name(F.col("start"))), "\n")
    rows = queries.join(layers, "query_id", "left")
    for label, df in (("context", of(["near", "far"], F.col("entry"), "\n")), ("tests", of(["test"], F.col("entry"), "\n\n")), ("bodies", of(["target"], F.col("entry"), "\n\n")), ("signatures", of(["target"], F.concat(F.lit("  "), "signature"), "\n")), ("affected", affected)):
        rows = rows.join(df.withColumnRenamed("text", label), "query_id", "left")
    rows = rows.join(assemble.raw_tokens(candidates, "query_id", "file", "file_tokens"), "query_id", "left")
    section = lambda title, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), text))

    def whole(dropped: Column) -> Column:
        at = lambda text, step: F.when(dropped < step, text)
        return F.concat_ws("\n\n---\n\n", section("Task", F.col("text")), section("Constraints", F.col("rules")), F.nullif(modifier_text(F.col("modifiers")), F.lit("")), section("Session", F.col("session")), section("Architecture", F.col("architecture")), section("Domain", at(F.col("notes"), 1)), section("Context", at(F.col("context"), 4)), section("Tests", at(F.col("tests"), 3)), section("Target Code", F.when(dropped < 5, F.col("bodies")).otherwise(F.col("signatures"))), section("Blast Radius", at(F.col("affected"), 2)))

    budget = rules.mode_value(F.col("mode"), 2, 4000)
    versions = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda d: F.struct(d.alias("dropped"), whole(d).alias("text")))
    fits = F.filter("versions", lambda v: tx.est_tokens(v["text"]) <= budget)
    made = rows.withColumn("versions", versions).withColumn("v", F.coalesce(F.get(fits, F.lit(0)), F.element_at("versions", -1)))
    tokens = tx.est_tokens(F.col("v.text"))
    return made.select("query_id", F.col("v.text").alias("text"), tokens.alias("tokens"), "raw", F.round(F.coalesce("raw", F.lit(0)) / F.greatest(tokens, F.lit(1)), 1).alias("reduction"), F.col("v.dropped").alias("dropped"))
