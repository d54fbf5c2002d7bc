"""Context, stores, streams and the small functions that queries don't show whole."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseam import session
from lodeseam.functions import rules
from lodeseam.functions import text as tx
from lodeseam.operators import changes, context, evaluate, graph, link, resolve, trials
from lodeseam.sources import files
from lodeseam.streaming import jobs


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def a(name="a"):
    return F.col(name)


def test_renderers_and_summaries(spark):
    cases = {"fqn": "m.py::Box.open_lid", "sig": "def open_lid(self, how: str) -> bool", "doc": "Opens the lid.\nMore."}
    row = {k: v for k, v in cases.items()}
    assert one(spark, tx.tier2(a("fqn"), a("sig"), a("doc")), **row) == "m.py::Box.open_lid | def open_lid(self, how: str) -> bool | Opens the lid."
    assert one(spark, tx.tier3(a("fqn"), a("sig")), **row) == "m.py::Box.open_lid -> bool" and one(spark, tx.tier3(a("fqn"), F.lit("f(x)")), **row) == "m.py::Box.open_lid"
    words = F.array(*[F.lit(f"k{i}") for i in range(12)])
    assert one(spark, tx.embedding_text(a("fqn"), a("sig"), a("doc"), words), **row).endswith("Opens the lid. k0 k1 k2 k3 k4 k5 k6 k7 k8 k9")
    summary = tx.local_summary(a("fqn"), F.lit(None).cast("string"), F.array(F.lit("how")), F.lit("bool"), F.slice(words, 1, 1))
    assert one(spark, summary, **row) == "open lid given how returning bool; uses k0"
    assert one(spark, tx.local_summary(a("fqn"), a("doc"), words, F.lit("x"), words), **row) == "Opens the lid."
    chosen = lambda d, e: one(spark, tx.chosen_summary(a("d"), a("e"), F.lit("made")), d=d, e=e)
    assert [chosen("one two three four five six", "x"), chosen("too short", "a b c d e f g"), chosen("too short", "so too")] == ["one two three four five six", "a b c d e f g", "made"]
    assert set(one(spark, tx.seed_variants(a()), a="src/x.py")) >= {"src/x.py", "x.py", "lib/x.py"}


def test_small_rules(spark):
    names = F.array(F.lit("parse_line"), F.lit("emit"), F.lit("Lexer"), F.lit("far"))
    level = lambda q: one(spark, rules.named_confidence(a(), names), a=q)
    assert [level("why does Parse_line fail"), level("the lexer"), level("far away")] == ["HIGH", "MEDIUM", "LOW"]
    assert [one(spark, rules.tool_phase(a()), a=t) for t in ("Grep", "read_file", "apply_patch", "Bash", "think")] == ["locate", "read", "edit", "run", "other"]
    assert {r["stack"] for r in rules.project_stack(spark.createDataFrame([("a/go.mod",), ("package.json",), ("x.txt",)], "path string")).collect()} == {"go", "node"}
    assert rules.mode_table(spark).where("mode = 'refactor'").first()["blast_depth"] == 3
    assert one(spark, rules.old_type(a()), a="refactor") == "refactor" and one(spark, rules.old_type(a()), a="odd") == "general"
    assert one(spark, rules.old_mode(a(), F.lit("MISS")), a="refactor") == "pass_through" and one(spark, rules.old_mode(a(), F.lit("LOW")), a="migrate") == "deep"
    mods = lambda text, mode, lvl: one(spark, rules.modifiers(a("t"), a("m"), a("l")), t=text, m=mode, l=lvl)
    assert mods("do it", "migrate", "LOW") == ["BLAST_FIRST", "STEP_COMMIT"] and mods("just do it", "migrate", "LOW") == ["MINIMAL"] and mods("do it", "test", "LOW") == ["THINK_ALOUD"]
    assert one(spark, context.modifier_text(F.array(F.lit("MINIMAL"), F.lit("odd")))) == "Keep the answer short."
    assert one(spark, context.capped_layer(a(), 2), a="  123456789012  ") == "12345678" and one(spark, context.capped_layer(a(), 2), a=" ") is None
    assert one(spark, resolve.token_coverage(F.array(F.lit("x"), F.lit("y"), F.lit("x")), F.array(F.lit("y")))) == 0.5


def test_follow_ups(spark):
    back = lambda t: one(spark, context.refers_back(a()), a=t)
    assert back("fix it now") and back("I think this is wrong") and not back("within the item") and not back("give it to me") and not back(None)
    turns = spark.createDataFrame([(1, 1, "open the box", ["lid", "box", "hinge", "nail"]), (1, 2, "fix it", []), (1, 3, "it fails", ["x"]), (2, 1, "fix it", None)], "conv int, n int, text string, names array<string>")
    got = {(r["conv"], r["n"]): r["resolved"] for r in context.follow_ups(turns, "conv", "n").collect()}
    assert got == {(1, 1): "open the box", (1, 2): "fix it [context: lid, box, hinge]", (1, 3): "it fails", (2, 1): "fix it"}


def test_issue_seeds(spark):
    symbols = spark.createDataFrame([("src/h.py::Header.parse", "Header.parse", "parse"), ("tests/test_h.py::parse", "parse", "parse"), ("tests/test_x.py::only_here", "only_here", "only_here"), ("src/h.py::emit", "emit", "emit")], "fqn string, member string, last string")
    issues = spark.createDataFrame([(1, "`Header.parse` breaks"), (2, "see `only_here`"), (3, "nothing")], "query_id int, text string")
    got = context.seeds_from_issue(issues, symbols, tx.is_test_path(tx.file_of(F.col("fqn"))))
    assert {(r["query_id"], r["fqn"]) for r in got.collect()} == {(1, "src/h.py::Header.parse"), (2, "tests/test_x.py::only_here")}


def test_layered_context(spark):
    queries = spark.createDataFrame([(1, "change open", "debug_investigate", ["VERIFY_ASSUMPTIONS"]), (2, "small", "retrieval_fast", [])], "query_id int, text string, mode string, modifiers array<string>")
    rows = []
    for q in (1, 2):
        rows += [(q, "a.py::Box.open", 1, 9.0, "def open(self)", "def open(self):\n    return 1" + "\n    # pad" * (1 if q == 1 else 400), "a.py", 3, False, "", 500)]
        rows += [(q, f"a.py::n{i}", 2, 5.0 - i, f"def n{i}()", "body", "a.py", 9, False, f"near {i}" if i else "", 500) for i in range(3)]
        rows += [(q, f"b.py::f{i:02d}", 3, 1.0, f"def f{i}() -> int", "body", "b.py", 1, False, "", 300) for i in range(20)]
        rows += [(q, f"t.py::test_{i:02d}", 2, 2.0, f"def test_{i}()", "body", "t.py", 1, True, "", 200) for i in range(12)]
    c = spark.createDataFrame(rows, "query_id int, fqn string, tier int, score double, signature string, body string, file string, line int, is_test boolean, summary string, file_tokens long")
    blast = spark.createDataFrame([("a.py::Box.open", f"c.py::user{i:02d}", 1 + i % 2) for i in range(14)], "start string, node string, dist long")
    layers = spark.createDataFrame([(1, "never block", "said before", None, "notes on boxes")], "query_id int, rules string, session string, architecture string, notes string")
    out = {r["query_id"]: r for r in context.layered(queries, c, blast, layers).collect()}
    heads = [x.split("\n")[0] for x in out[1]["text"].split("\n\n---\n\n")]
    assert heads == ["## Task", "## Constraints", "Check each assumption against the code.", "## Session", "## Domain", "## Context", "## Tests", "## Target Code", "## Blast Radius"]
    assert out[1]["dropped"] == 0 and out[1]["raw"] == 1000 and out[1]["reduction"] == round(1000 / out[1]["tokens"], 1)
    assert "  def n1()  # near 1" in out[1]["text"] and out[1]["text"].count("-> int") == 15 and out[1]["text"].count("def test_") == 10 and out[1]["text"].count(" < open") == 10
    assert "# a.py:3 - open\ndef open(self):" in out[1]["text"]
    assert out[2]["dropped"] == 5 and "pad" not in out[2]["text"] and "## Target Code\n  def open(self)" in out[2]["text"]


def test_runs(spark):
    runs = spark.createDataFrame([("a", True, True, "x", False), ("a", True, None, "", False), ("a", True, None, "x", False), ("a", False, True, "x", False), ("b", True, None, "", False), ("b", True, None, "", True)], "arm string, completed boolean, resolved boolean, patch string, excluded boolean")
    assert sorted(((r["arm"], r["ok"]) for r in trials.counted(runs).collect()), key=str) == sorted([("a", True), ("a", False), ("a", None), ("b", None)], key=str)
    tasks = spark.createDataFrame([(1, ["a.py", "b.md", "c.go::f"]), (2, ["x.txt"]), (3, None)], "t int, gold array<string>")
    assert [(r["t"], r["gold"]) for r in trials.code_gold(tasks).collect()] == [(1, ["a.py", "c.go::f"])]
    ranked = spark.createDataFrame([(1, "a.py::f", 2), (1, "a.py::C.f", 1), (1, "b.py::C.f", 3)], "query_id int, fqn string, rank int")
    gold = spark.createDataFrame([(1, "a.py::D.f"), (1, "z.py::f")], "query_id int, fqn string")
    assert [(r["gold"], r["rank"]) for r in trials.same_function(ranked, gold).collect()] == [("a.py::D.f", 1)]
    lists = spark.createDataFrame([(1, "x", 3), (1, "x", 1), (1, "y", 2)], "query_id int, doc_id string, rank int")
    assert sorted((r["doc_id"], r["rank"]) for r in evaluate.first_occurrence(lists).collect()) == [("x", 1), ("y", 2)]
    new, kept = changes.missing_embeddings(spark.createDataFrame([("h1",), ("h2",)], "hash string"), spark.createDataFrame([("h2", 1), ("h3", 2)], "hash string, v int"))
    assert [r["hash"] for r in new.collect()] == ["h1"] and [r["hash"] for r in kept.collect()] == ["h2"]
    s = spark.createDataFrame([("a.py", "run", "B.run", 9, "B"), ("a.py", "run", "A.run", 3, "A"), ("a.py", "f", "f", 1, None)], "file string, name string, member string, first int, parent string")
    assert {r["name"]: r["member"] for r in link.qualify(spark.createDataFrame([("a.py", "run"), ("a.py", "f")], "file string, name string"), s).collect()} == {"run": "A.run", "f": "f"}
    t = spark.createDataFrame([("r", [([("1", "grep"), ("2", "read")], []), ([], [("1", "hit")])])], "run string, turns array<struct<uses:array<struct<id:string,tool:string>>,results:array<struct<id:string,output:string>>>>")
    assert sorted((r["id"], r["tool"], r["turn"], r["output"]) for r in files.transcript_calls(t).collect()) == [("1", "grep", 0, "hit"), ("2", "read", 0, None)]


def test_bootstrap_agrees_with_resampling(spark):
    r = np.random.default_rng(5)
    x, y = r.gamma(2.0, 3.0, 400), r.gamma(3.0, 2.0, 400)
    pairs = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y, strict=True))], "id int, a double, b double")
    got = evaluate.bootstrap_ratio(spark, pairs.repartition(3)).first()
    again = evaluate.bootstrap_ratio(spark, pairs.repartition(5)).first()
    assert tuple(got) == tuple(again) and got["ratio"] == pytest.approx(x.sum() / y.sum(), abs=1e-6)
    at = r.integers(0, 400, (10_000, 400))
    low, high = np.percentile(x[at].sum(axis=1) / y[at].sum(axis=1), [2.5, 97.5])
    assert abs(got["low"] - low) < 0.01 and abs(got["high"] - high) < 0.01
    mean = evaluate.bootstrap_mean(spark, pairs.select("id", "a")).first()
    low, high = np.percentile(x[at].mean(axis=1), [2.5, 97.5])
    assert abs(mean["low"] - low) < 0.05 and abs(mean["high"] - high) < 0.05


def test_personalised_pagerank(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcxy"], "node string")
    got = {r["node"]: r["score"] for r in graph.pagerank(spark, nodes, e, tol=1e-9, restart=spark.createDataFrame([("a", 2.0)], "node string, weight double")).collect()}
    assert got["x"] == got["y"] == 0 and abs(sum(got.values()) - 1) < 1e-9 and got["a"] > got["b"] > got["c"] > 0


DIFF = """diff --git a/m.py b/m.py
--- a/m.py
+++ b/m.py
@@ -3,4 +3,5 @@ def first(x):
 keep
-gone
+new
+newer
 keep
@@ -20,1 +21,1 @@ class Box:
-old
+now
diff --git a/w.go b/w.go
--- a/w.go
+++ b/w.go
@@ -1,2 +1,2 @@ func (s *S) Run(a int) {
 a
-b
"""


def test_patches_and_tasks(spark, tmp_path):
    d = spark.createDataFrame([(1, DIFF), (2, None)], "id int, diff string")
    got = {}
    for r in files.changed_lines(d).collect():
        got.setdefault(r["file"], set()).add(r["line"])
    assert got == {"m.py": {3, 4, 5, 20, 21}, "w.go": {1, 2}}
    (tmp_path / "t.jsonl").write_text(json.dumps({"task_id": "t1", "query": "q", "patch": DIFF}) + "\nnot json\n" + json.dumps({"task_id": "t2", "gold_files": ["z.py"], "gold_fqns": ["z.py::f"]}) + "\n")
    tasks = {r["task_id"]: r for r in files.read_tasks(spark, str(tmp_path / "t.jsonl")).where("task_id is not null").collect()}
    assert tasks["t1"]["gold_files"] == ["m.py", "w.go"] and tasks["t1"]["gold_fqns"] == ["m.py::first", "m.py::Box", "w.go::Run"]
    assert tasks["t2"]["gold_files"] == ["z.py"]


def test_stores_and_reports(spark, tmp_path):
    folder = str(tmp_path / "v")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "doc_id int, vec array<double>")
    assert files.load_vectors(spark, folder) is None
    files.save_vectors(spark, folder, vectors, "m")
    assert files.load_vectors(spark, folder, vectors.select("doc_id")).count() == 5
    with pytest.raises(ValueError, match="no vector"):
        files.load_vectors(spark, folder, spark.createDataFrame([(9,)], "doc_id int"))
    path = str(tmp_path / "c.json")
    assert files.load_calibration(path) == files.DEFAULT_CALIBRATION
    files.save_calibration(path, {"thresholds": {"HIGH": 0.8}})
    assert files.load_calibration(path)["thresholds"] == {"HIGH": 0.8, "MEDIUM": 0.4, "LOW": 0.2}
    (tmp_path / "c.json").write_text("{")
    assert files.load_calibration(path) == files.DEFAULT_CALIBRATION
    rows = spark.createDataFrame([("a", 1), (None, 2)], "k string, n int")
    for kind in ("json", "csv", "markdown"):
        files.write_report(rows, str(tmp_path / kind), kind)
    text = "".join(p.read_text() for p in sorted((tmp_path / "markdown").glob("part-*")))
    assert text.startswith("| k | n |\n|-|-|\n") and "| a | 1 |" in text and "|  | 2 |" in text


def test_scratch_goes_with_its_scope(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: f"file://{tmp_path}")
    with session.scope(spark) as keep:
        session.persisted(spark, spark.range(3), "inner")
        kept = keep(spark.range(4), "outer")
        lasting = session.scratch(spark, "files", lasting=True)
    names = {p.name.split("-")[0] for p in tmp_path.iterdir()}
    assert names == {"outer"} and kept.count() == 4 and lasting.startswith("file://")
    session.discard(kept)
    assert not list(tmp_path.iterdir())
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    out = graph.bfs(spark, edges, spark.createDataFrame([("a",)], "start string"), 3)
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"reached"} and out.count() == 2
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    session.small_batches(spark, 512)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "100"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Fake:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Conf())

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_folder(Fake)
    Fake.sparkContext.master = "local[4]"
    assert session.shared_folder(Fake).startswith("file:")


def test_queues_sessions_and_an_index_from_streams(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"f{r.randint(0, 24)}", float(i)) for i in range(60)]
    queue = spark.createDataFrame(rows, "fqn string, enqueued_at double")
    queue.coalesce(1).write.parquet(str(tmp_path / "q"))
    seen = []
    jobs.drain_queue(spark.readStream.schema(queue.schema).parquet(str(tmp_path / "q")), lambda df: seen.append([x["fqn"] for x in df.collect()]), str(tmp_path / "cq")).awaitTermination(120)
    last = {f: t for f, t in rows}
    assert [f for part in seen for f in part] == sorted(last, key=lambda f: (last[f], f)) and max(map(len, seen)) == 10
    ch = spark.createDataFrame([(1, "a.py", "python", "def one(): pass\n", "s1"), (3, "a.py", "python", "def three(): pass\n", "s3"), (2, "a.py", "python", "def two(): pass\n", "s2"), (4, "b.py", "python", "def b(): pass\n", "s4")], "seq long, path string, language string, content string, sha string")
    stream = lambda: spark.readStream.schema(ch.schema).parquet(str(tmp_path / "ch"))
    ch.coalesce(1).write.parquet(str(tmp_path / "ch"))
    folder, cp = str(tmp_path / "index"), str(tmp_path / "cp")
    jobs.keep_index(spark, stream(), folder, cp).awaitTermination(120)
    names = lambda: {x["fqn"] for x in files.load_index(spark, folder)["symbols"].collect()}
    assert names() == {"a.py::three", "b.py::b"}
    spark.createDataFrame([(5, "b.py", None, None, None)], ch.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ch"))
    jobs.keep_index(spark, stream(), folder, cp).awaitTermination(120)
    assert names() == {"a.py::three"}
