"""Operators of the engine on small tables of our own."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodeseam import catalog
from lodeseam.engine import Engine, Index
from lodeseam.functions import rules
from lodeseam.functions import text as tx
from lodeseam.operators import assemble, evaluate, graph, intervals, rank, resolve, sessions
from lodeseam.sources import files, parse
from lodeseam.streaming import jobs

EDGES = [("shop.py::checkout", "shop.py::price_cart", "calls"), ("shop.py::checkout", "shop.py::charge", "calls"), ("shop.py::charge", "bank.py::send", "calls"), ("bank.py::send", "bank.py::Refused", "raises"), ("web.py::post_order", "shop.py::checkout", "calls"), ("web.py::route", "web.py::post_order", "decorates"), ("t.py::test_cart", "shop.py::price_cart", "tests"), ("t.py::test_order", "web.py::post_order", "tests"), ("shop.py::Cart", "base.py::Model", "inherits"), ("shop.py::price_cart", "shop.py::Cart", "constructs")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, etype string")


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def starts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "start string")


def found(df):
    return {r["node"].split("::")[1]: r["dist"] for r in df.collect()}


@pytest.mark.parametrize("name, tokens", [("validate_token", ["validate", "token"]), ("getUserByID_xHTTPServer", ["user", "by", "id", "http", "server"]), ("AuthMiddleware", ["auth", "middleware"]), ("self", []), (None, [])])
def test_identifier_tokens(spark, name, tokens):
    assert one(spark, tx.identifier_tokens(F.col("a")), a=name) == tokens


def test_text_functions(spark):
    assert one(spark, tx.return_type(F.col("a")), a="def f(x: int) -> list[str]:") == "list[str]"
    assert one(spark, tx.bare_name(F.col("a")), a="a/b.py::C.m") == "m" and one(spark, tx.file_of(F.col("a")), a="a/b.py::C.m") == "a/b.py"
    assert one(spark, tx.est_tokens(F.col("a")), a="ab") == 1 and one(spark, tx.est_tokens(F.col("a")), a="") == 0
    assert one(spark, tx.issue_symbols(F.col("a")), a='File "x.py", line 3, in load_it\nValueError and `Foo.bar`') == ["Foo.bar", "ValueError", "load_it"]
    assert one(spark, tx.prose_only(F.col("a")), a="hi\n```py\ncode\n```\nend") == "hi\n\nend"
    assert one(spark, tx.is_test_path(F.col("a")), a="src/test_x.py") and not one(spark, tx.is_test_path(F.col("a")), a="src/contest.py")
    assert one(spark, tx.body_keywords(F.col("a")), a="raise TokenError(self.user_name)\nx['Content-Type'] = helper_call(1)") == ["content", "token", "error", "user", "name", "helper", "call"]  # type is a stop word
    assert "token" in one(spark, tx.body_keywords(F.col("a")), a="raise TokenError()")
    assert one(spark, tx.import_names(F.col("a")), a="from x import a as b, c") == ["a", "c"]
    assert one(spark, tx.diff_shape(F.col("a")), a="diff --git a b\n--- a\n+++ b\n@@ -1 +1 @@\n+x\n-y\n-z") == (1, 2, 1, 1)
    assert one(spark, tx.looks_symbolic(F.col("a")), a="get_user") and not one(spark, tx.looks_symbolic(F.col("a")), a="how does it work here")


@pytest.mark.parametrize("text, task, mode", [("Fix the crash in auth/middleware.py line 45", "debug", "debug_targeted"), ("add a new feature", "create", "build_greenfield"), ("please refactor this", "refactor", "refactor"), ("hello", "edit", "build_guided"), ("where is the parser", "edit", "retrieval_fast"), ("migrate to v2", "migrate", "migrate")])
def test_rules(spark, text, task, mode):
    assert one(spark, rules.task_type(F.col("a")), a=text) == task
    assert one(spark, rules.query_mode(F.col("a"), F.size(rules.intent_paths(F.col("a"))) > 0), a=text) == mode


@pytest.mark.parametrize("mode, level, n, tokens, tier", [("retrieval_fast", "HIGH", 2, 400, "slm"), ("debug_targeted", "HIGH", 2, 500, "mlm"), ("architecture", "HIGH", 2, 500, "llm"), ("refactor", "LOW", 30, 7000, "llm"), ("architecture", "MISS", 5, 5000, "mlm")])
def test_tiers(spark, mode, level, n, tokens, tier):
    score = rules.complexity_score(F.col("m"), F.col("l"), F.col("n"), F.col("t"), F.lit(False))
    assert one(spark, rules.model_tier(F.col("m"), F.col("l"), score), m=mode, l=level, n=n, t=tokens) == tier


def test_search_ranks(spark):
    docs = spark.createDataFrame([("open_valve", "open valve check pressure sensor"), ("read_pressure", "read pressure gauge"), ("paint_wall", "choose colour bucket brush"), ("none", None)], "doc_id string, text string")
    q = spark.createDataFrame([(1, "pressure valve opening"), (2, "colour brush"), (3, "submarine")], "query_id int, text string")
    for f in (rank.bm25, rank.keyword_search):
        got = {}
        for r in f(q, docs, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert got == {1: ["open_valve", "read_pressure"], 2: ["paint_wall"]}
    fused = rank.rrf([rank.bm25(q, docs), rank.keyword_search(q, docs)], 5)
    turned = rank.rrf([rank.keyword_search(q, docs), rank.bm25(q, docs)], 5)
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, turned.collect()))


def test_one_join_makes_all_lists(spark):
    r = random.Random(2)
    words = [f"{a}{b}" for a in ("stone", "river", "cloud", "lamp", "mill") for b in ("", "s", "er", "ed")]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(80)], "doc_id int, text string")
    q = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(4))) for i in range(12)], "query_id int, text string")
    legs = rank.lexical_legs(q, rank.index(docs), 7)
    flat = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "rank", "score").collect()))
    assert flat(legs["bm25"]) == flat(rank.bm25(q, docs, 7))
    assert flat(legs["tokenset"]) == flat(rank.bm25(q, docs, 7, distinct_doc_tokens=True))
    assert flat(legs["keyword"]) == flat(rank.keyword_search(q, docs, 7))


def test_texts_that_hold_phrases(spark, monkeypatch):
    texts = ["the old mill stands here", "old mill", "bold mills", "", None, "été, un ancien", "a b c d", "xa b cx", "line\nold mill stands"]
    phrases = ["old mill stands", "old mill", "mill", "b", "a b c", "un", "é", "nowhere to be", ""]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string")
    p = spark.createDataFrame(list(enumerate(phrases)), "query_id int, phrase string")
    expect = sorted((i, j) for i, x in enumerate(texts) for j, y in enumerate(phrases) if x and y and y in x)
    assert sorted(map(tuple, rank.holding(t, p).collect())) == expect
    monkeypatch.setattr(rank, "BROADCAST_TOKENS", 0)  # past every bound
    assert sorted(map(tuple, rank.holding(t, p).collect())) == expect
    us, ws = spark.createDataFrame([("mill",), ("old_mill",), ("ab",), ("a",)], "u string"), spark.createDataFrame([("mil",), ("ab",), ("b",), ("old_mill",), ("l",)], "w string")
    assert sorted(map(tuple, rank.containing(us, ws).collect())) == sorted((u["u"], w["w"]) for u in us.collect() for w in ws.collect() if w["w"] in u["u"])


@pytest.mark.parametrize("k, path", [(3, None), (50, "file")])
def test_grep_scans_each_text_once(spark, monkeypatch, k, path):
    from lodeseam.operators import linescan

    monkeypatch.setattr(linescan, "SUMS", 40)  # a few lines at a time
    r = random.Random(k)
    words = ["mill", "millstone", "windmill", "river_bed", "river", "bed", "été", "ab", "Sluice", "sluices2", "x"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", "\n", ", ", "-", "\n\n"]) for _ in range(r.randint(0, 40)))
    docs = [(f"d{i % 90}" if i < 90 else f"e{i}", text(), f"src/{r.choice(words)}/{r.choice(words)}.py") for i in range(200)] + [("copy%d" % i, "Mill river\nmill  sluice bed", "a/mill") for i in range(30)] + [("null", None, "river.py"), ("nothing", None, None), ("empty", "", "")]
    asked = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 6)))) for i in range(25)] + [(25, "Mill river\nmill  sluice"), (26, "a b"), (27, None), (28, "mill river"), (29, "sluices2")]
    d, q = spark.createDataFrame(docs, "doc_id string, text string, file string").repartition(3), spark.createDataFrame(asked, "query_id int, text string")
    kws = {x["query_id"]: x["kws"] for x in q.select("query_id", tx.grep_keywords(F.col("text")).alias("kws")).collect()}
    expect = []
    for i, x in asked:
        scored = []
        for name, t, file in docs:
            total = 0.0
            for line in (t or "").lower().split("\n"):
                units = "".join(c if c.isalnum() or c == "_" else " " for c in line).split()
                total += min(5.0, sum(1.5 if w in units else 1.0 for w in kws[i] if w in line))
            phrase = " ".join((x or "").lower().split())
            total += 12 * (len(phrase) >= 8 and kws[i] != [] and phrase in (t or "").lower())
            total += 8 * sum(w in (file or "").lower() for w in kws[i]) if path else 0
            scored += [(-total, name)] if total else []
        expect += [(i, name, n, -s) for n, (s, name) in enumerate(sorted(scored)[:k], 1)]
    got = rank.grep(q, d, k, path=path)
    assert sorted(map(tuple, got.select("query_id", "doc_id", "rank", "score").collect())) == sorted(expect)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row for each word of a text


@pytest.mark.parametrize("k, positive", [(5, True), (7, False), (60, False), (400, True)])
def test_nearest_vectors(spark, monkeypatch, k, positive):
    """Matrix products give the very list of row by row sums: copies, ties, gaps, NaN and other lengths included."""
    monkeypatch.setattr(rank, "VALUES", 16 * max(8, 2 * k))  # several blocks
    r = random.Random(k)
    vec = lambda n=8: [r.choice([-0.5, -0.25, 0.0, 0.125, 0.3, r.uniform(-1, 1)]) for _ in range(n)]
    some = [vec() for _ in range(40)]
    docs = [(i, r.choice(some) if i % 3 else vec()) for i in range(300)] + [(300, None), (301, [0.5] * 7 + [None]), (302, [0.5] * 7 + [float("nan")]), (303, vec(3)), (304, [])] + [(305 + i, some[0]) for i in range(40)]
    asked = [(i, r.choice(some) if i % 2 else vec()) for i in range(40)] + [(40, None), (41, [None] + [0.1] * 7), (42, vec(3)), (43, []), (44, [0.0] * 8)]
    d, q = spark.createDataFrame(docs, "doc_id long, vec array<float>").repartition(5), spark.createDataFrame(asked, "query_id int, vec array<float>")
    pairs = d.crossJoin(q.withColumnRenamed("vec", "qv")).where(F.size("vec") == F.size("qv"))
    scored = pairs.select("query_id", "doc_id", F.round(tx.cosine(F.col("vec"), F.col("qv")), 6).alias("score"))
    expect = rank.top_k(scored.where("score > 0") if positive else scored, k)
    flat = lambda df: sorted(map(repr, df.select("query_id", "doc_id", "rank", "score").collect()))
    got = rank.dense(q, d, k, positive)
    assert flat(got) == flat(expect)
    assert "zip_with" not in got._jdf.queryExecution().toString()  # no sum of every pair, row by row
    assert rank.dense(q.limit(0), d, k).count() == 0 == rank.dense(q, d.limit(0), k).count()


def test_each_task_gives_its_own_best(spark):
    """The rows that are ranked are k of each query and core at most, however many vectors there are."""
    r = random.Random(3)
    d = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(3000)], "doc_id long, vec array<float>")
    seen = rank.dense(d.limit(20).withColumnRenamed("doc_id", "query_id"), d, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in seen and "Join" not in seen


def test_rounds_as_spark_does(spark):
    from lodeseam.operators import nearest

    r = random.Random(9)
    xs = [0.0, -0.0, 1.0000005, 2.5e-7, 5e-7, -5e-7, 1e22, -123456789.1234565, 0.1234565, 0.1234575, float("inf"), 1e-300] + [round(r.uniform(-1, 1), 7) for _ in range(500)] + [r.uniform(-9, 9) for _ in range(500)]
    expect = [x["y"] for x in spark.createDataFrame(list(enumerate(xs)), "i int, x double").select("i", F.round("x", 6).alias("y")).orderBy("i").collect()]
    assert nearest.rounded(nearest.np.array(xs)).tolist() == expect


@pytest.mark.parametrize("scale", [1.0, 1e-4, 1e9, 1e25])
@pytest.mark.parametrize("k, positive", [(3, True), (25, False)])
def test_nearly_equal_vectors(monkeypatch, scale, k, positive):
    """What single precision can't tell apart is ordered by the sums in order, at any magnitude and in batches of any size."""
    import pyarrow as pa

    from lodeseam.operators import nearest

    r = nearest.np.random.default_rng(k)
    base = r.normal(size=(6, 16))
    docs = nearest.np.concatenate([base[r.integers(0, 6, 1500)] + r.choice([0, 1e-7, 4e-7, 1e-6, 1e-3], (1500, 1)), r.normal(size=(300, 16)) * r.choice([1e-30, 1e-3, 1.0, scale], (300, 1))])
    docs[700, 3], docs[900, 5] = float("nan"), float("inf")
    asked = nearest.np.concatenate([base, base[:3] * scale, -base[:2], [[float("inf")] * 16, [0.0] * 16]])
    lists = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
    expect = []
    for q, x in enumerate(asked):
        with nearest.np.errstate(all="ignore"):
            scores = nearest.rounded(nearest.np.cumsum(x * docs, axis=1)[:, -1])
        order = sorted((i for i in range(len(docs)) if not positive or scores[i] > 0 or scores[i] != scores[i]), key=lambda i: (scores[i] == scores[i], -scores[i] if scores[i] == scores[i] else 0, i))
        expect += [(q, i, repr(float(scores[i]))) for i in order[:k]]
    monkeypatch.setattr(nearest, "ROWS", 512)
    batches = pa.table({"doc_id": list(range(len(docs))), "vec": lists(docs)}).to_batches(max_chunksize=200)
    out = pa.Table.from_batches(nearest.nearest(iter(batches), pa.table({"query_id": list(range(len(asked))), "vec": lists(asked)}), k, positive))
    assert sorted(zip(out["query_id"].to_pylist(), out["doc_id"].to_pylist(), map(repr, out["score"].to_pylist()), strict=True)) == sorted(expect)


def test_few_pairs_are_summed_in_order(monkeypatch):
    """Little more than the best: also where the session's batches are small."""
    import pyarrow as pa

    from lodeseam.operators import nearest

    r, seen = nearest.np.random.default_rng(4), []
    lists = lambda n: pa.array(r.normal(size=(n, 16)).tolist(), pa.list_(pa.float32()))
    keep = nearest.Nearest._keep
    monkeypatch.setattr(nearest.Nearest, "_keep", lambda self, *a: (seen.append(len(a[-1])), keep(self, *a)))
    batches = pa.table({"doc_id": list(range(6000)), "vec": lists(6000)}).to_batches(max_chunksize=512)
    assert sum(b.num_rows for b in nearest.nearest(iter(batches), pa.table({"query_id": list(range(50)), "vec": lists(50)}), 25, False)) == 50 * 25
    assert sum(seen) < 1.5 * 50 * 25


def test_rescore(spark, monkeypatch):
    """Given pairs alone, once for each row of an identifier; no pair is summed by expressions, no query vector shuffled."""
    monkeypatch.setattr(rank, "VALUES", 64)  # several blocks
    r = random.Random(8)
    vec = lambda n=8: [r.uniform(-1, 1) for _ in range(n)]
    docs = [(i, vec()) for i in range(60)] + [(7, vec()), (60, None), (61, [0.5] * 7 + [None]), (62, [0.5] * 7 + [float("nan")]), (63, vec(3)), (64, [])]
    asked = [(i, vec()) for i in range(20)] + [(3, vec()), (20, None), (21, [None] + [0.1] * 7), (22, vec(3)), (23, []), (None, vec())]
    pairs = [(r.randint(0, 25), r.randint(0, 66)) for _ in range(600)] + [(None, 1), (1, None)]
    d, q, c = (spark.createDataFrame(rows, s) for rows, s in ((docs, "doc_id long, vec array<float>"), (asked, "query_id int, vec array<float>"), (pairs, "query_id long, doc_id long")))
    joined = c.distinct().join(d, "doc_id").join(q.withColumnRenamed("vec", "qv"), "query_id")
    expect = rank.top_k(joined.select("query_id", "doc_id", F.round(tx.cosine(F.col("vec"), F.col("qv")), 6).alias("score")), 1000)
    got = rank.rescore(c, q, d)
    flat = lambda df: sorted(map(repr, df.select("query_id", "doc_id", "score").collect()))
    assert flat(got) == flat(expect)
    assert got.select("query_id", "rank").distinct().count() == got.count()
    assert "zip_with" not in got._jdf.queryExecution().toString()
    assert rank.rescore(c, q.limit(0), d).count() == 0


def test_points_in_intervals(spark):
    r = random.Random(6)
    ranges = [(g, a, a + r.choice([0, 1, 5, 64, 500])) for g in "ab" for a in (r.randint(-50, 400) for _ in range(60))]
    points = [(g, x) for g in "abc" for x in range(-60, 900, 7)]
    p, i = spark.createDataFrame(points, "g string, x int"), spark.createDataFrame(ranges, "g string, a int, z int")
    got = sorted((y["g"], y["x"], y["a"], y["z"]) for y in intervals.containing(p, i, ["g"], "x", "a", "z").collect())
    assert got == sorted((g, x, a, z) for g, x in points for h, a, z in ranges if g == h and a <= x <= z)
    rows = [(n, g, a, z) for n, (g, a, z) in enumerate(ranges + ranges[:20])]
    kept = {y["n"] for y in sessions.range_dedup(spark.createDataFrame(rows, "n int, g string, a int, z int"), ["g"], "a", "z", "n").collect()}
    over = lambda x, y: max(0, min(x[3], y[3]) - max(x[2], y[2]) + 1) / (x[3] - x[2] + 1)
    assert kept == {x[0] for x in rows if not any(y[1] == x[1] and y[0] < x[0] and over(x, y) >= 0.8 for y in rows)}


def test_searches_of_the_graph(spark, edges):
    assert found(graph.blast_radius(spark, edges, starts(spark, "shop.py::checkout"), 1)) == {"post_order": 1}
    assert found(graph.blast_radius(spark, edges, starts(spark, "shop.py::checkout"))) == {"post_order": 1, "route": 2, "test_order": 2}
    assert found(graph.blast_radius(spark, edges, starts(spark, "shop.py::price_cart"), types=["calls"])) == {"checkout": 1, "post_order": 2}
    assert found(graph.dependency_chain(spark, edges, starts(spark, "shop.py::checkout"), 2)) == {"price_cart": 1, "charge": 1, "Cart": 2, "send": 2}
    assert graph.bfs(spark, edges, starts(spark, "nowhere"), 3).count() == 0
    assert [r["path"] for r in graph.error_traces(edges, starts(spark, "shop.py::checkout")).collect()] == [["shop.py::checkout", "shop.py::charge", "bank.py::send"]]
    p = graph.shortest_paths(spark, edges, spark.createDataFrame([("web.py::route", "bank.py::send"), ("shop.py::Cart", "nowhere"), ("shop.py::Cart", "shop.py::Cart")], "a string, b string")).collect()
    assert {(r["a"], r["hops"]) for r in p} == {("web.py::route", 4), ("shop.py::Cart", 0)}
    path = next(r["path"] for r in p if r["hops"] == 4)
    assert all(any({x, y} == {s, d} for s, d, _ in EDGES) for x, y in zip(path, path[1:]))
    nodes = spark.createDataFrame([("shop.py::checkout",), ("shop.py::price_cart",), ("shop.py::Cart",), ("base.py::Model",)], "node string")
    assert graph.subgraph(edges, nodes).count() == 3 and graph.test_coverage(edges).count() == 2
    kept, left = graph.remove_nodes(nodes, edges, spark.createDataFrame([("shop.py::checkout",)], "node string"))
    assert kept.count() == 3 and {(r["src"], r["dst"]) for r in left.collect()} == {(s, d) for s, d, _ in EDGES if "shop.py::checkout" not in (s, d)}
    near = graph.reachable_within(spark, edges, starts(spark, "shop.py::checkout"), 2).first()
    assert (near["reachable"], near["files"]) == (7, 4)
    lists = [spark.createDataFrame([(1, x, i) for i, x in enumerate(xs, 1)], "query_id int, doc_id string, rank int") for xs in (["shop.py::checkout", "web.py::route"], ["bank.py::send"])]
    assert {r["doc_id"].split("::")[1]: r["n"] for r in graph.bridge_counts(spark, edges, *lists, depth=3).collect()} == {"checkout": 1, "charge": 1, "send": 1}


def test_paths_take_no_step_behind_the_last_hop(spark, monkeypatch):
    sizes, keep = [], graph.persisted
    monkeypatch.setattr(graph, "persisted", lambda s, df, name: sizes.append((name, (out := keep(s, df, name)).count())) or out)
    stars = [(f"{hub}{i}", hub) for hub in "xy" for i in range(300)] + [("x0", "z"), ("y0", "z")]
    edges = spark.createDataFrame(stars, "src string, dst string")
    pairs = spark.createDataFrame([("x1", "x2"), ("x1", "y2"), ("x0", "y0"), ("x1", "y0")], "a string, b string")
    got = {(r["a"], r["b"]): r["path"] for r in graph.shortest_paths(spark, edges, pairs, 3).collect()}
    assert got == {("x1", "x2"): ["x1", "x", "x2"], ("x0", "y0"): ["x0", "z", "y0"]}
    assert max(n for name, n in sizes if name == "frontier") < 20  # the stars' rays stay out


@pytest.mark.parametrize("ordered", [10_000, 3])
def test_hubs(spark, monkeypatch, ordered):
    monkeypatch.setattr(graph, "ORDERED", ordered)
    r = random.Random(4)
    values = [round(r.random() ** 3, 3) if i % 3 else 0.5 for i in range(400)]
    scores = spark.createDataFrame(list(enumerate(values)), "node int, score double")
    for share in (0.0, 0.2, 0.5, 1.0):
        cut = sorted(values, reverse=True)[min(399, int(400 * share))]
        assert {x["node"] for x in graph.hubs(scores, share).collect()} == {i for i, v in enumerate(values) if v >= cut}
    assert graph.hubs(scores.limit(0)).count() == 0


def test_pagerank_sums_to_one_and_converges(spark, edges):
    import numpy as np

    nodes, e = graph.build([], [edges])
    got = {r["node"]: r["score"] for r in graph.pagerank(spark, nodes, e, tol=1e-10).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9
    names = sorted(got)
    m = np.zeros((len(names),) * 2)
    for s, d, _ in EDGES:
        m[names.index(d), names.index(s)] = 1
    out = m.sum(axis=0)
    m = np.where(out > 0, m / np.maximum(out, 1), 1 / len(names))
    v = np.full(len(names), 1 / len(names))
    for _ in range(200):
        v = 0.15 / len(names) + 0.85 * m @ v
    assert max(abs(got[n] - v[i]) for i, n in enumerate(names)) < 1e-8


def test_budget(spark):
    z = assemble.allocation(F.col("a"), F.col("b"), F.lit(10))
    assert [one(spark, assemble.allocation(F.col("a"), F.col("b"), F.lit(10), n), a=100, b=1500)["mode"] for n in (128_000, 4000, 2000, 1000)] == ["FULL", "COMPACT", "MINIMAL", "NONE"]
    assert one(spark, z, a=100, b=100)["zone3"] == 31_790


def test_sessions(spark):
    log = spark.createDataFrame([(1, i, i in (3, 6)) for i in range(8)], "user_id long, event_id long, is_search boolean")
    out = sessions.gate(log, "user_id", "event_id", F.col("is_search"), ~F.col("is_search"))
    assert [r["denied"] for r in out.orderBy("event_id").collect()] == [True, True, True, False, False, False, False, False]
    ranges = spark.createDataFrame([(1, 1, 10, 20), (2, 1, 11, 20), (3, 1, 15, 40)], "id int, g int, a int, z int")
    assert {r["id"] for r in sessions.range_dedup(ranges, ["g"], "a", "z", "id").collect()} == {1, 3}


def test_confidence_and_statistics(spark):
    c = resolve.confidence(F.lit("entity"), F.lit(1.0), F.lit(1), F.lit(3), F.lit(1))
    assert one(spark, c)["level"] == "HIGH" and one(spark, resolve.confidence(F.lit("none"), F.lit(0.0), F.lit(0), F.lit(0), F.lit(0)))["level"] == "MISS"
    assert one(spark, evaluate.mcnemar(F.col("b"), F.col("c")), b=10, c=2) == pytest.approx(0.038574, abs=1e-6)
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, doc_id string, rank int")
    g = spark.createDataFrame([(1, "b"), (1, "z")], "query_id int, doc_id string")
    m = evaluate.ranking_metrics(r, g).first()
    assert (m["recall"], m["mrr"]) == (0.5, 0.5) and m["ndcg"] == pytest.approx(0.386853, abs=1e-6)


SOURCES = {
    "auth/core.py": '"""Core."""\nfrom auth.errors import TokenError\n\nLIMIT = 3\n\n\ndef decode(token: str) -> dict:\n    """Decode a token into its claims now."""\n    if not token:\n        raise TokenError("bad")\n    return {}\n\n\nclass Guard(Base):\n    def __init__(self, app):\n        self.app = app\n\n    def check(self, token):\n        return self.helper(decode(token))\n\n    def helper(self, x):\n        return x\n',
    "auth/errors.py": "class Base:\n    pass\n\n\nclass TokenError(Exception):\n    pass\n",
    "tests/test_core.py": "from auth.core import decode, Guard as G\n\n\ndef test_decode():\n    assert decode('x') == {}\n    G(None).check('x')\n",
    "web/app.ts": "import { x } from './lib';\nexport class App extends Root {\n  run(a: string) {\n    this.go(a);\n    return helper(a);\n  }\n  go(b: string) { return b; }\n}\nexport function helper(a: string) { return a; }\n",
    "bad.py": "def broken(:\n",
}


def write(root, tree):
    for path, text in tree.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def flat(df):
    return sorted(map(str, df.collect()))


def test_index_of_a_tree(spark, tmp_path):
    write(tmp_path, SOURCES | {"node_modules/x.js": "function no() {}", "notes.txt": "no"})
    index = Index.build(spark, str(tmp_path))
    names = {r["fqn"] for r in index.symbols.collect()}
    assert {"auth/core.py::decode", "auth/core.py::Guard.check", "auth/core.py::LIMIT", "web/app.ts::App.run", "web/app.ts::helper"} <= names
    assert not any("node_modules" in n or "notes" in n for n in names)
    assert index.parsed.where("row = 'corrupt'").select("path").collect()[0]["path"] == "bad.py"
    e = {(r["src"], r["dst"], r["etype"]): r["conf"] for r in index.edges.collect()}
    assert e["tests/test_core.py::test_decode", "auth/core.py::decode", "calls"] == 1.0
    assert e["tests/test_core.py::test_decode", "auth/core.py::Guard", "constructs"] == 1.0
    assert e["auth/core.py::Guard.check", "auth/core.py::Guard.helper", "calls"] == 0.95
    assert e["auth/core.py::decode", "auth/errors.py::TokenError", "raises"] == 1.0
    assert e["auth/core.py::Guard", "auth/errors.py::Base", "inherits"] == 0.9
    assert ("tests/test_core.py::test_decode", "auth/core.py::decode", "tests") in e
    assert e["web/app.ts::App.run", "web/app.ts::helper", "calls"] == 1.0 and ("web/app.ts::App.run", "web/app.ts::App.go", "calls") in e


def test_engine_over_a_tree_that_changes(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    write(root, SOURCES)
    index = Index.build(spark, str(root))
    engine = Engine(spark, index)
    q = spark.createDataFrame([(1, "where is the token decoded"), (2, "what calls Guard.check in auth/core.py"), (3, "zebra")], "query_id int, text string")
    hits = engine.search(q, 3).where("rank = 1").collect()
    assert {r["query_id"]: r["doc_id"] for r in hits}[1] == "auth/core.py::decode" and all(r["query_id"] != 3 for r in hits)
    targets = engine.resolve(q, 20).collect()
    assert {"auth/core.py::Guard.check"} <= {r["fqn"] for r in targets if r["query_id"] == 2 and r["tier"] == 1}
    one_hit = spark.createDataFrame([(2, "auth/core.py::decode", 1, 1.0)], "query_id int, fqn string, rank int, score double")
    grown = {r["fqn"]: (r["tier"], r["dist"], r["reason"]) for r in resolve.resolve(spark, spark.createDataFrame([(2, "what calls Guard.check")], "query_id int, text string"), one_hit, index.symbols, index.edges).collect()}
    assert grown["auth/core.py::Guard.check"] == (1, 0, "target") and grown["tests/test_core.py::test_decode"] == (2, 1, "reverse")
    assert any(r["fqn"] == "auth/core.py::Guard.__init__" for r in targets)
    assert [r["rank"] for r in engine.fuse(q, 3).where("query_id = 1").orderBy("rank").collect()] == [1, 2, 3]
    asked = spark.createDataFrame([("auth/core.py::decode",), ("Guard.check",), ("helper",), ("nothing",)], "asked string")
    assert {r["asked"]: r["fqn"] for r in engine.get(asked).collect()} == {"auth/core.py::decode": "auth/core.py::decode", "Guard.check": "auth/core.py::Guard.check", "helper": "web/app.ts::helper"}
    ranges = spark.createDataFrame([("auth/errors.py", 1, 2), ("auth/errors.py", None, None)], "path string, first int, last int")
    assert {r["last"]: r["body"] for r in engine.expand(ranges).collect()} == {2: "class Base:\n    pass", 7: SOURCES["auth/errors.py"]}
    assert {"auth": ["decode", "Guard", "Guard.__init__"]}["auth"] == [r["symbols"] for r in engine.outline(4).where("file = 'auth/core.py'").collect()][0][1:]
    assert engine.overview(3).count() == 3
    folder = str(tmp_path / "saved")
    index.save(spark, folder)
    write(root, {"auth/core.py": SOURCES["auth/core.py"].replace("helper", "assist"), "new.py": "from auth.core import decode\n\n\ndef fresh():\n    return decode('x')\n"})
    (root / "web" / "app.ts").unlink()
    now = files.read_sources(spark, str(root))
    updated, whole = Index.load(spark, folder).update(spark, now), Index.of_sources(spark, now)
    for table in ("parsed", "symbols", "edges"):
        assert flat(getattr(updated, table)) == flat(getattr(whole, table)), table
    assert updated.edges.where("src = 'new.py::fresh' AND dst = 'auth/core.py::decode'").count() == 1
    assert Index.load(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("language, text, names", [
    ("go", "package a\n\ntype S struct {\n}\n\nfunc (s *S) Run(x int) error {\n\treturn other(x)\n}\n\nfunc other(x int) error { return nil }\n", {"S", "S.Run", "other"}),
    ("java", "public class A extends B {\n    public A() {\n    }\n    int go(int x) {\n        return help(x);\n    }\n}\n", {"A", "A.A", "A.go"}),
    ("rust", "pub struct P { x: i32 }\nimpl P {\n    pub fn new() -> P { P { x: 1 } }\n}\nfn free() {}\n", {"P", "P.new", "free"}),
    ("cpp", "#define MAX 3\nnamespace n {\nclass C {\n};\n}\nint add(int a, int b) {\n  return a + b;\n}\n", {"MAX", "n", "n.C", "add"}),
    ("csharp", "namespace N {\n  public class C {\n    public int M(int x) { return x; }\n  }\n}\n", {"N", "N.C", "N.C.M"}),
    ("php", "<?php\nclass A extends B {\n  public function run($x) { return go($x); }\n}\n", {"A", "A.run"}),
    ("ruby", "module M\n  class A < B\n    def run(x)\n      go(x)\n    end\n  end\nend\n", {"M", "M.A", "M.A.run"}),
])
def test_other_languages(language, text, names):
    rows = parse.parse_one("f", language, text)
    assert {r["fqn"].split("::")[1] for r in rows if r["row"] == "symbol"} >= names


def test_logs_settings_bloom(spark, tmp_path):
    path = str(tmp_path / "log")
    files.append_log(spark.createDataFrame([(1.0, "use bm25", "fast", ["a.py"], ["search"])], files.LOGS["decisions"]), path)
    (tmp_path / "log" / "bad.json").write_text('{"ts": 2.0, "summary": "x"\nnot json\n')
    log = files.read_log(spark, path, "decisions")
    assert [r["summary"] for r in files.decisions_on(log.where("topics is not null"), "SEARCH").collect()] == ["use bm25"]
    conf = tmp_path / "c.json"
    conf.write_text(json.dumps({"top_k": 7, "b": 0.5, "odd": 1}))
    assert files.Settings.load(str(conf), {"LODESEAM_B": "0.6"}) == files.Settings(top_k=7, b=0.6)
    items = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"))
    bloom = files.bloom_table(items, "k")
    assert files.maybe_in(items, "k", bloom).count() == 1000
    assert files.maybe_in(spark.range(5000, 7000).select(F.concat(F.lit("k"), "id").alias("k")), "k", bloom).count() < 40
    c = files.constraints(spark.createDataFrame([("src", "a <!-- constraint: team ok --> never block\n<!-- x -->")], "dir string, text string"))
    assert [(r["text"], r["provenance"], r["confirmed"]) for r in c.collect()] == [("never block", "team", True)]
    assert files.constraints_for(spark.createDataFrame([("src/a/b.py",), ("x.py",)], "path string"), c).count() == 1


def test_streams(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, r.randint(1, 3), r.random() < 0.3, f"2024-01-01 00:{i % 60:02d}:00", "ab"[i % 2], 1.0) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, is_search boolean, at string, event_type string, value double").withColumn("ts", F.to_timestamp("at")).drop("at")
    folder = str(tmp_path / "events")
    for k in range(3):
        events.where(f"event_id div 20 = {k}").coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    batch = jobs.windowed(events).collect()
    assert sorted(map(tuple, run(jobs.windowed(stream()), "w", "complete").collect())) == sorted(map(tuple, batch))
    got = {x["event_id"]: x["denied"] for x in run(jobs.gated(stream()), "g").collect()}
    expect = {x["event_id"]: x["denied"] for x in sessions.gate(events, "user_id", "event_id", F.col("is_search"), ~F.col("is_search")).collect()}
    assert got == expect


def test_catalogue_has_twins():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
    assert len(catalog.ORACLE) > 80
