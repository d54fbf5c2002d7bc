"""The index and the whole query against brute force, and odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodeseam.llm import toxicity_knn
from lodeseam.llm.queries import op1_toxicity

NAMES = ["vile", "scum", "dolt", "brute"]


@pytest.mark.parametrize(("terms", "table"), [(30, 0), (30, 10), (400, 0), (400, 1000)])
def test_block_max_is_exact(terms, table):
    r = np.random.default_rng(3)
    vectors = []
    for _ in range(900):
        t = np.sort(r.choice(terms, r.integers(0, 6), replace=False))
        w = r.integers(1, 4, len(t)).astype(float)  # many ties
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    index = toxicity_knn.BlockMaxIndex(vectors, terms, 32, table)
    dense = np.zeros((900, terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for (t, w), (near, _) in zip(vectors[:300], index.nearest(vectors[:300], 10), strict=True):
        q = np.zeros(terms)
        q[t] = w
        cos = np.round(dense @ q, 12)
        best = [i for i in np.lexsort((np.arange(900), -cos))[:10] if cos[i] > 0]
        assert near.tolist() == best
    assert index.scored < 300 * index.blocks  # bounds leave blocks out


def brute(docs, labels):
    """Scores and evidence of all documents by plain dictionaries; every row of the labels is an example."""
    words = {i: Counter(toxicity_knn.words_of(t)) for i, t in docs}
    ids = sorted(i for i in labels if i in words)
    examples = {i: words[i] for i in ids}
    n1 = sum(labels[i] for i in ids)
    n0, n = len(ids) - n1, len(ids)
    factor = {}
    for t in {t for c in examples.values() for t in c}:
        p, q = sum(t in examples[i] for i in ids if labels[i]), sum(t in examples[i] for i in ids if not labels[i])
        df = sum(t in words[i] for i, _ in docs)
        llr = 2 * sum(x * math.log(x * n / (size * total)) for x, size, total in ((p, n1, p + q), (q, n0, p + q), (n1 - p, n1, n - p - q), (n0 - q, n0, n - p - q)) if x)
        factor[t] = (math.log((1 + len(docs)) / (1 + df)) + 1) * (1 + (max(0, llr) if (p + 0.5) / (n1 + 1) > (q + 0.5) / (n0 + 1) else 0))

    def vector(c):
        v = {t: (1 + math.log(k)) * factor[t] for t, k in c.items() if t in factor}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    known = {i: vector(c) for i, c in examples.items()}
    base = sum(labels.values()) / len(labels)
    votes_of = {1: sum(labels.values()) / n1, 0: (len(labels) - sum(labels.values())) / n0}

    def vote(i, c):
        v = vector(c)
        near = sorted(((-round(sum(x * known[e].get(t, 0) for t, x in v.items()), 12), e) for e in ids if e != i))
        near = [(-s, e) for s, e in near if s < 0][: toxicity_knn.NEAREST]
        if not near:
            return None, []
        prior = toxicity_knn.PRIOR * sum(votes_of[labels[e]] for _, e in near) / len(near)
        w = [(s * votes_of[labels[e]], labels[e]) for s, e in near]
        return (sum(a * y for a, y in w) + prior * base) / (sum(a for a, _ in w) + prior), near

    judged = sorted((v, votes_of[labels[i]], labels[i]) for i in ids if (v := vote(i, examples[i])[0]) is not None)
    groups = [[w, w * y, [v]] for v, w, y in judged]
    at = 0
    while at + 1 < len(groups):
        a, b = groups[at], groups[at + 1]
        if a[1] / a[0] >= b[1] / b[0] or a[2][-1] == b[2][0]:
            groups[at : at + 2] = [[a[0] + b[0], a[1] + b[1], a[2] + b[2]]]
            at = max(0, at - 1)
        else:
            at += 1
    xs, ys = [x for g in groups for x in (g[2][0], g[2][-1])], [g[1] / g[0] for g in groups for _ in range(2)]
    alone = [(votes_of[labels[i]], labels[i]) for i in ids if vote(i, examples[i])[0] is None]
    no_vote = (sum(w * y for w, y in alone) + base) / (sum(w for w, _ in alone) + 1)
    out = {}
    for i, _ in docs:
        v, near = vote(i, words[i])
        out[i] = (no_vote if v is None else float(np.interp(v, xs, ys)), [e for _, e in near[:3]], [round(s, 6) for s, _ in near[:3]])
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    plain = ["river", "stone", "Ämter", "cloud", "lamp", "été", "path", "corn", "mill", "sand", "crow", "bell"]
    docs = []
    for i in range(160):
        words = [r.choice(plain) for _ in range(r.randint(3, 40))]
        toxic = i % 4 == 0
        words += [r.choice(NAMES) for _ in range(r.randint(1, 3))] if toxic else []
        r.shuffle(words)
        docs.append((i, " ".join(words), int(toxic) if r.random() < 0.95 else int(not toxic)))
    docs += [(200, docs[4][1], 1), (201, docs[4][1], 1), (300, "", 0), (301, None, 0), (302, "nothing known", 0), (303, "river " * 20_000 + "scum", 1)]
    return docs


def test_query_equals_brute_force(spark, corpus, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, _, y in corpus if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in corpus}
    expect = brute([(i, t) for i, t, _ in corpus], {i: y for i, _, y in corpus if i % 5 and not held[i]})
    found = {r["doc_id"]: r for r in op1_toxicity(spark, d).collect()}
    assert found.keys() == expect.keys()
    for i, (score, near, cosines) in expect.items():
        r = found[i]
        assert r["held_out"] == held[i] and r["predicted"] == int(r["score"] >= 0.3)
        assert abs(r["score"] - score) < 1e-9, i
        assert [int(x) for x in r["nearest"].split(",") if x] == near, i
        assert np.allclose([float(x) for x in r["cosines"].split(",") if x], cosines, atol=2e-6)
    right = [found[i]["predicted"] == (i % 4 == 0) for i in range(160) if held[i]]
    assert sum(right) >= 0.9 * len(right)


def test_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(50 + i, int(i % 3 == 0)) for i in range(30)] + [(51, None), (None, 1), (4, None), (53, 0), (999, 1)], "doc_id long, toxic int")
    out = toxicity_knn.train_and_score(spark, docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    score = {r["doc_id"]: r["score"] for r in out}
    assert all((score[50 + i] >= 0.3) == (i % 3 == 0) for i in range(30, 40))  # 53 keeps its greatest label
    assert score[1] == score[2] == score[3] and score[4] == score[5]
    assert toxicity_knn.train_and_score(spark, none, labels).count() == 0
    assert {r["score"] for r in toxicity_knn.train_and_score(spark, docs, labels.limit(0)).collect()} == {0.0}


def test_ids_of_any_type_and_words_of_no_class(spark):
    docs = spark.createDataFrame([(f"k{i}", f"meadow lantern w{i % 4} " + ("vile scum" if i % 4 == 0 else "calm river")) for i in range(40)] + [("a", "lantern"), ("b", "river"), ("c", ""), (None, "scum")], "name string, body string")
    labels = spark.createDataFrame([(f"k{i}", int(i % 4 == 0)) for i in range(40)], "name string, bad int")
    out = {r["name"]: r for r in toxicity_knn.train_and_score(spark, docs, labels, id_col="name", text_col="body", label_col="bad").collect()}
    assert out["a"]["evidence"] and out["b"]["evidence"] and not out["c"]["evidence"] and out[None]["score"] >= 0.3
    assert out["b"]["score"] < 0.3 and all((out[f"k{i}"]["score"] >= 0.3) == (i % 4 == 0) for i in range(40))
    assert all(f"k{i}" not in out[f"k{i}"]["evidence"] for i in range(40))
    assert toxicity_knn.train_and_score(spark, docs, labels, id_col="name", text_col="body", label_col="bad", max_examples=3).count() == 44
