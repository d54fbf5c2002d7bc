"""Each operator on odd rows (see conftest), against brute force, and on an empty table."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodeseam.llm import decontam, license_index, line_dedup, quality_lines, simhash_ball, source_mix, token_store, url_rules, wavelet

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def alnum(s):
    return re.findall(ALNUM, low(s or ""))


def got(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# ---- near duplicates

def brute_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_rows(spark, docs, rows, none):
    out = simhash_ball.near_duplicates(spark, docs)
    assert got(out, "doc_id", "fingerprint") == Counter((r[0], f"{brute_fingerprint(r[1]):016x}") for r in rows)
    names = {r["doc_id"]: r["component_id"] for r in out.collect()}
    assert names[5] == names[4] == 4 and names[2] == names[1] == names[3] == 1
    assert simhash_ball.near_duplicates(spark, none).count() == 0
    kept = [r["doc_id"] for r in simhash_ball.keep_one(spark, docs).collect()]
    assert len(kept) == len(set(kept)) == len(set(names.values())) and 4 in kept and 5 not in kept


def test_simhash_components_equal_brute_force(spark):
    r = random.Random(7)
    fps = [r.getrandbits(64) for _ in range(150)]
    for _ in range(250):  # chains and stars of up to four bits
        fps.append(r.choice(fps) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    found = {r["fp"]: r["component_id"] for r in simhash_ball.classes(spark, df).collect()}
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert all(found[signed[i]] == root(i) for i in range(len(fps)))


def test_labels_spread_along_chains(spark):
    r = random.Random(11)
    chains = [[3, 9, 7, 5, 8, 10, 1]]
    for k in range(1, 41):
        chains.append([1000 * k + i for i in r.sample(range(150), 150)])
    tree = [50_000 + i for i in r.sample(range(400), 400)]
    pairs = [p for c in chains for p in zip(c, c[1:])] + [(tree[i], tree[r.randrange(i)]) for i in range(1, 400)]
    expect = {v: min(c) for c in [*chains, tree] for v in c} | {-7: -7}
    vertices = spark.createDataFrame([(v,) for v in expect], "v long")
    found = simhash_ball.spread_labels(spark, vertices, spark.createDataFrame(pairs, "a long, b long"))
    assert {r["v"]: r["label"] for r in found.collect()} == expect


# ---- mixing

def test_mix_budgets_and_prefixes(spark, docs, rows, none):
    out = source_mix.mix(spark, docs, share=0.5, max_epochs=2)
    assert "items" in out.columns and "rest" in out.columns
    taken = out.collect()
    total = sum(len((r[1] or "").split()) for r in rows)
    assert sum(r["n_tokens"] for r in taken) <= 0.5 * total
    again = source_mix.mix(spark, docs.repartition(5), share=0.5, max_epochs=2)
    assert got(again, "doc_id", "epoch") == got(out, "doc_id", "epoch")
    assert source_mix.mix(spark, none).count() == 0
    whole = source_mix.mix(spark, docs, share=9.0, max_epochs=1)  # every leaf is full
    assert whole.count() == sum(1 for r in rows if r[3] is None or sum(len((x[1] or "").split()) for x in rows if x[2:4] == r[2:4]))


def test_deal_moves_shortages_to_siblings(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "y", "1", 1000), ("b", "x", "1", 1000), ("b", "x", "2", 20)], "domain string, lang string, source string, capacity long")
    from pyspark.sql import functions as F

    got_ = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in source_mix.leaf_budgets(leaves, [F.lit(1.0)] * 3, 400).collect()}
    assert got_ == {("a", "x", "1"): 10, ("a", "y", "1"): 190, ("b", "x", "1"): 180, ("b", "x", "2"): 20}


# ---- quality

def test_quality(docs, rows, none):
    out = quality_lines.line_quality(docs)
    expect = Counter()
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cov = {x for k in range(len(w) - 4) if wins[tuple(w[k : k + 5])] > 1 for x in range(k, k + 5)}
        ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expect[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(cov))] += 1
    assert got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == expect
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert not kept[1] and not kept[40] and kept[30] and kept[4]
    assert quality_lines.line_quality(none).count() == 0


# ---- decontamination

def brute_hits(text, items):
    win = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w and i is not None else 0):
            win[tuple(w[k : k + size])].add(str(i))
    w, hit, found = alnum(text), set(), set()
    for size in {len(x) for x in win}:
        for k in range(len(w) - size + 1):
            if x := win.get(tuple(w[k : k + size])):
                hit.update(range(k, k + size))
                found |= x
    return len(w), len(hit), sorted(found)


def test_automaton_equals_brute_force():
    r = random.Random(5)
    for _ in range(60):
        items = [(i, " ".join(r.choice("abc") for _ in range(r.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(5)]
        a = decontam.Automaton([(str(i), t.encode()) for i, t in items])
        text = " ".join(r.choice("abcd") if r.random() < 0.8 else r.choice(items)[1] for _ in range(60))
        spans, found = a.scan(alnum(text) and [w.encode() for w in alnum(text)])
        n, hit, expect = brute_hits(text, items)
        assert (sum(z - s for s, z in spans), sorted(found)) == (hit, expect)


@pytest.mark.parametrize("block", [10**6, 12])
def test_decontamination_rows(spark, docs, rows, none, block):
    passage = " ".join(rows[3][1].split()[10:40])
    items = [(1, passage), (2, "own line number"), (2, "own line number"), (3, None), (None, passage), (4, "--")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.scan_documents(spark, docs, bench, block_words=block)
    assert Counter((r["doc_id"], r["n_words"], sum(s["past"] - s["first"] for s in r["spans"]), tuple(r["items"])) for r in out.collect()) == Counter((r[0], *(lambda b: (b[0], b[1], tuple(b[2])))(brute_hits(r[1], items))) for r in rows)
    assert decontam.scan_documents(spark, none, bench).count() == 0
    assert {tuple(r["spans"]) for r in decontam.scan_documents(spark, docs, bench.limit(0)).collect()} == {()}
    clean = {r["doc_id"]: r for r in decontam.clean_documents(spark, docs, bench).collect()}
    assert passage not in clean[4]["text"] and clean[4]["n_chars"] == len(clean[4]["text"]) and clean[1]["text"] is None


# ---- urls

def test_urls(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "a.org", "/x"), ("allow", "a.org", "/x/y"), (None, "b", "/")]
    urls = ["http://www.Example.net/en/1?q#f", "https://example.net", "ftp://x.net/", "http://a.org/xy", "http://z.a.org/x/yz", "http://ba.org/x", "no scheme.net/", None, "http://a.org/x", "http://a.org/x", "://net/p"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(None, None, None)], "page_id long, url string, rule string")
    out = url_rules.filter_urls(spark, pages, url_rules.rules_frame(spark, rules))
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in out.collect() if r["page_id"] is not None} == {0: ("example.net/en/", "allow"), 1: (None, "allow"), 2: ("net/", "block"), 3: ("a.org/x", "block"), 4: ("a.org/x/y", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: ("a.org/x", "block"), 9: ("a.org/x", "block"), 10: ("net/", "block")}
    assert out.count() == 12
    assert {r["verdict"] for r in url_rules.filter_urls(spark, pages, url_rules.rules_frame(spark, rules).limit(0)).collect()} == {"allow"}
    assert url_rules.filter_urls(spark, pages.limit(0), url_rules.rules_frame(spark, rules)).count() == 0


# ---- licences

def test_licences(docs, rows, none):
    out = license_index.scan_licenses(docs)
    expect = Counter()
    for r in rows:
        w, at, labels = alnum(r[1]), [], set()
        for phrase, label in license_index.BASE_PHRASES:
            p = phrase.split()
            for k in range(len(w)):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    labels.add(label)
        expect[(r[0], len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))] += 1
    assert got(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == expect
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in out.collect()}
    assert labels[32] == ("apache-2.0", 1.0) and labels[33] == ("cc-by,reserved", 1.0) and labels[4] == ("", 0.0)
    assert license_index.scan_licenses(none).count() == 0


# ---- tokens

def test_wavelet_round_trip():
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1000, 3), (300_000, 49_000), (5000, 200_000)):
        ids = r.integers(0, top, n).astype(np.uint32)
        f = wavelet.WaveletFile(wavelet.build(ids, np.array([7]), np.array([False]), np.array([n])))
        assert (f.decode() == ids).all()
        for i in r.integers(0, max(n, 1), 20 * bool(n)).tolist():
            assert f.access(i) == ids[i]
            a, z = sorted((i, n // 2))
            assert f.count(int(ids[i]), a, z) == int((ids[a:z] == ids[i]).sum())
        if n:
            t = int(ids[0])
            some = np.flatnonzero(ids == t)[:50]
            assert f.occurrences(t, 0, int(some[-1]) + 1) == some.tolist()
        assert f.count(1 << 20) == 0


@pytest.mark.parametrize("size", [1 << 22, 40])
def test_tokens_rows(spark, docs, rows, none, size):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.tokenizer_path())
    out = token_store.read_documents(spark, token_store.write_store(spark, docs, shard_tokens=size))
    at, expect = 0, Counter()
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is not None, x[0], x[1] is not None, x[1])):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        expect[(i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        at += len(ids)
    assert got(out, "doc_id", "start", "n_tokens", "ids_crc32") == expect
    assert token_store.read_documents(spark, token_store.write_store(spark, none)).count() == 0


def test_encoder_equals_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.tokenizer_path())
    texts = ["It's a test, isn't it?", "<|endoftext|> x <|ENDOFTEXT|>", "ÀÉ́ é.x A.b,c", " x y\u0085z", "a1b2 3,4.5", "don't!!! ...,. x.'s", "İK ſ ß", "", None, "日本語、テスト。", "x" * 500, "🙂🙂 ok"]
    with open(token_store.tokenizer_path(), encoding="utf-8") as f:
        e = token_store.Encoder(f.read())
    for _ in range(2):
        ids, sizes = e.encode(pa.array(texts))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [p.tolist() for p in parts] == [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


# ---- lines

@pytest.mark.parametrize("shard", [1 << 18, 1])
def test_lines_rows(spark, docs, rows, none, shard):
    key = lambda x: (lambda k: k if len(k) >= 40 else None)(low(x.strip(" \t\n\x0b\x0c\r")))
    held = defaultdict(list)
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")} - {None}:
            held[k].append(r[0] if r[0] is not None else -(1 << 63))
    expect = Counter()
    for r in rows:
        ls = (r[1] or "").split("\n")
        keep = [x for x in ls if not (key(x) and len(held[key(x)]) >= 5 and max(held[key(x)]) != r[0])]
        expect[(r[0], len(ls), len(ls) - len(keep), "\n".join(keep))] += 1
    out = line_dedup.drop_repeated_lines(spark, docs, shard_keys=shard)
    assert got(out, "doc_id", "n_lines", "n_dropped", "clean_text") == expect
    assert line_dedup.drop_repeated_lines(spark, none).count() == 0


def test_minimal_perfect_hash():
    r = np.random.default_rng(2)
    h = r.integers(0, 1 << 63, 5000).astype(np.uint64)
    h[10] = h[11] = h[12]  # equal hashes, told apart by their fingerprints
    fp = r.integers(0, 1 << 63, 5000).astype(np.uint64)
    s = line_dedup.Shard(line_dedup.build_shard(h, fp, np.arange(5000) + 5, np.arange(5000)))
    slots = s.find(h, fp)
    assert sorted(slots.tolist()) == list(range(5000)) and (s.top[slots] == np.arange(5000)).all() and (s.count[slots] == np.arange(5000) + 5).all()
    assert (s.find(h, fp ^ np.uint64(1)) == -1).all() and (s.find(r.integers(0, 1 << 63, 999).astype(np.uint64), fp[:999]) == -1).all()


def test_a_lost_shard_is_an_error(spark, docs, tmp_path, monkeypatch):
    import glob
    import os

    monkeypatch.setattr(line_dedup, "scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    out = line_dedup.drop_repeated_lines(spark, docs, shard_keys=1)
    files = glob.glob(f"{tmp_path}/line-index/*.mph")
    assert files and out.count() == docs.count()
    for f in files:
        os.remove(f)
    with pytest.raises(Exception, match="mph"):
        line_dedup.drop_repeated_lines.__globals__["_open"].clear()
        out.agg({"n_dropped": "sum"}).collect()


def test_crowded_rests_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash_ball, "CROWD", 2)
    monkeypatch.setattr(simhash_ball, "BROADCAST_KEYS", 0)  # and past what may be broadcast
    r = random.Random(12)
    base = r.getrandbits(64)
    fps = {base ^ (r.getrandbits(21) << at) for at in (0, 21, 42) for _ in range(60)} | {base ^ sum(1 << b for b in r.sample(range(64), 3)) for _ in range(60)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = {x["fp"]: x["component_id"] for x in simhash_ball.classes(spark, spark.createDataFrame(list(enumerate(signed)), "id long, fp long")).collect()}
    label = list(range(len(fps)))
    for _ in fps:
        now = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
        if now == label:
            break
        label = now
    assert [found[x] for x in signed] == label


def test_notices_of_every_template(spark):
    notices = [(i, f"Some words before. {text.title()}! And after", label) for i, (label, text, _) in enumerate(license_index.TEMPLATES)]
    out = {x["doc_id"]: x for x in license_index.scan_licenses(spark.createDataFrame(notices, "doc_id int, text string, label string")).collect()}
    for i, _, label in notices:
        assert label in out[i]["labels"].split(",") and out[i]["score"] == 1.0, label
    # A key phrase out of its order, or with a word missing, is no candidate.
    for text in ("license mit", "apache version license 2", "redistribution and use in source and forms", "mozilla public license v 2 1"):
        row = license_index.scan_licenses(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
        assert (row["labels"], row["score"]) == ("", 0.0), text
