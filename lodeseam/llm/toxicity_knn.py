"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The labelled examples are a bounded sample of the training rows (``max_examples`` of each class, the least hashes of
their ids); their words, all of them, are the terms.  A text's vector holds for each of its terms (1 + ln tf) times the
term's IDF, counted over all documents, times the term's class weight: 1, and for terms that lean to label 1 in the
sample one more than the log-likelihood ratio of term and label.  Vectors have unit length over the terms; words that no
example has would add nothing to any dot product.

Examples stand in blocks of ``BLOCK``, like ones together.  The index holds the postings by term and block, and for each
(term, block) the greatest weight.  A text's dot product with these bounds every block; the blocks of the highest bounds
are scored first, then in one more pass all blocks whose bound reaches the k-th best score so far.  The k nearest
are exact (ties: the lesser example number, by id; cosines that agree to 12 digits are equal).

Votes are weighted by cosine, and by class so that the sample stands for all training rows.  A row that is itself an
example is judged by the others.  A vote's calibrated score is the toxic share among the examples with a like vote, each
judged by the others, made monotone by pooling adjacent violators.  A text that shares no term with the examples gets
the toxic share among the examples that share none with the others, and one row of the base rate.  The nearest examples
and their cosines are the evidence.

Defined results: a null or empty text has no terms; rows without a label are scored all the same; an id that ``labels``
repeats takes its greatest label, one that ``docs`` repeats stands in the sample with its least text, null labels and ids
count as none; without training rows every score is 0; repeated rows are scored alike; ids may be of any type; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.llm.bytes_text import alnum_words
from lodeseam.session import persisted, ship_package, small_batches

#: Bounds: rows of each class in the sample; votes that a worker remembers for copies of a text.
MAX_EXAMPLES, HELD_VOTES = 2048, 20_000
NEAREST, BLOCK, EVIDENCE = 15, 64, 3
#: At most so many terms, each in more than one of so many examples, stand in the index's table; queries of one product.
TABLE_TERMS, TABLE_SHARE, QUERIES = 1024, 20, 256
#: The base rate weighs as much as this share of one example, so that few, far neighbours don't decide all.
PRIOR = 0.05


def words_of(text: str | None) -> list[bytes]:
    return alnum_words((text or "").lower().encode("utf-8", "replace"))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i], ..., starts[i] + sizes[i] - 1 of every i, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class BlockMaxIndex:
    """Unit vectors of non-negative weights in blocks; postings by (term, block), with the greatest weight of each.

    The most frequent terms, whose postings hold most examples of nearly every block, stand in a table instead: their
    part of all dot products is one matrix product for many queries, and its maximum in a block is part of the bound.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK, table_terms: int = TABLE_TERMS) -> None:
        lead = [(int(t[np.argmax(w)]) if len(t) else n_terms, i) for i, (t, w) in enumerate(vectors)]
        self.order = np.array([i for _, i in sorted(lead)], np.int64)  # example number at each place
        self.n, self.blocks, self.block = len(vectors), -(-len(vectors) // block), block
        rows = [vectors[i] for i in self.order.tolist()]
        place = np.repeat(np.arange(self.n), [len(t) for t, _ in rows])
        terms = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in rows]])
        weights = np.concatenate([np.zeros(0), *[w for _, w in rows]])
        df = np.bincount(terms, minlength=n_terms)
        often = np.argsort(-df, kind="stable")[:table_terms]
        often = np.sort(often[df[often] * TABLE_SHARE > self.n])
        self.column = np.full(n_terms, -1, np.int64)
        self.column[often] = np.arange(len(often))
        here = self.column[terms] >= 0
        self.table = np.zeros((len(often), self.n))
        self.table[self.column[terms[here]], place[here]] = weights[here]
        place, terms, weights = place[~here], terms[~here], weights[~here]
        by_term = np.lexsort((place, terms))
        self.place, self.weights = place[by_term], weights[by_term]
        pair = terms[by_term] * self.blocks + self.place // block
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        self.pair_starts = np.append(first, len(pair))
        self.pair_block = pair[first] % max(1, self.blocks)
        self.peaks = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.term_starts = np.searchsorted(pair[first] // max(1, self.blocks), np.arange(n_terms + 1))
        self.scored = 0  # blocks whose postings were read, for tests and tuning

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the numbers and cosines of its k nearest with a cosine over 0, by falling cosine, then number."""
        out = []
        for at in range(0, len(queries), QUERIES if self.n else len(queries) or 1):
            some = queries[at : at + QUERIES]
            if not self.n:
                return [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
            dense = np.zeros((len(some), len(self.table)))
            for q, (terms, weights) in zip(dense, some, strict=True):
                columns = self.column[terms]
                q[columns[columns >= 0]] = weights[columns >= 0]
            parts = dense @ self.table
            tops = np.maximum.reduceat(parts, np.arange(0, self.n, self.block), axis=1)
            for part, top, (terms, weights) in zip(parts, tops, some, strict=True):
                rare = self.column[terms] < 0
                out.append(self._nearest(part, top, terms[rare], weights[rare], k))
        return out

    def _nearest(self, part: np.ndarray, top: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.term_starts[terms + 1] - self.term_starts[terms]
        pairs, w = _ranges(self.term_starts[terms], sizes), np.repeat(weights, sizes)
        at = self.pair_block[pairs]
        bound = top + np.bincount(at, w * self.peaks[pairs], self.blocks)
        score, least, lead = np.zeros(self.n), 0.0, min(self.blocks, -(-2 * k // self.block))
        take = np.zeros(self.blocks, bool)
        take[np.argpartition(-bound, lead - 1)[:lead]] = True
        self._score(score, part, pairs, w, at, take)
        if (score > 0).sum() >= k:
            least = np.partition(score, self.n - k)[self.n - k]
        rest = ~take & (bound > 0) & (bound >= least - 1e-9)
        if rest.any():
            self._score(score, part, pairs, w, at, rest)
        self.scored += int(take.sum() + rest.sum())
        hit = np.flatnonzero((score > 0) & (score >= least - 1e-9))
        keep = np.lexsort((self.order[hit], -np.round(score[hit], 12)))[:k]
        return self.order[hit[keep]], score[hit[keep]]

    def _score(self, score: np.ndarray, part: np.ndarray, pairs: np.ndarray, w: np.ndarray, at: np.ndarray, blocks: np.ndarray) -> None:
        """Sets the whole dot products of the examples of ``blocks``."""
        chosen = blocks[at]
        pairs = pairs[chosen]
        sizes = self.pair_starts[pairs + 1] - self.pair_starts[pairs]
        found = _ranges(self.pair_starts[pairs], sizes)
        score += np.bincount(self.place[found], np.repeat(w[chosen], sizes) * self.weights[found], self.n)
        inside = np.repeat(blocks, self.block)[: self.n]
        score[inside] += part[inside]


class Judge:
    """The fitted examples, as they are sent to the workers; bounded as the sample is."""

    def __init__(self, terms: list[str], factor: np.ndarray, ids: list, vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], totals: tuple[int, int], nearest: int = NEAREST) -> None:
        self.terms, self.factor, self.ids, self.k = terms, factor, ids, nearest
        self.vectors = [(t, self.weigh(t, c)) for t, c in vectors]
        self.labels = np.array(labels, np.int64)
        taken = Counter(labels)
        self.votes = np.array([totals[y] / taken[y] for y in labels])
        self.base = totals[1] / sum(totals) if sum(totals) else 0.0
        self.index = BlockMaxIndex(self.vectors, len(terms))
        self.number = self.example = self.seen = None  # made where they are used

    def weigh(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.factor[terms]
        return w / math.sqrt(float((w * w).sum())) if len(w) else w

    def votes_on(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int]) -> list[tuple[float | None, np.ndarray, np.ndarray]]:
        """For each query the toxic share of its neighbours' votes (None without neighbours), the neighbours and their
        cosines; example ``without`` is none of them."""
        out = []
        for own, (near, cos) in zip(without, self.index.nearest(queries, self.k + 1), strict=True):
            cos, near = cos[near != own][: self.k], near[near != own][: self.k]
            w = cos * self.votes[near]
            prior = float(np.mean(self.votes[near])) * PRIOR if len(near) else 0.0
            out.append((float(((w * self.labels[near]).sum() + prior * self.base) / (w.sum() + prior)) if len(near) else None, near, cos))
        return out

    def calibration(self, votes: list[float | None]) -> tuple[np.ndarray, np.ndarray, float]:
        """Votes and their scores, and the score without a vote, from the votes on all examples."""
        known = sorted((v, n) for n, v in enumerate(votes) if v is not None)
        stack: list[list[float]] = []  # weight, toxic weight, least vote, greatest vote
        for v, n in known:
            w = float(self.votes[n])
            stack.append([w, w * int(self.labels[n]), v, v])
            while len(stack) > 1 and (stack[-2][1] / stack[-2][0] >= stack[-1][1] / stack[-1][0] or stack[-2][3] == stack[-1][2]):
                w2, y2, _, hi = stack.pop()
                stack[-1] = [stack[-1][0] + w2, stack[-1][1] + y2, stack[-1][2], hi]
        alone = [n for n, v in enumerate(votes) if v is None]
        no_vote = (float((self.votes[alone] * self.labels[alone]).sum()) + self.base) / (float(self.votes[alone].sum()) + 1)
        return np.array([x for s in stack for x in (s[2], s[3])]), np.array([s[1] / s[0] for s in stack for _ in range(2)]), no_vote

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of a text's terms, ascending, and how often it has each."""
        if self.number is None:
            self.number = {t.encode("utf-8"): i for i, t in enumerate(self.terms)}
        find = self.number.get
        return np.unique(np.array([n for w in words_of(text) if (n := find(w)) is not None], np.int64), return_counts=True)

    def score(self, ids: list, texts: Iterable[str | None], steps: np.ndarray, values: np.ndarray, no_vote: float) -> list[tuple[float, list, list[float]]]:
        """Score, evidence and cosines of each row."""
        if self.example is None:
            self.example, self.seen = {x: n for n, x in enumerate(self.ids)}, {}
        keys, new = [], {}
        if len(self.seen) >= HELD_VOTES:
            self.seen.clear()
        for row, text in zip(ids, texts, strict=True):
            terms, counts = self.counts(text)
            key = (self.example.get(row, -1), hashlib.blake2b(terms.tobytes() + counts.tobytes(), digest_size=16).digest())
            keys.append(key)
            if key not in self.seen:
                new[key] = (terms, self.weigh(terms, counts))
        for key, (vote, near, cos) in zip(new, self.votes_on(list(new.values()), [own for own, _ in new]), strict=True):
            score = no_vote if vote is None or not len(steps) else float(np.interp(vote, steps, values))
            self.seen[key] = round(score, 12), [self.ids[n] for n in near[:EVIDENCE].tolist()], [round(float(c), 6) for c in cos[:EVIDENCE]]
        return [self.seen[key] for key in keys]


def training_rows(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """id and y of all rows that may be learnt from."""
    known = F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()
    return labels.where(known).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("y"))


def choose_examples(rows: DataFrame, max_examples: int) -> DataFrame:
    """Of each class the rows with the least hashes, ``max_examples`` at most."""
    order = [F.xxhash64("id"), F.col("id")]
    return rows.where("y = 1").orderBy(*order).limit(max_examples).unionByName(rows.where("y = 0").orderBy(*order).limit(max_examples))


def class_weights(vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], n_terms: int) -> np.ndarray:
    """1, and for terms that lean to label 1 one more than their log-likelihood ratio with it."""
    y = np.array(labels)
    n_pos, n_neg = int((y == 1).sum()), int((y == 0).sum())
    n = float(n_pos + n_neg)

    def docs_with(label: int) -> np.ndarray:
        return np.bincount(np.concatenate([np.zeros(0, np.int64), *[t for (t, _), x in zip(vectors, labels, strict=True) if x == label]]), minlength=n_terms).astype(float)

    pos, neg = docs_with(1), docs_with(0)
    df = pos + neg

    def part(seen: np.ndarray, size: int, total: np.ndarray) -> np.ndarray:
        return 2 * seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, total * size / max(n, 1), 1))

    llr = part(pos, n_pos, df) + part(neg, n_neg, df) + part(n_pos - pos, n_pos, n - df) + part(n_neg - neg, n_neg, n - df)
    return 1 + np.where((pos + 0.5) / (n_pos + 1) > (neg + 0.5) / (n_neg + 1), np.maximum(0, llr), 0)


def document_counts(spark: SparkSession, docs: DataFrame, terms: list[str]) -> tuple[int, np.ndarray]:
    """The number of documents, and of those that have each term; a task sends one row for each term it met."""
    sent = spark.sparkContext.broadcast(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t.encode("utf-8"): i for i, t in enumerate(sent.value)}
        df, n = np.zeros(len(number), np.int64), 0
        for batch in batches:
            found = [i for text in batch.column(0) for w in set(words_of(text.as_py())) if (i := number.get(w)) is not None]
            df += np.bincount(np.array(found, np.int64), minlength=len(df))
            n += batch.num_rows
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*met.tolist(), -1], pa.int32()), pa.array([*df[met].tolist(), n], pa.int64())], names=["t", "n"])

    found = docs.select("text").mapInArrow(work, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    t, n = found["t"].to_numpy(), found["n"].to_numpy()
    df = np.zeros(len(terms), np.int64)
    df[t[t >= 0]] = n[t >= 0]
    return int(n[t < 0].sum()), df


def fit(spark: SparkSession, slim: DataFrame, rows: DataFrame, max_examples: int, nearest: int = NEAREST) -> Judge:
    """The judge learnt from ``rows`` (id, y) and the texts of ``slim`` (id, text)."""
    rows = persisted(spark, rows, "toxic-rows")
    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    sample = choose_examples(rows, max_examples)  # at most 2 x max_examples ids
    texts = slim.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    found = sorted(texts.mapInArrow(_word_counts, T.StructType([*texts.schema.fields[:2], *T.StructType.fromDDL("words array<string>, counts array<int>").fields])).collect(), key=lambda r: r["id"])
    terms = sorted({w for r in found for w in r["words"]})
    number = {t: i for i, t in enumerate(terms)}
    vectors, labels = [], [r["y"] for r in found]
    for r in found:
        t, c = np.array([number[w] for w in r["words"]], np.int64), np.array(r["counts"], np.int64)
        by_term = np.argsort(t)
        vectors.append((t[by_term], c[by_term]))
    n, df = document_counts(spark, slim, terms)
    factor = (np.log((1 + n) / (1 + df)) + 1) * class_weights(vectors, labels, len(terms))
    return Judge(terms, factor, [r["id"] for r in found], vectors, labels, (totals.get(0, 0), totals.get(1, 0)), nearest)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Counter(w.decode("utf-8", "replace") for w in words_of(text.as_py())) for text in batch.column(2)]
        words, counts = pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, counts], names=["id", "y", "words", "counts"])


def train_and_score(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES, nearest: int = NEAREST) -> DataFrame:
    """id, score, evidence ids and evidence cosines of every row of ``docs``; all of ``labels`` may be learnt from."""
    ship_package(spark)
    small_batches(spark)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sent = spark.sparkContext.broadcast(fit(spark, slim, training_rows(labels, label_col, id_col), max_examples, nearest))
    scale = sent.value.calibration(_leave_one_out(spark, sent, len(sent.value.ids)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value
        for batch in batches:
            ids = batch.column(0)
            out = judge.score(ids.to_pylist(), (t.as_py() for t in batch.column(1)), *scale)
            yield pa.RecordBatch.from_arrays([ids, pa.array([s for s, _, _ in out], pa.float64()), pa.array([e for _, e, _ in out], pa.list_(ids.type)), pa.array([c for _, _, c in out], pa.list_(pa.float64()))], names=["id", "score", "evidence", "cosines"])

    id_type = slim.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(id_type)), T.StructField("cosines", T.ArrayType(T.DoubleType()))])
    return slim.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def _leave_one_out(spark: SparkSession, sent: object, n: int) -> list[float | None]:
    """The votes on all examples, each by the others; dealt out, since each takes as long as a document."""
    if not n:
        return []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_pylist()
            found = sent.value.votes_on([sent.value.vectors[i] for i in some], some)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v for v, _, _ in found], pa.float64())], names=["id", "vote"])

    parts = max(1, min(spark.sparkContext.defaultParallelism, n // 64))
    return spark.range(0, n, 1, parts).mapInArrow(work, "id long, vote double").toArrow().sort_by("id")["vote"].to_pylist()
