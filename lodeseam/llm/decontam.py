"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton holds every run of words of every item.  A training text is streamed through it word by word; the
state and the length of the longest suffix read so far that some item contains are kept.  A length of ``window``
or more hits that many words back; a state also knows the longest whole item shorter than a window that ends in
it.  Hit words form spans, which ``clean_documents`` cuts out; documents hit beyond ``max_coverage`` are dropped.

The benchmark is read in blocks of at most ``BLOCK_WORDS`` words (each at least one item), so that an automaton has
a bounded size; every block is streamed against all documents, and the hits are united.

Defined results: a null text has no words; an item without words or with a null id is passed over; items that
repeat an id count once; equal items each count; repeated rows are judged alike, each by itself; an empty
benchmark hits nothing; an empty table gives an empty result; other columns pass through, clashing ones are
replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.llm.bytes_text import ALNUM, alnum_words, encoded
from lodeseam.session import ship_package, small_batches

WINDOW = 10
#: An automaton of so many words takes some 130 MB of a worker.
BLOCK_WORDS = 150_000
MAX_COVERAGE = 0.5
#: Automata that a worker keeps; each block's pass runs in workers of its own.
HELD_AUTOMATA = 1
_automata: dict[str, Automaton] = {}


class Automaton:
    """Generalised suffix automaton of the items' word numbers, with what the scan needs in each state."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = []
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in alnum_words(text)]
            if ids:
                numbered.append((item, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        n = len(self.length)
        owners: list[set[str]] = [set() for _ in range(n)]  # items with a window in a state
        self.need = [0] * n  # how long a match in a state must be for the state's own windows
        whole = [0] * n
        for item, ids in numbered:
            if len(ids) < window:
                s = self._walk(ids)
                owners[s].add(item)
                whole[s] = self.need[s] = len(ids)
            else:
                for s, size in self._states(ids):
                    if size >= window:
                        while self.length[self.link[s]] >= window:
                            s = self.link[s]
                        owners[s].add(item)
                        self.need[s] = window
        self.short = [0] * n  # the longest whole item that ends in a state or one of its suffixes
        self.items: list[frozenset[str]] = [frozenset()] * n  # and all items with windows there
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            self.short[s] = max(whole[s], self.short[up])
            self.items[s] = self.items[up] | owners[s] if owners[s] else self.items[up]
        self.least = min([window, *(len(ids) for _, ids in numbered)]) if numbered else 0

    def _walk(self, ids: list[int]) -> int:
        s = 0
        for c in ids:
            s = self.next[s][c]
        return s

    def _states(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and the length of the longest suffix that an item contains."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for c in ids:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            state = nxt[state].get(c, 0)
            size = size + 1 if state else 0
            yield state, size

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (first, past last), apart and ascending; the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if not self.least or len(words) < self.least:
            return spans, found
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        # Words that no item has part the text into runs; shorter ones than any window can't hit.
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if z - a >= self.least:
                self._run(ids[a:z].tolist(), a, spans, found)
        return spans, found

    def _run(self, ids: list[int], at: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        link, need, short, items, window = self.link, self.need, self.short, self.items, self.window
        for i, (state, size) in enumerate(self._states(ids), at + 1):
            s = state if size >= need[state] else link[state]
            back = size if size >= window else short[s]
            if back:
                found |= items[s]
                a = i - back
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i))


def read_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size, one at a time."""
    block: list[tuple[str, bytes]] = []
    words = 0
    named = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).dropna()
    for row in named.orderBy("i").toLocalIterator():
        text = encoded(row["t"])
        n = len(alnum_words(text))
        if block and words + n > block_words:
            yield block
            block, words = [], 0
        if n:
            block.append((row["i"], text))
            words += n
    if block:
        yield block


def _automaton(name: str, sent: Broadcast[list[tuple[str, bytes]]], window: int) -> Automaton:
    """The worker's automaton of this block: built once, and kept for the tasks that follow."""
    if name not in _automata:
        while len(_automata) >= HELD_AUTOMATA:
            _automata.pop(next(iter(_automata)))
        _automata[name] = Automaton(sent.value, window)
    return _automata[name]


def scan_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """``docs`` with n_words, spans (array of first and past-last word) and items (sorted ids of items hit).

    ``finish`` takes each scanned batch in the worker of the last block's pass, so that it needs no worker of its own.
    """
    ship_package(spark)
    small_batches(spark)
    added = T.StructType.fromDDL("n_words long, spans array<struct<first:int,past:int>>, items array<string>")
    names = set(added.fieldNames())
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    out = kept.withColumns({"n_words": F.lit(None).cast("long"), "spans": F.array().cast(added["spans"].dataType), "items": F.array().cast("array<string>")})
    last: list[tuple[str, bytes]] = []
    for block in read_blocks(benchmark, item_id, item_text, block_words):
        if last:
            out = _pass(spark, out, last, text_col, window)
        last = block
    return _pass(spark, out, last, text_col, window, finish)


def _pass(spark: SparkSession, df: DataFrame, block: list[tuple[str, bytes]], text_col: str, window: int, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex
    schema = df.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, sent, window)
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in (text_col, "n_words", "spans", "items")}
            counts, spans, items = [], [], []
            for text, old, had in zip(batch.column(at[text_col]), batch.column(at["spans"]).to_pylist(), batch.column(at["items"]).to_pylist(), strict=True):
                words = encoded(text.as_py()).translate(ALNUM).split()
                new, found = automaton.scan(words)
                counts.append(len(words))
                spans.append(merged([(x["first"], x["past"]) for x in old] + new) if old else new)
                items.append(sorted({*had, *found}))
            made = {"n_words": pa.array(counts, pa.int64()), "spans": pa.array([[{"first": a, "past": z} for a, z in x] for x in spans], batch.schema.field(at["spans"]).type), "items": pa.array(items, batch.schema.field(at["items"]).type)}
            done = pa.RecordBatch.from_arrays([made.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)], schema=pa.schema([f.with_nullable(True) for f in batch.schema]))
            yield finish(done) if finish else done

    return df.mapInArrow(work, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _word_places(text: bytes) -> list[tuple[int, int]]:
    places, at = [], 0
    flat = text.translate(ALNUM)
    for w in flat.split():
        a = flat.index(w, at)
        at = a + len(w)
        places.append((a, at))
    return places


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given runs of words (and what stands between their words)."""
    raw = encoded(text)
    places, out, at = _word_places(raw), [], 0
    for a, z in spans:
        out.append(raw[at : places[a][0]])
        at = places[z - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8")


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", max_coverage: float = MAX_COVERAGE, min_span: int = 1, **how) -> DataFrame:
    """``docs`` without hit spans of at least ``min_span`` words; documents hit beyond ``max_coverage`` are gone.

    n_words, spans and items are added; where a column n_chars exists, it is the new text's length.
    """

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = {n: batch.schema.get_field_index(n) for n in (text_col, "n_words", "spans")}
        spans = batch.column(at["spans"]).to_pylist()
        hit = np.array([sum(x["past"] - x["first"] for x in row) for row in spans], np.int64)
        stay = hit <= max_coverage * batch.column(at["n_words"]).to_numpy(zero_copy_only=False)
        texts = [t.as_py() for t in batch.column(at[text_col])]
        for row in np.flatnonzero(stay & (hit > 0)).tolist():
            texts[row] = cut_spans(texts[row], [(x["first"], x["past"]) for x in spans[row] if x["past"] - x["first"] >= min_span])
        cols = [pa.array(texts, f.type) if j == at[text_col] else batch.column(j) for j, f in enumerate(batch.schema)]
        return pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(pa.array(stay))

    out = scan_documents(spark, docs, benchmark, text_col=text_col, finish=finish, **how)
    return out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in docs.columns else out
