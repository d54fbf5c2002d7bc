"""Keywords in lines of texts, for one task: every line is scored for all queries at once, and each query's best stay."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units whose keywords a worker remembers, and sums of (line, query) that are held at a time.
REMEMBERED, SUMS = 600_000, 1 << 22
_units: list[Units] = []


class Units(dict):
    """A unit's code; ``rows[code]`` are the keywords that the unit holds, twice their number, and one more for the unit itself.

    Keywords have three characters at least; from each place of a unit the lengths are tried that keywords with its next three
    have.
    """

    def __init__(self, words: list[str]) -> None:
        self.words, self.number, lengths = words, {w: i for i, w in enumerate(words)}, {}
        for w in words:
            lengths.setdefault(w[:3], set()).add(len(w))
        self.lengths = {a: sorted(ns) for a, ns in lengths.items()}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.rows, self.codes = [()], {(): 0}

    def __missing__(self, unit: str) -> int:
        lengths, number, held = self.lengths, self.number, set()
        for at in range(len(unit) - 2):
            for n in lengths.get(unit[at : at + 3], ()):
                w = unit[at : at + n]
                if w in number:
                    held.add(2 * number[w] + (w == unit))
        row = tuple(sorted(held))
        code = self.codes.setdefault(row, len(self.rows))
        if code == len(self.rows):
            self.rows.append(row)
        self[unit] = code
        return code


def units_of(words: list[str]) -> Units:
    """What the worker's last task remembered, if it looked for the same words."""
    if not _units or _units[0].words != words:
        _units[:] = [Units(words)]
    return _units[0]


def _repeated(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several runs, one behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Scan:
    """``queries`` (query_id, kws, phrase): a phrase of null is not looked for."""

    def __init__(self, queries: pa.Table, k: int) -> None:
        self.names, self.phrases, self.k = queries["query_id"].combine_chunks(), queries["phrase"].to_pylist(), k
        kws = queries["kws"].to_pylist()
        self.words = sorted({w for ws in kws for w in ws})
        number, asking = {w: i for i, w in enumerate(self.words)}, [[] for _ in self.words]
        for q, ws in enumerate(kws):
            for w in ws:
                asking[number[w]].append(q)
        self.units, self.n = units_of(self.words), len(kws)
        self.asked, self.sizes = np.array([len(ws) for ws in kws]), np.array([len(qs) for qs in asking])
        self.asking, self.starts = np.fromiter(chain.from_iterable(asking), np.int64), np.cumsum(self.sizes) - self.sizes
        self.score, self.at, self.ids = np.zeros((self.n, k)), np.zeros((self.n, k), np.int64), None

    def hits(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, keyword, whether it is a whole word there), each keyword of a line once."""
        found = [set(x.split(" ")) for x in lines]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        codes = np.fromiter(map(self.units.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        line = np.repeat(np.arange(len(lines)), sizes)[codes > 0]
        some, which = np.unique(codes[codes > 0], return_inverse=True)
        rows = [self.units.rows[c] for c in some]
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        entries = np.fromiter(chain.from_iterable(rows), np.int64)
        each = n[which]
        key = np.sort(np.repeat(line, each) * (2 * len(self.words)) + entries[_repeated((np.cumsum(n) - n)[which], each)])
        key = key[np.append(key[1:] // 2 != key[:-1] // 2, True)] if len(key) else key
        return key // 2 // len(self.words), key // 2 % len(self.words), key & 1

    def summed(self, row: np.ndarray, word: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """For each of ``n`` rows and each query, the weights of the query's keywords in the row."""
        sizes = self.sizes[word]
        key = np.repeat(row * self.n, sizes) + self.asking[_repeated(self.starts[word], sizes)]
        return np.bincount(key, np.repeat(weight, sizes), n * self.n).reshape(n, self.n)

    def scores(self, texts: list[str], spaced: list[str], paths: list[str] | None) -> np.ndarray:
        lines = [x.split("\n") for x in spaced]
        owner = np.repeat(np.arange(len(texts)), list(map(len, lines)))
        line, word, whole = self.hits(list(chain.from_iterable(lines)))
        out, step = np.zeros((len(texts), self.n)), max(1, SUMS // self.n)
        for lo in range(0, len(owner), step):
            hi = min(lo + step, len(owner))
            a, z = np.searchsorted(line, (lo, hi))
            sums = np.minimum(self.summed(line[a:z] - lo, word[a:z], 1 + whole[a:z] / 2, hi - lo), 5.0)
            firsts = np.flatnonzero(np.diff(owner[lo:hi], prepend=-1))
            out[owner[lo:hi][firsts]] += np.add.reduceat(sums, firsts, axis=0)
        # A text with the phrase has all keywords of its query.
        key = np.unique(owner[line] * len(self.words) + word)
        held = self.summed(key // len(self.words), key % len(self.words), np.ones(len(key)), len(texts))
        for d, q in zip(*np.nonzero(held == self.asked)):
            if self.phrases[q] is not None and self.phrases[q] in texts[d]:
                out[d, q] += 12
        if paths is not None:
            row, word, _ = self.hits([x.replace("\n", " ") for x in paths])
            out += self.summed(row, word, np.full(len(row), 8.0), len(texts))
        return out

    def add(self, ids: pa.Array, texts: list[str], spaced: list[str], paths: list[str] | None) -> None:
        if len(self.units) > REMEMBERED:
            self.units.forget()
        new, scores = 0 if self.ids is None else len(self.ids), self.scores(texts, spaced, paths)
        every = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        ds, qs = np.nonzero((scores > 0) & (scores >= self.score[:, -1]))
        some = np.unique(qs)
        q, at = np.concatenate([np.repeat(some, self.k), qs]), np.concatenate([self.at[some].ravel(), new + ds])
        score = np.concatenate([self.score[some].ravel(), scores[ds, qs]])
        order = np.lexsort((np.asarray(pc.rank(every))[at], -score, q))
        best = order[np.searchsorted(q[order], some)[:, None] + np.arange(self.k)]
        self.score[some], self.at[some] = score[best], at[best]
        used, at = np.unique(self.at, return_inverse=True)
        self.ids, self.at = every.take(pa.array(used)), at.reshape(self.at.shape)


def scan(batches: Iterator[pa.RecordBatch], queries: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, doc_id, score) of the k best of each query among the rows (doc_id, t, spaced, and path or not) of a task."""
    if not queries.num_rows:
        return
    found = Scan(queries, k)
    for b in batches:
        for i in range(0, b.num_rows, 256):
            x = b.slice(i, 256)
            found.add(x["doc_id"], x["t"].to_pylist(), x["spaced"].to_pylist(), x["path"].to_pylist() if "path" in x.schema.names else None)
    rows, cols = np.nonzero(found.score)
    for i in range(0, len(rows), 1 << 16):
        at = rows[i : i + (1 << 16)], cols[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([found.names.take(pa.array(at[0])), found.ids.take(pa.array(found.at[at])), pa.array(found.score[at])], ["query_id", "doc_id", "score"])
