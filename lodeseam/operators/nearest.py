"""The nearest vectors of many queries, for one task: matrix products, and sums in order for what may be among the best."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and queries of one matrix product, pairs that are merged at a time, and those of them that are summed at a time.
ROWS, QUERIES, PAIRS, SUMS = 8192, 128, 1 << 15, 1 << 11
#: Vectors of a greater norm, or of none, are not multiplied in single precision; each of their pairs is summed in order.
LARGE = 1e18
#: Identifiers that a task holds beside those of its best.
HELD = 1 << 18
# fixed values: what a score is, in the order of a ranking
NAN, NUMBER, NULL, NONE = range(4)


# Arrow's own ways from and to numpy, and its scalars, load pandas, which takes a worker as long as some million pairs.
def nulls(column: pa.Array) -> np.ndarray:
    return numbers(column.is_null().cast(pa.int8())).astype(bool)


def numbers(column: pa.Array, fill: float = 0) -> np.ndarray:
    """Numbers as they lie in memory; a copy with ``fill`` for nulls if there are any."""
    x = np.frombuffer(column.buffers()[1] or b"", np.dtype(str(column.type)))[column.offset :][: len(column)]
    return np.where(nulls(column), fill, x) if column.null_count else x


def column(x: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    mask = None if null is None else pa.py_buffer(np.packbits(~null, bitorder="little"))
    return pa.Array.from_buffers(pa.from_numpy_dtype(x.dtype), len(x), [mask, pa.py_buffer(np.ascontiguousarray(x))])


def rounded(x: np.ndarray) -> np.ndarray:
    """To 6 places as Spark does it: half up, by the decimal digits that a number is written with."""
    real = np.isfinite(x)
    size = np.where(real, np.abs(x), 0.0) * 1e6
    whole = np.floor(size + 0.5)
    out = np.copysign(whole / 1e6, x) + 0.0
    odd = (np.abs(size - np.floor(size) - 0.5) < 1e-3) | (size > 1e9)
    for i in np.flatnonzero(odd & real):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0 if abs(x[i]) < 1e15 else x[i]
    return np.where(real, out, x)


def by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length: the places of its vectors, their matrix, and which of them hold a null; no vector has no length."""
    values = vectors.flatten()
    sizes = numbers(pc.list_value_length(vectors).cast(pa.int64()), -1)
    holes, flat = nulls(values), numbers(values.cast(pa.float64()), np.nan)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    out = {}
    for n in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == n)
        at = starts[rows][:, None] + np.arange(n)
        out[int(n)] = rows, flat[at], holes[at].any(axis=1)
    return out


def products(left: np.ndarray, right: np.ndarray, ls: np.ndarray, rs: np.ndarray) -> np.ndarray:
    """Dot products of pairs of rows, each summed in order."""
    out = np.zeros(len(ls))
    for i in range(0, len(ls) if left.shape[1] else 0, SUMS):
        at = slice(i, i + SUMS)
        out[at] = np.cumsum(left[ls[at]] * right[rs[at]], axis=1)[:, -1]
    return rounded(out)


def single(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A matrix in single precision, zero where it can't be had so, and the norms of its rows; NaN where they are too large."""
    norms = np.linalg.norm(matrix, axis=1)
    norms[~(norms <= LARGE)] = np.nan
    return np.where(np.isnan(norms)[:, None], 0.0, matrix).astype(np.float32), norms


def floor(near: np.ndarray, k: int) -> np.ndarray:
    """Of each row, a value that k of its numbers reach: the k-th of the greatest numbers of groups, nearly the k-th of all."""
    while near.shape[1] >= 16 * k:
        half = near.shape[1] // 2
        near = np.maximum(near[:, :half], near[:, half : 2 * half])
    return np.partition(near, -k, axis=1)[:, -k]


class Nearest:
    """The k best of each query among the vectors seen so far, which come in the order that breaks ties."""

    def __init__(self, queries: pa.Array, k: int, positive: bool) -> None:
        with np.errstate(all="ignore"):
            self.groups = {n: (rows, matrix, holes, *single(matrix)) for n, (rows, matrix, holes) in by_length(queries).items()}
        self.k, self.positive = k, positive
        shape = len(queries), k
        self.kind, self.score, self.at = np.full(shape, NONE, np.int8), np.zeros(shape), np.zeros(shape, np.int64)

    def add(self, column: pa.Array, base: int) -> None:
        """Vectors whose places begin at ``base``."""
        with np.errstate(all="ignore"):
            for n, (rows, matrix, holes) in by_length(column).items():
                if n not in self.groups:
                    continue
                asked = self.groups[n]
                short, norms = single(matrix)
                for i in range(0, len(rows), ROWS):
                    d = slice(i, i + ROWS)
                    step = ROWS * QUERIES // len(rows[d])
                    for j in range(0, len(asked[0]), step):
                        q = slice(j, j + step)
                        self._meet(*(x[q] for x in asked), matrix[d], holes[d], short[d], norms[d], base + rows[d])

    def _meet(self, asked, vectors, gaps, q_short, q_norms, matrix, holes, d_short, d_norms, places) -> None:
        near = q_short @ d_short.T
        last, least = self.kind[asked, -1], self.score[asked, -1]
        # What single precision and other orders of a sum can change: a part of the norms' product, and what is too small to tell.
        n, far = matrix.shape[1], np.nanmax(d_norms, initial=0.0)
        slack = (n + 8) * (2.0**-23 * q_norms * far + 2.0**-120 * (q_norms + far)) + 1e-12
        # A later row must be better than the last of a full list by what rounding shows, or be among the best of this part.
        limit = np.where(last == NUMBER, least + 4.9e-7, -np.inf) - slack
        odd = holes | np.isnan(d_norms)
        if odd.any():
            near[:, odd] = -np.inf
        fresh = last > NUMBER
        if fresh.any() and near.shape[1] > self.k:
            limit[fresh] = floor(near[fresh], self.k) - 1.1e-6 - 2 * slack[fresh]
        if self.positive:
            limit = np.maximum(limit, 4.9e-7 - slack)
        limit[gaps | (last == NAN)] = np.inf
        # Compared in single precision: the next lower number there lets nothing slip.
        below = np.nextafter(limit.astype(np.float32), np.float32(-np.inf))
        passed = ~(near <= below[:, None])
        if odd.any() or gaps.any():
            passed[:, odd] = True
            passed[last == NAN] = False
            gap = holes[None, :] | gaps[:, None]
            passed[gap] = np.broadcast_to((last == NONE)[:, None], gap.shape)[gap]
        found = np.flatnonzero(passed)
        for i in range(0, len(found), PAIRS):
            self._keep(asked, vectors, gaps, matrix, holes, places, *np.divmod(found[i : i + PAIRS], len(places)))

    def _keep(self, asked, vectors, gaps, matrix, holes, places, qs, ds) -> None:
        score = products(vectors, matrix, qs, ds)
        kind = np.where(gaps[qs] | holes[ds], NULL, np.where(np.isnan(score), NAN, NUMBER)).astype(np.int8)
        score = np.where(kind == NUMBER, score, 0.0)
        last, least = self.kind[asked[qs], -1], self.score[asked[qs], -1]
        good = (kind < last) | ((kind == last) & (score > least))
        if self.positive:
            good &= (kind == NAN) | (score > 0)
        qs, ds, kind, score = qs[good], ds[good], kind[good], score[good]
        if not len(qs):
            return
        some = np.unique(qs)
        rows = asked[some]
        q = np.concatenate([np.repeat(some, self.k), qs])
        kinds, scores, at = np.concatenate([self.kind[rows].ravel(), kind]), np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.at[rows].ravel(), places[ds]])
        order = np.lexsort((at, -scores, kinds, q))
        best = order[np.searchsorted(q[order], some)[:, None] + np.arange(self.k)]
        self.kind[rows], self.score[rows], self.at[rows] = kinds[best], scores[best], at[best]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``ROWS`` rows at least, however small a session's other operators need them."""
    some, n = [], 0
    for b in batches:
        some, n = [*some, b], n + len(b)
        if n >= ROWS:
            yield pa.concat_batches(some)
            some, n = [], 0
    if n:
        yield pa.concat_batches(some)


def nearest(batches: Iterator[pa.RecordBatch], queries: pa.Table, k: int, positive: bool) -> Iterator[pa.RecordBatch]:
    """(query_id, doc_id, score) of the k best of each query among the rows (doc_id, vec) of a task, which are in order."""
    queries = queries.combine_chunks()
    name, vectors = queries["query_id"].combine_chunks(), queries["vec"].combine_chunks()
    best, ids = Nearest(vectors, k, positive), None
    for b in gathered(batches):
        best.add(b["vec"], 0 if ids is None else len(ids))
        ids = b["doc_id"] if ids is None else pa.concat_arrays([ids, b["doc_id"]])
        if len(ids) > HELD + 2 * best.at.size:
            used, at = np.unique(best.at, return_inverse=True)
            ids, best.at = ids.take(column(used)), at.reshape(best.at.shape)
    if ids is None:
        return
    rows, cols = np.nonzero(best.kind < NONE)
    for i in range(0, len(rows), 1 << 16):
        at = rows[i : i + (1 << 16)], cols[i : i + (1 << 16)]
        kind = best.kind[at]
        score = column(np.where(kind == NAN, np.nan, best.score[at]), kind == NULL)
        yield pa.RecordBatch.from_arrays([name.take(column(at[0])), ids.take(column(best.at[at])), score], ["query_id", "doc_id", "score"])


def scores(batches: Iterator[pa.RecordBatch], queries: pa.Table) -> Iterator[pa.RecordBatch]:
    """(query_id, doc_id, score) of the rows (query_id, doc_id, vec), once for each of ``queries`` that has the identifier."""
    queries = queries.combine_chunks()
    name = queries["query_id"].combine_chunks().dictionary_encode()
    codes = numbers(name.indices)
    order, sizes = np.argsort(codes, kind="stable"), np.bincount(codes, minlength=len(name.dictionary))
    starts, asked = np.cumsum(sizes) - sizes, by_length(queries["vec"].combine_chunks())
    for b in batches:
        code = numbers(pc.index_in(b["query_id"], value_set=name.dictionary, skip_nulls=True), -1)
        n = np.where(code < 0, 0, sizes[code])
        ds = np.repeat(np.arange(len(b)), n)
        qs = order[np.repeat(starts[code] - np.cumsum(n) + n, n) + np.arange(len(ds))]
        score, null = np.zeros(len(ds)), np.ones(len(ds), bool)
        for size, (rows, matrix, holes) in by_length(b["vec"]).items():
            if size not in asked:
                continue
            places, vectors, gaps = asked[size]
            left, right = (np.full(m, -1) for m in (len(queries), len(b)))
            left[places], right[rows] = np.arange(len(places)), np.arange(len(rows))
            at = np.flatnonzero((left[qs] >= 0) & (right[ds] >= 0))
            q, d = left[qs[at]], right[ds[at]]
            with np.errstate(all="ignore"):
                score[at] = products(vectors, matrix, q, d)
            null[at] = gaps[q] | holes[d]
        at = column(ds)
        yield pa.RecordBatch.from_arrays([b["query_id"].take(at), b["doc_id"].take(at), column(score, null)], ["query_id", "doc_id", "score"])
