"""Line dedup: documents probe a sharded minimal perfect hash of repeated lines.

A line's key is the line stripped of white space, with A-Z lower-cased.  Keys of at least ``min_chars`` code points
are hashed to 128 bits; documents holding a key are counted by a shuffle of hashes that is pre-aggregated in each
task.  Keys in at least ``min_docs`` documents are dealt into shards by their hash, and each shard is built into a
minimal perfect hash (levels of bit arrays: a key stays at the first level where it falls alone on its bit, and
its number is the rank of that bit) over compact arrays: a 64-bit fingerprint, the count and the largest document
id.  A shard is one file in the shared folder.  Documents are then read once more: each line's hash gives a slot,
the slot's fingerprint tells whether the line is in the index, and the arrays are read there; lines are never
joined.  Files on a POSIX path are mapped into memory, so a probe touches only the pages it needs; files
elsewhere are read through pyarrow's file systems, a few shards at a time.  A task probes for many documents at once,
shard by shard, so each of its shards is opened once for ``PROBES`` lines.

Hash and fingerprint together are 128 bits of one digest; two lines are taken as equal if those are.

Defined results: null and empty texts are one empty line; each row is a document; a null id counts as a document
and is smaller than any other; rows that share the largest id all keep their lines; an empty table gives
an empty result; other columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.llm.bytes_text import SPACE, encoded
from lodeseam.llm.shared_files import read_whole, write_whole
from lodeseam.session import persisted, scratch, ship_package, small_batches

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys that a shard gets on average, and the bits of a level for each key that is still to place.
SHARD_KEYS, SPARSENESS, LEVELS = 1 << 18, 2.0, 40
#: Hashes that a task holds before it passes its counts on, and shards that a worker keeps open.
HELD, OPEN_SHARDS = 200_000, 16
#: Lines and bytes of text that a task gathers before it probes.
PROBES, PROBE_BYTES = 200_000, 32 << 20
_NO_ID = np.iinfo(np.int64).min
_open: dict[str, Shard] = {}


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip(SPACE)
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key.lower()


def _level_bits(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where the hashes fall in a level of ``size`` bits."""
    with np.errstate(over="ignore"):
        x = (h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) % np.uint64(size)


def build_shard(h: np.ndarray, fp: np.ndarray, count: np.ndarray, top: np.ndarray) -> bytes:
    """The file of a shard: a header of longs, the levels' bits and ranks, then the arrays in slot order."""
    left = np.arange(len(h))
    sizes, bits, slots, placed = [], [], np.full(len(h), -1, np.int64), 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, -(-int(len(left) * SPARSENESS) // 64) * 64)
        at = _level_bits(h[left], level, size)
        alone = np.bincount(at, minlength=size)[at] == 1
        marks = np.zeros(size, np.uint8)
        marks[at[alone]] = 1
        rank = np.cumsum(marks, dtype=np.int64) - 1
        slots[left[alone]] = placed + rank[at[alone]]
        placed += int(alone.sum())
        sizes.append(size)
        bits.append(np.packbits(marks, bitorder="little"))
        left = left[~alone]
    # Equal 64-bit hashes never come apart; such keys (of other fingerprints) stand after the slots, in a list.
    order = np.argsort(slots, kind="stable")
    order = np.concatenate((order[len(left) :], left[np.argsort(fp[left], kind="stable")]))
    words = np.concatenate(bits) if bits else np.zeros(0, np.uint8)
    ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words.view(np.uint64)).astype(np.int64)))) if len(words) else np.zeros(1, np.int64)
    head = np.array([len(h), placed, len(sizes), *sizes], np.int64)
    return b"".join(x.tobytes() for x in (head, words, ranks, fp[order].astype(np.uint64), top[order].astype(np.int64), count[order].astype(np.uint32)))


class Shard:
    """Reads a shard's file from a buffer."""

    def __init__(self, buffer: memoryview | bytes) -> None:
        n, self.placed, levels = np.frombuffer(buffer, np.int64, 3)
        self.sizes = np.frombuffer(buffer, np.int64, levels, 24)
        at = 24 + 8 * int(levels)
        n_words = int(self.sizes.sum()) // 64
        self.words = np.frombuffer(buffer, np.uint64, n_words, at)
        self.ranks = np.frombuffer(buffer, np.int64, n_words + 1, at + 8 * n_words)
        at += 16 * n_words + 8
        self.fp = np.frombuffer(buffer, np.uint64, n, at)
        self.top = np.frombuffer(buffer, np.int64, n, at + 8 * int(n))
        self.count = np.frombuffer(buffer, np.uint32, n, at + 16 * int(n))

    def find(self, h: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """The slots of the keys, -1 for those that aren't in the shard."""
        out = np.full(len(h), -1, np.int64)
        left, start = np.arange(len(h)), 0
        for level, size in enumerate(self.sizes.tolist()):
            bit = _level_bits(h[left], level, size).astype(np.int64) + start
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            value = self.words[word]
            on = (value >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(value[on] & ((np.uint64(1) << shift[on]) - np.uint64(1)))
            out[left[on]] = self.ranks[word[on]] + below
            left = left[~on]
            start += size
        same = np.zeros(len(h), bool)
        found = out >= 0
        same[found] = self.fp[out[found]] == fp[found]
        out[~same] = -1
        if self.placed < len(self.fp) and len(left):
            tail = self.fp[self.placed :]
            k = np.searchsorted(tail, fp[left])
            ok = k < len(tail)
            ok[ok] = tail[k[ok]] == fp[left][ok]
            out[left[ok]] = self.placed + k[ok]
        return out


def _shard(uri: str) -> Shard:
    if uri not in _open:
        while len(_open) >= OPEN_SHARDS:
            _open.pop(next(iter(_open)))
        _open[uri] = Shard(read_whole(uri))
    return _open[uri]


def _split_hash(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def count_lines(spark: SparkSession, docs: DataFrame, text_col: str, id_col: str, min_chars: int) -> DataFrame:
    """h, fp, n (documents that hold the line) and top (the largest of their ids)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            h, fp = _split_hash(list(held))
            counts = np.array(list(held.values()), np.int64).reshape(-1, 2)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(counts[:, 0]), pa.array(counts[:, 1])], names=["h", "fp", "n", "top"])

        for batch in batches:
            for text, doc in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                doc = _NO_ID if doc is None else doc
                keys = {k for line in encoded(text.as_py()).split(b"\n") if len(line) >= min_chars and (k := line_key(line, min_chars)) is not None}
                for k in keys:
                    c = held.setdefault(xxhash.xxh3_128_digest(k), [0, _NO_ID])
                    c[0] += 1
                    c[1] = max(c[1], doc)
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")).mapInArrow(work, "h long, fp long, n long, top long")
    return rows.groupBy("h", "fp").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def build_index(spark: SparkSession, docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[str, int, frozenset[int]]:
    """Writes the shards; their folder, the number of bits of a hash that name its shard, and the shards that have keys."""
    ship_package(spark)
    small_batches(spark)
    often = persisted(spark, count_lines(spark, docs, text_col, id_col, min_chars).where(F.col("n") >= min_docs), "line-counts")
    bits = max(0, (max(1, -(-often.count() // shard_keys)) - 1).bit_length())
    folder = scratch(spark, "line-index")

    def build(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        h, fp, n, top = (table.column(c).to_numpy() for c in ("h", "fp", "n", "top"))
        order = np.lexsort((fp, h))  # the same file whatever order the rows came in
        data = build_shard(h[order].view(np.uint64), fp[order].view(np.uint64), n[order], top[order])
        write_whole(f"{folder}/{key[0].as_py()}.mph", data)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([len(data)], pa.int64())], names=["shard", "keys", "bytes"])

    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    made = often.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard int, keys long, bytes long")
    # One number for each ``shard_keys`` keys.
    return folder, bits, frozenset(r["shard"] for r in persisted(spark, made, "line-shards").select("shard").collect())


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``docs`` with n_lines, n_dropped and clean_text, the text without the lines that others keep."""
    folder, bits, shards_made = build_index(spark, docs, text_col=text_col, id_col=id_col, min_chars=min_chars, min_docs=min_docs, shard_keys=shard_keys)
    added = T.StructType.fromDDL("n_lines long, n_dropped long, clean_text string")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added.fieldNames()])

    def tops(digests: list[bytes]) -> np.ndarray:
        """The id that keeps each line, or the largest long for lines that no shard has."""
        h, fp = _split_hash(digests)
        out = np.zeros(len(h), np.int64)
        known = np.zeros(len(h), bool)
        shards = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        for s in np.unique(shards).tolist():
            rows = np.flatnonzero(shards == s)
            if s in shards_made:  # its file must be there: a lost shard fails the task
                shard = _shard(f"{folder}/{s}.mph")
                slots = shard.find(h[rows], fp[rows])
                hit = slots >= 0
                out[rows[hit]] = shard.top[slots[hit]]
                known[rows[hit]] = True
        return np.where(known, out, np.iinfo(np.int64).max)

    def clean(batch: pa.RecordBatch, lines: list[list[bytes | None]], at: list[tuple[int, int]], keeper: np.ndarray) -> pa.RecordBatch:
        ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
        own = np.array([_NO_ID if ids[row] is None else ids[row] for row, _ in at], np.int64)
        dropped = [0] * len(lines)
        for x in np.flatnonzero((keeper != np.iinfo(np.int64).max) & (keeper != own)).tolist():
            row, j = at[x]
            lines[row][j] = None
            dropped[row] += 1
        texts = [b"\n".join([x for x in parts if x is not None]).decode("utf-8") for parts in lines]
        cols = [*batch.columns, pa.array([len(x) for x in lines], pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *added.fieldNames()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, list, list]] = []
        digests: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, digests, size
            keeper, upto = tops(digests) if digests else np.zeros(0, np.int64), 0
            for batch, lines, at in held:
                yield clean(batch, lines, at, keeper[upto : upto + len(at)])
                upto += len(at)
            held, digests, size = [], [], 0

        for batch in batches:
            lines = [encoded(t.as_py()).split(b"\n") for t in batch.column(batch.schema.get_field_index(text_col))]
            at = []
            for row, parts in enumerate(lines):
                for j, line in enumerate(parts):
                    size += len(line)
                    if len(line) >= min_chars and (k := line_key(line, min_chars)) is not None:
                        at.append((row, j))
                        digests.append(xxhash.xxh3_128_digest(k))
            held.append((batch, lines, at))
            if len(digests) >= PROBES or size >= PROBE_BYTES:
                yield from flush()
        yield from flush()

    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, *added.fields]))
