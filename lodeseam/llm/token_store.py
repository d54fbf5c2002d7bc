"""Token-ID output: documents as token ids in wavelet-matrix shards, in ascending order of document id.

Documents are dealt by ranges of their id and sorted within each; each task encodes its texts and writes a shard
whenever ``shard_tokens`` ids are together, so a shard is a run of whole documents and of bounded size (a single
longer document apart).  A manifest of one small row for each shard is kept beside them; the number of ids before
a shard is a sum over the manifest.  Shards are written whole under a name given by task and number: a task that
runs again replaces its shards by the same ones.

Words that white space parts are encoded by themselves: the tokenizer drops white space and never joins what it
parts.  A task's words are made distinct batch by batch, and each worker keeps the ids of the words it has met
(up to ``HELD_WORDS``, then it begins anew), so most text never reaches the tokenizer twice.  An ASCII letter and
an ASCII mark after it are always different pieces, so they are parted first.  Texts with ``<|``, which may hold
special tokens, are encoded whole.

Defined results: null and empty texts hold the end id alone; a null id comes before all others; rows that share
an id stand side by side, by their text; an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.llm import wavelet
from lodeseam.llm.shared_files import read_whole, write_whole
from lodeseam.session import persisted, scratch, ship_package, small_batches

TOKENIZER, END_ID = "word_bpe_49k.json", 2
SHARD_TOKENS, HELD_WORDS, RANGE_BYTES = 1 << 22, 900_000, 256 << 20
_encoders: dict[tuple[int, int, int], Encoder] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes batches of texts, keeping the ids of the words it has met.

    ``definition`` is the text of a tokenizer file.  Only for tokenizers that drop white space and lower-case A-Z, as the
    default one.
    """

    def __init__(self, definition: str, end_id: int = END_ID, held_words: int = HELD_WORDS) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.held_words = Tokenizer.from_str(definition), end_id, held_words
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.starts[1], self.sizes[1], self.ids[0] = 0, 1, self.end_id  # entry 0: nothing; entry 1: the end id
        self.entries, self.used = 2, 1

    def _add(self, words: list[str]) -> None:
        for encoding, word in zip(self.tokenizer.encode_batch_fast(words, add_special_tokens=False), words, strict=True):
            ids = encoding.ids
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            if self.entries == len(self.starts):
                self.starts, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes))
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts[self.entries], self.sizes[self.entries] = self.used, len(ids)
            self.known[word] = self.entries
            self.entries += 1
            self.used += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and the number of each text's ids."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|")
        whole = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        plain = pc.if_else(special, "", texts) if len(whole) else texts
        parted = pc.replace_substring_regex(pc.ascii_lower(plain), r"([a-z])([.,!?;:%$&#*|])", r"\1 \2")
        lists = pc.ascii_split_whitespace(parted)
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) > self.held_words:
            self._forget()
        if new := [w for w in distinct if w not in self.known]:
            self._add(new)
        entry = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(counts)
        flow = np.insert(entry[words.indices.to_numpy(zero_copy_only=False)], ends, 1)
        size = self.sizes[flow]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(self.starts[flow] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        sizes = np.diff(upto[ends + np.arange(len(ends))], prepend=0) if len(ends) else np.zeros(0, np.int64)
        if len(whole):
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in whole.tolist():
                parts[i] = np.array([*self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.end_id], np.uint32)
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, sizes


def _encoder(sent: Broadcast[str], end_id: int, held_words: int) -> Encoder:
    """The worker's encoder, kept for the tasks that follow."""
    key = (hash(sent.value), end_id, held_words)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(sent.value, end_id, held_words)
    return _encoders[key]


@dataclass(frozen=True)
class Store:
    folder: str
    manifest: str


def _scanned_bytes(df: DataFrame) -> int:
    """The size of the one table that a plan scans; 0 where it is another plan, or the size isn't known."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    return size if plan.collectLeaves().size() == 1 and size < 1 << 60 else 0


def write_store(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, held_words: int = HELD_WORDS) -> Store:
    """Writes the shards (``<task>-<number>.wm``) and the manifest (part, seq, docs, tokens, path)."""
    ship_package(spark)
    small_batches(spark, 1024)
    folder = folder or scratch(spark, "tokens", lasting=True)
    # The tokenizer's file is sent along: executors need not have it at the driver's path.
    with open(tokenizer or tokenizer_path(), encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(sent, end_id, held_words), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        seq = total = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, total, held
            ids, sizes, docs, null = (np.concatenate(x) for x in zip(*held, strict=True))
            uri = f"{folder}/{part:06d}-{seq:06d}.wm"
            write_whole(uri, wavelet.build(ids, docs, null, sizes))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "docs": [len(docs)], "tokens": [len(ids)], "path": [uri]})
            seq, total, held = seq + 1, 0, []
            return row

        for batch in batches:
            ids, sizes = encoder.encode(batch.column(1))
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            docs = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
            at = first = 0
            while first < len(sizes):
                # As many documents as fill the shard up; a document is never parted.
                upto = np.cumsum(sizes[first:])
                k = min(len(upto), int(np.searchsorted(upto, shard_tokens - total)) + 1)
                n = int(upto[k - 1])
                held.append((ids[at : at + n].astype(np.uint32), sizes[first : first + k], docs[first : first + k], null[first : first + k]))
                total, at, first = total + n, at + n, first + k
                if total >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # Where the session's partition count would make ranges of much over RANGE_BYTES of input, more are made.
    ranges = _scanned_bytes(rows) // RANGE_BYTES
    dealt = rows.repartitionByRange(ranges, "id") if ranges > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartitionByRange("id")
    made = dealt.sortWithinPartitions("id", "text").mapInArrow(work, "part int, seq int, docs long, tokens long, path string")
    manifest = f"{folder}-manifest"
    made.write.parquet(manifest)
    return Store(folder, manifest)


def shard_starts(spark: SparkSession, store: Store) -> DataFrame:
    """The manifest with ``start``, the ids of all shards before: sums of tasks first, then within each task."""
    rows = spark.read.schema("part int, seq int, docs long, tokens long, path string").parquet(store.manifest)
    parts = rows.groupBy("part").agg(F.sum("tokens").alias("t"))
    before = parts.withColumn("before", F.sum("t").over(W.orderBy("part")) - F.col("t")).drop("t")
    within = F.sum("tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("tokens")
    return rows.withColumn("within", within).join(before, "part").withColumn("start", F.col("before") + F.col("within")).drop("before", "within")


def read_documents(spark: SparkSession, store: Store, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the shards."""
    ship_package(spark)
    shards = persisted(spark, shard_starts(spark, store), "token-starts")
    n = max(1, min(shards.count(), 20_000))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = wavelet.WaveletFile(read_whole(uri))
                ids = f.decode().astype("<u4")
                ends = np.cumsum(f.doc_sizes)
                begins = ends - f.doc_sizes
                parts = [ids[a:z] for a, z in zip(begins.tolist(), ends.tolist(), strict=True)]
                cols = {"doc_id": pa.array(f.doc_ids, pa.int64(), mask=f.doc_null), "start": pa.array(begins + start), "n_tokens": pa.array(f.doc_sizes), "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array([p.tolist() for p in parts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return shards.select("path", "start").repartition(n, "path").mapInArrow(work, schema)
