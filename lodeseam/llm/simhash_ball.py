"""SimHash near-dedup by meet-in-the-middle ball hashing.

A 64-bit fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles.  Equal fingerprints are
made one first.  Two fingerprints that differ in at most ``radius`` = 3 bits are met in two rounds, in each of which a
fingerprint emits the variants within half the radius, rounded down to one bit, of what is left of it:

1. *Whole fingerprints.*  Each emits itself and its 64 one-bit variants.  All that share a variant are within two
   bits of each other, so a variant links its fingerprints to the least of them: no pairs, nothing to verify.
   Labels are then spread to whole components.
2. *Three bits apart.*  Of three differing bits at least one lies in some third of the fingerprint.  For each third,
   the rest of the fingerprint (43 bits or so) emits itself and its one-bit variants; two rests that differ in at
   most two bits share one.  Fingerprints of different components that collide are verified on all 64 bits; where
   over ``CROWD`` rests collide, variants of the third are part of the key too, so that no bucket is paired whole.

Verified links join the components of round 1, and labels are spread again: each class is what can be reached over
links of at most three bits.  (Emitting the two-bit ball, 2,081 variants, would meet all in one round, with 16 times the
rows.)

Labels spread by hooking roots, pointer jumping until every label is a root, and carrying the edges between different
roots into the next round: joins on vertex ids, as many as the logarithm of the vertices a round at most, with every
step written to the shared folder.

Defined results: texts with fewer words than a shingle are one shingle; texts without words, and nulls, have
fingerprint zero and are linked like any other; a null id is a member of its class but never its name, unless the
class has no other id; repeated rows are classed alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.llm.bytes_text import encoded
from lodeseam.session import discard, persisted, scope, ship_package, small_batches

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Shared variants up to this many (some 64 MB) are sent to all executors; more are met by a shuffle.
BROADCAST_KEYS = 2_000_000
#: Document ids that keep_one sends at most.
BROADCAST_IDS = 1_000_000
#: Rests that collide in a bucket beyond this many are told apart by the third left out, not by pairs.
CROWD = 500
#: Fingerprints whose balls one task makes, as long as that takes no more tasks than the second figure.
TASK_FPS, MAX_TASKS = 20_000, 200_000
#: The thirds of a fingerprint, as masks of what is left without them.
_THIRDS = [((1 << 22) - 1) << 42, ((1 << 21) - 1) << 21, (1 << 21) - 1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a text's UTF-8 bytes."""
    words = text.lower().split()  # of bytes: only A-Z are lower-cased, only \x20\x09-\x0D part words
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:z], seed) for a, z in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes)).view(">u8")[0])


def fingerprints(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and fp (signed) of every row of ``docs``."""
    ship_package(spark)
    small_batches(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(encoded(t.as_py()), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(work, T.StructType([rows.schema["id"], T.StructField("fp", T.LongType())]))


def _ball(x: Column, keep: int, tag: int = 0) -> Column:
    """``x`` within ``keep`` and its one-bit variants there, with ``tag`` in the bits left out."""
    flips = [0, *(1 << b for b in range(64) if keep >> b & 1)]
    return F.transform(F.array(*[F.lit(_signed(f | tag)) for f in flips]), lambda f: x.bitwiseAND(F.lit(_signed(keep))).bitwiseXOR(f))


def _ball_within(keep: int) -> Callable[[Column], Column]:
    return lambda v: _ball(v, keep)


def _sent(keys: DataFrame, bound: int = BROADCAST_KEYS) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= bound else keys


def spread_labels(spark: SparkSession, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, label): the least vertex that each can reach.  ``vertices`` (v long, distinct), ``edges`` (a, b)."""
    order = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    with scope(spark) as keep:
        edges = persisted(spark, edges.where("a <> b").select(*order("a", "b")).distinct(), "cc-edges")
        labels = None  # of the vertices that have edges
        while not edges.isEmpty():
            # Each root with edges hooks on the least of itself and its neighbours.  Labels only fall, so there are no
            # cycles; two rounds at least halve the roots with edges.
            pairs = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("a").alias("label")), F.struct(F.col("b").alias("v"), F.col("a").alias("label"))))
            jumped = persisted(spark, edges.select(pairs.alias("p")).select("p.*").groupBy("v").agg(F.min("label").alias("label")).withColumn("moved", F.lit(True)), "cc-hooked")
            while not jumped.where("moved").isEmpty():  # pointer jumping, until all labels are roots
                up = _sent(jumped.select(F.col("v").alias("label"), F.col("label").alias("top")))
                before, jumped = jumped, persisted(spark, jumped.join(up, "label").select("v", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved")), "cc-jumped")
                discard(before)
            roots = jumped.select("v", "label")
            up = _sent(roots.select(F.col("v").alias("label"), F.col("label").alias("top")))
            if labels is None:
                labels = roots
            else:
                labels = persisted(spark, labels.join(up, "label", "left").select("v", F.coalesce("top", "label").alias("label")), "cc-labels")
            # The edges between the roots' new roots: those within one are done with, as its vertices stay together.
            la, lb = roots.select(F.col("v").alias("a"), F.col("label").alias("la")), roots.select(F.col("v").alias("b"), F.col("label").alias("lb"))
            before, edges = edges, persisted(spark, edges.join(_sent(la), "a").join(_sent(lb), "b").where("la <> lb").select(*order("la", "lb")).distinct(), "cc-edges")
            discard(before)
        if labels is None:
            return vertices.select("v", F.col("v").alias("label"))
        return keep(vertices.join(_sent(labels), "v", "left").select("v", F.coalesce("label", "v").alias("label")), "cc-labels")


def classes(spark: SparkSession, fps: DataFrame) -> DataFrame:
    """(fp, least id, component_id) of the distinct fingerprints of ``fps`` (id, fp)."""
    with scope(spark) as keep:
        distinct = persisted(spark, fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-few")
        # Small rows lie in few files: they are dealt out before each makes its ball.
        tasks = min(MAX_TASKS, -(-distinct.count() // TASK_FPS) or 1)
        distinct = persisted(spark, distinct.repartition(tasks, "fp"), "simhash-distinct")
        every = (1 << 64) - 1
        shared = distinct.select("fp", F.explode(_ball(F.col("fp"), every)).alias("z")).groupBy("z").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
        shared = persisted(spark, shared, "simhash-shared")
        # A fingerprint's own variants tell which of those it is linked to.
        touched = persisted(spark, _sent(shared.select("z", "lo")).join(distinct.select("fp", F.explode(_ball(F.col("fp"), every)).alias("z")), "z").where("fp <> lo").groupBy("fp", "lo").agg(F.lit(1)).select(F.col("fp").alias("a"), F.col("lo").alias("b")), "simhash-near")
        first = spread_labels(spark, distinct.select(F.col("fp").alias("v")), touched)
        named = persisted(spark, first.select(F.col("v").alias("fp"), F.col("label").alias("c")).repartition(tasks, "fp"), "simhash-named")
        links = _links_of_three(spark, named)
        second = spread_labels(spark, first.where("v = label").select("v"), links)
        final = named.join(second.select(F.col("v").alias("c"), F.col("label").alias("root")), "c").join(distinct, "fp")
        final = persisted(spark, final.select("fp", "least", "root"), "simhash-roots")
        names = persisted(spark, final.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
        return keep(final.join(names, "root").select("fp", "least", "component_id"), "simhash-classes")


def _links_of_three(spark: SparkSession, named: DataFrame) -> DataFrame:
    """(a, b): the components (c) of the fingerprints of ``named`` (fp, c) that differ in three bits."""
    every, rests = (1 << 64) - 1, None
    for k, third in enumerate(_THIRDS):
        part = named.select("fp", "c", F.explode(_ball(F.col("fp"), every ^ third, k * (third & -third))).alias("z"), F.lit(k).alias("k"))
        rests = part if rests is None else rests.unionByName(part)
    met = rests.groupBy("z").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("z", (F.col("n") > CROWD).alias("crowd"))
    met = persisted(spark, met, "simhash-met")
    inside = persisted(spark, rests.join(_sent(met), "z"), "simhash-colliding")
    near = (F.col("x.c") != F.col("y.c")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS)
    few = inside.where("NOT crowd")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.z") == F.col("y.z")) & (F.col("x.c") < F.col("y.c")) & near).select("x.c", F.col("y.c").alias("d"))
    # Where many rests collide, the third that was left out tells them apart: of two thirds within three bits, the
    # one's one-bit ball meets the other's two-bit ball.
    for k, third in enumerate(_THIRDS):
        crowd = inside.where(F.col("crowd") & (F.col("k") == k))
        if crowd.isEmpty():
            continue
        ones = F.array_distinct(_ball(F.col("fp"), third))
        twos = F.array_distinct(F.flatten(F.transform(ones, _ball_within(third))))
        x, y = crowd.withColumn("t", F.explode(ones)).alias("x"), crowd.withColumn("t", F.explode(twos)).alias("y")
        pairs = pairs.unionByName(x.join(y, (F.col("x.z") == F.col("y.z")) & (F.col("x.t") == F.col("y.t")) & near).select("x.c", F.col("y.c").alias("d")))
    return pairs.groupBy(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).agg(F.lit(1)).select("a", "b")


def near_duplicates(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hex digits) and component_id."""
    fps = persisted(spark, fingerprints(spark, docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash")
    out = fps.join(classes(spark, fps), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the document of the least id of each class alone; of rows that share it, one of the least text.

    The ids that go are met with the texts: sent to all executors up to ``BROADCAST_IDS``, shuffled beyond.
    """
    found = near_duplicates(spark, docs, id_col=id_col, text_col=text_col, shingle=shingle)
    first = F.col(id_col).eqNullSafe(F.col("component_id")).cast("long")
    per = persisted(spark, found.groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.sum(first).alias("__n")), "simhash-firsts")
    same = docs[f"`{id_col}`"].eqNullSafe(F.col("__id"))
    often = per.where("__n > 1").select("__id")
    kept = docs.join(_sent(per.where("__n <> 1").select("__id"), BROADCAST_IDS), same, "left_anti")
    if often.isEmpty():
        return kept
    again = docs.join(_sent(often, BROADCAST_IDS), same, "left_semi").groupBy(F.col(f"`{id_col}`").alias("__id"))
    least = again.agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col(f"`{text_col}`").isNotNull(), F.col(f"`{text_col}`"))).alias("__row"))
    return kept.unionByName(least.select("__row.*"))
