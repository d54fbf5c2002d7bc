"""Structured Streaming: event windows, dedup, the gate automaton, work queues, and an index kept from a change stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeseam.operators import sessions
from lodeseam.session import persisted, scope


def windowed(events: DataFrame, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of (ts, event_type, value) by event-time window; rows later than ``late`` are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user that end with a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_bodies(rows: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark; state stays bounded by it."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def gated(events: DataFrame, searches: int = 2, denials: int = 3) -> DataFrame:
    """(user_id, event_id, denied) of events (user_id, event_id, is_search): the gate as a per-user automaton.

    State is two counters; a batch's rows are taken in order of their id.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        n, tries = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values("event_id")
        denied = []
        for search in rows["is_search"]:
            denied.append(not search and n < searches and tries < denials)
            n, tries = n + bool(search), tries + (not search)
        state.update((min(n, searches), min(tries, denials)))
        yield pd.DataFrame({"user_id": [key[0]] * len(rows), "event_id": rows["event_id"].to_numpy(), "denied": denied})

    return events.select("user_id", "event_id", "is_search").groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, denied boolean", "n int, tries int", "append", "NoTimeout")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``handle`` on every batch of what has come, then ends; the checkpoint makes it go on where it was."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain_queue(stream: DataFrame, work: Callable[[DataFrame], None], checkpoint: str, batch: int = 10) -> StreamingQuery:
    """Hands on the latest entry of each key, ``batch`` at a time; the rest of a trigger's rows follow in turn.

    A trigger's entries are those of one bounded queue: they are numbered once and written, then read by number.
    """

    def handle(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        with scope(spark):
            number = F.row_number().over(W.orderBy("enqueued_at", "fqn"))
            left = persisted(spark, sessions.latest_of(rows, ["fqn"], ["enqueued_at"]).withColumn("__n", number), "queue")
            for at in range(0, left.count(), batch):
                work(left.where(F.col("__n").between(at + 1, at + batch)).orderBy("__n").drop("__n"))

    return each_batch(stream, handle, checkpoint)


def keep_index(spark: SparkSession, changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps a saved index current from a stream of (seq, path, language, content, sha).

    Of a batch's changes to a path the one of the greatest ``seq`` counts; null content deletes a path.
    """
    from lodeseam.engine import Index

    def handle(rows: DataFrame, _: int) -> None:
        latest = sessions.latest_of(rows, ["path"], ["seq"])
        old = Index.load(spark, folder)
        fresh = latest.where("content is not null").select("path", "language", "content", "sha")
        if old is None:
            Index.of_sources(spark, fresh).save(spark, folder)
        else:
            old.update(spark, old.sources.join(latest.select("path"), "path", "left_anti").unionByName(fresh)).save(spark, folder)

    return each_batch(changes, handle, checkpoint)
