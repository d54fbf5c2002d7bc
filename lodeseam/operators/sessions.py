"""Session state over event logs: turns, dedup, gates, queues and bounded history, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.operators import intervals


def turns(log: DataFrame, by: str, order: str) -> DataFrame:
    return log.withColumn("turn_index", F.row_number().over(W.partitionBy(by).orderBy(order)).cast("long"))


def last_n(log: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The newest n rows of each session, the newest first."""
    w = W.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("back", F.row_number().over(w).cast("long")).where(F.col("back") <= n)


def latest_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def live_turns(log: DataFrame, by: str, ts: Column, ttl_minutes: int = 60, max_turns: int = 50) -> DataFrame:
    """Turns within the time to live, counted from the session's first turn, and within the turn limit."""
    first = F.min(ts).over(W.partitionBy(by))
    age = (ts.cast("double") - first.cast("double")) / 60
    return log.withColumn("__age", age).where(F.col("__age") <= ttl_minutes).withColumn("turn", F.row_number().over(W.partitionBy(by).orderBy(ts)).cast("long")).where(F.col("turn") <= max_turns).drop("__age")


def body_dedup(rows: DataFrame, by: list[str], body: Column, order: list[str]) -> DataFrame:
    """Each row with ``seen``: whether an earlier row of the session has the same body."""
    w = W.partitionBy(*by, "h").orderBy(*order)
    return rows.withColumn("h", F.sha2(body, 256)).withColumn("seen", F.row_number().over(w) > 1)


def range_dedup(rows: DataFrame, by: list[str], first: str, last: str, order: str, share: float = 0.8) -> DataFrame:
    """Ranges of which no earlier range of the same group covers ``share`` (over one half) or more.

    What covers over half of a range holds its middle; of equal ranges of a group only the earliest is looked at.
    """
    if share <= 0.5:
        raise ValueError("share must be over one half")
    points = rows.withColumn("__middle", F.floor((F.col(first) + F.col(last)) / 2).cast("long"))
    earliest = rows.groupBy(*by, F.col(first).alias("__first"), F.col(last).alias("__last")).agg(F.min(order).alias("__order"))
    held = intervals.containing(points, earliest, by, "__middle", "__first", "__last").where(F.col("__order") < F.col(order))
    covered = held.where(intervals.overlap(F.col(first), F.col(last), F.col("__first"), F.col("__last")) >= share)
    return rows.join(covered.select(order).distinct(), order, "left_anti")


def gate(events: DataFrame, by: str, order: str, is_search: Column, is_gated: Column, searches: int = 2, denials: int = 3) -> DataFrame:
    """Gated events are denied until a session has ``searches`` searches or ``denials`` gated events before."""
    before = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    n = F.coalesce(F.sum(is_search.cast("long")).over(before), F.lit(0))
    tries = F.coalesce(F.sum((is_gated & ~is_search).cast("long")).over(before), F.lit(0))
    return events.withColumn("denied", is_gated & (n < searches) & (tries < denials))


def loops(events: DataFrame, by: str, key: str, order: str, repeats: int = 3) -> DataFrame:
    """Events that repeat an earlier key of the session for the ``repeats``-th time or later."""
    w = W.partitionBy(by, key).orderBy(order)
    return events.withColumn("times", F.row_number().over(w).cast("long")).withColumn("broken", F.col("times") >= repeats)


def history_stub(rows: DataFrame, by: str, order: str, text: str, keep: int = 5, over: int = 600) -> DataFrame:
    """Long outputs but for the last ``keep`` become stubs."""
    long = F.length(text) > over
    back = F.sum(long.cast("long")).over(W.partitionBy(by).orderBy(F.desc(order)))
    return rows.withColumn("stub", long & (back > keep)).withColumn(text, F.when(F.col("stub"), F.concat(F.lit("["), F.length(text).cast("string"), F.lit(" chars]"))).otherwise(F.col(text)))


def queue_batch(rows: DataFrame, key: str, order: list[str], batch: int = 10) -> DataFrame:
    """The first rows of a work queue of which each key's last entry counts; the rest stays for later."""
    return latest_of(rows, [key], order).orderBy(*order, key).limit(batch)
