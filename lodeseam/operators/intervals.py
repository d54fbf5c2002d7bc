"""Points in intervals as an equi-join.

An interval goes to the one or two cells of the least power-of-two grid whose cells are as long as it is; a point goes to
its cell of every grid that has an interval.  So an interval makes at most two rows, a point one for each of a few dozen
grids, and a hot group is spread over its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def containing(points: DataFrame, intervals: DataFrame, by: list[str], at: str, first: str, last: str) -> DataFrame:
    """Every point with every interval of its group (columns ``by`` of both) that holds it, both ends included."""
    grid = F.greatest(F.lit(0), F.ceil(F.log2(F.col(last) - F.col(first) + 1))).cast("int")
    whole = intervals.where(F.col(first) <= F.col(last)).withColumn("__grid", grid)
    top = whole.agg(F.max("__grid")).first()[0] or 0
    size = F.pow(F.lit(2.0), F.col("__grid"))
    cell = lambda x: F.floor(x / size).cast("long")
    spread = whole.withColumn("__cell", F.explode(F.array_distinct(F.array(cell(F.col(first)), cell(F.col(last))))))
    probes = points.withColumn("__grid", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("__cell", cell(F.col(at)))
    return probes.join(spread, [*by, "__grid", "__cell"]).where(F.col(at).between(F.col(first), F.col(last))).drop("__grid", "__cell")


def overlap(first: Column, last: Column, other_first: Column, other_last: Column) -> Column:
    """The part of the first interval that the other covers."""
    return F.greatest(F.lit(0), F.least(last, other_last) - F.greatest(first, other_first) + 1) / (last - first + 1)
