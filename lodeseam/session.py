"""Session helpers that every part of the library shares."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Paths of our own making, by the scope that they end with; the first lasts as long as the process.
_scopes: list[list[str]] = [[]]


def build_session(app: str = "lodeseam", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    Workers import functions by name, so a worker on another machine needs the package even where it was
    never installed.  The archive holds source files only.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="lodeseam-"), "lodeseam_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lodeseam", os.path.relpath(full, here)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where driver and executors are one process (tests, one machine) is a folder of our own taken.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or "file:///tmp/checkpoints/lodeseam").rstrip("/")


def scratch(spark: SparkSession, name: str, *, lasting: bool = False) -> str:
    """A new path below the shared folder; deleted with its scope, or when the process ends, unless it is lasting."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not lasting:
        _scopes[-1].append(path)
    return path


def persisted(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives lost executors."""
    return _written(spark, df, scratch(spark, name))


def _written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of ``persisted`` that nothing reads any more, such as that of the round before the last."""
    path = df._scratch_path
    for paths in _scopes:
        if path in paths:
            paths.remove(path)
    _delete([path])


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes at its end what ``persisted`` and ``scratch`` made inside.

    Gives a function like ``persisted`` for the tables that outlive the scope: they belong to the scope around it.
    """
    _scopes.append([])
    outer = _scopes[-2]

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name, lasting=True)
        outer.append(path)
        return _written(spark, df, path)

    try:
        yield keep
    finally:
        _delete(_scopes.pop())


def _delete(paths: list[str]) -> None:
    jvm = SparkContext._jvm
    conf = jvm.org.apache.hadoop.conf.Configuration() if SparkContext._active_spark_context is None else SparkContext._active_spark_context._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _delete_rest() -> None:
    """What no scope held; a best effort, as Spark may be gone by then."""
    with suppress(Exception):
        for paths in _scopes:
            _delete(paths)


def scanned_bytes(df: DataFrame) -> int:
    """The size of the one table that a plan scans; 0 where it is another plan, or the size isn't known."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    return size if plan.collectLeaves().size() == 1 and size < 1 << 60 else 0


def spread(df: DataFrame, key: str, least: int = 8 << 20) -> DataFrame:
    """A small table, of less than ``least`` bytes a core, dealt to all cores before much is done with its rows.

    Such a table may be one row group, which one task would read and work on; a larger one has splits enough and is
    not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 0 < scanned_bytes(df) < least * cores else df


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Long texts: no more rows in an Arrow batch than this for the session's Python workers; never raises a bound.

    A plan takes the setting when it runs, so it can't be set back before a lazy result is read.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))
