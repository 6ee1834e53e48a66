"""Shared scratch tables.

Long plans cut their lineage by writing Parquet into a folder that every executor can reach, so that losing an executor
never costs more than the tasks it ran. The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where
that is unset and the master is this machine (tests, a laptop) a temporary folder of the driver is used and set for the
application; on a cluster a folder that is missing is an error, since executors don't share the driver's disk.

Tables made within a ``scope`` are deleted at its end; the application's folder goes when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: What one task should take, at most and at least, of a table whose tasks are numbered by its bytes.
TASK_BYTES, LEAST_BYTES = 64 << 20, 1 << 20
_open = threading.local()
_swept: set[str] = set()


def _java_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The application's folder for scratch tables, below ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        own = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    if path not in _swept:
        _swept.add(path)
        p, fs = _java_path(spark, path)
        atexit.register(_sweep, fs, p)
    return path


def _sweep(fs, path) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before; nothing is left to do then
        fs.delete(path, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own for a scratch table; nothing lies there yet."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if getattr(_open, "scopes", None):
        _open.scopes[-1].append(path)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the scratch tables made within at its end. Gives their list, for ``hand_on``."""
    scopes = _open.__dict__.setdefault("scopes", [])
    made: list[str] = []
    scopes.append(made)
    try:
        yield made
    finally:
        scopes.pop()
        for path in made:
            remove(spark, path)


def hand_on(made: list[str], last: int) -> None:
    """The scope's ``last`` tables stay when it ends; they belong to the scope around it, if there is one."""
    if len(_open.scopes) > 1:
        _open.scopes[-2] += made[-last:]
    del made[-last:]


def settled(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions that take a DataFrame first and return one: the result is written, the scratch tables it was made of are deleted."""

    @functools.wraps(function)
    def run(df: DataFrame, *args, **how) -> DataFrame:
        with scope(df.sparkSession) as made:
            found = function(df, *args, **how)
            path = write(found, function.__name__.strip("_"))
            hand_on(made, 1)
            return df.sparkSession.read.schema(found.schema).parquet(path)

    return run


def write(df: DataFrame, label: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` once into the shared folder; the path."""
    path = new_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and return a scan of the written table.

    Unlike a cached plan the table outlives executors, and its size is known from the files, so that the planner
    broadcasts it below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it above.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write(df, label, partition_by))


def tasks_for(spark: SparkSession, n_bytes: int, each: int = TASK_BYTES) -> int:
    """How many tasks a shuffle of so many bytes should have: as the session says, fewer where they would have next to nothing to do, more where they would grow too large."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(usual, -(-n_bytes // LEAST_BYTES)), -(-n_bytes // each))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no plan reads any more."""
    p, fs = _java_path(spark, path)
    fs.delete(p, True)


def materialize_by(df: DataFrame, label: str, key: str, only: DataFrame, n_bytes: int = 0) -> DataFrame:
    """As ``materialize``, of the rows whose key is in ``only``, in buckets of ``key``: joins on it shuffle the other side alone.

    ``n_bytes``, what is about to be written, says how many buckets there are, each written by one task. ``df`` is
    shuffled once, before the join with the keys of ``only``, which then takes place within the buckets.
    """
    spark = df.sparkSession
    n = tasks_for(spark, n_bytes)
    name = f"{label}_{uuid.uuid4().hex}"
    # not a semi-join, which the optimizer would move below the repartition, so that rows were shuffled for it and once more
    laid = df.repartition(n, key).join(only.select(key).distinct(), key)
    laid.write.bucketBy(n, key).option("compression", "zstd").option("path", new_path(spark, label)).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry only: the analysed table keeps its files and buckets
    return table
