"""Sets of paths as one-column DataFrames: each path once, ordered only where asked for.

``+`` is the union and ``-`` the difference; ``&`` and ``|`` with a filter both keep the paths that pass it, as a lazy
query to which more filters can be added.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import paths as P
from brindle.plans.scratch import materialize


class PathSet:
    """An immutable set of paths."""

    def __init__(self, frame: DataFrame):
        self.frame = frame.select(F.col(frame.columns[0]).cast("string").alias("path")).where("path IS NOT NULL").distinct()

    @classmethod
    def of(cls, spark: SparkSession, paths: Iterable[str]) -> PathSet:
        return cls(spark.createDataFrame([(os.fspath(p),) for p in paths], "path string"))

    @classmethod
    def listing(cls, spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> PathSet:
        """Files of a folder, by Spark's own parallel listing; contents aren't read."""
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
        return cls(files.select(F.regexp_replace("path", "^file:/+", "/")))

    @classmethod
    def iterdir(cls, spark: SparkSession, folder: str) -> PathSet:
        """What lies in a folder: files and folders, hidden ones too."""
        return cls(_children(spark.createDataFrame([(os.fspath(folder),)], "path string")))

    @classmethod
    def glob(cls, spark: SparkSession, folder: str, pattern: str) -> PathSet:
        """Files and folders below one by a relative pattern: ``*`` and ``?`` within a component, ``**`` for any number of folders, or, last, for all that is below.

        Folders are listed level by level, those of one level by as many tasks as there are; what can't be listed is passed over. Links to folders are followed by name, not by ``**``.
        """
        segments = [x for x in pattern.split("/") if x]
        if not segments or pattern.startswith("/"):
            raise ValueError(f"the pattern must be relative and not empty, but is {pattern!r}")
        here = spark.createDataFrame([(os.fspath(folder),)], "path string")
        for k, segment in enumerate(segments):
            last = k + 1 == len(segments)
            if segment == "**":
                below = _descendants(here)
                here = below.select("path") if last else here.union(below.where("folder").select("path")).distinct()
            else:
                found = _children(here).where(P.match_segment(segment, P.name("path")))
                here = found.select("path") if last else found.where("folder OR linked").select("path")
        return cls(here)

    @classmethod
    def rglob(cls, spark: SparkSession, folder: str, pattern: str) -> PathSet:
        """The pattern anywhere below a folder."""
        return cls.glob(spark, folder, f"**/{pattern}")

    def __add__(self, other: PathSet) -> PathSet:
        return PathSet(self.frame.union(other.frame))

    def __sub__(self, other: PathSet | str) -> PathSet:
        return PathSet(self.frame.where(F.col("path") != other) if isinstance(other, str) else self.frame.join(other.frame, "path", "left_anti"))

    def __and__(self, keep: Column) -> PathQuery:
        return PathQuery(self, keep)

    __or__ = __and__

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, PathSet):
            return NotImplemented
        both = self.frame.withColumn("l", F.lit(1)).join(other.frame.withColumn("r", F.lit(1)), "path", "full_outer")
        return both.where("l IS NULL OR r IS NULL").isEmpty()

    __hash__ = None

    def __contains__(self, path: str) -> bool:
        return not self.frame.where(F.col("path") == path).isEmpty()

    def __len__(self) -> int:
        return self.frame.count()

    def __bool__(self) -> bool:
        return not self.frame.isEmpty()

    def __iter__(self) -> Iterator[str]:
        return (r[0] for r in self.sorted().toLocalIterator())

    def clone(self) -> PathSet:
        return PathSet(self.frame)

    def sorted(self) -> DataFrame:
        return self.frame.orderBy("path")

    def read_all_files(self) -> DataFrame:
        """``(path, content)`` of the regular files among the paths, in the paths' order; each task opens its own."""
        from brindle.sources.documents import read_bytes

        return read_bytes(self.frame).where("content IS NOT NULL").orderBy("path")


def _children(folders: DataFrame) -> DataFrame:
    """``(path, folder, linked)`` of what lies in the folders: whether it is one, and whether it is a link to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base in batch.column(0).to_pylist():
                rows = []
                try:
                    with os.scandir(base) as entries:
                        for e in entries:
                            own = e.is_dir(follow_symlinks=False)
                            rows.append((e.path, own, not own and e.is_dir()))
                except OSError:
                    pass
                columns = list(zip(*rows)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.bool_()))], ["path", "folder", "linked"])

    return folders.select("path").mapInArrow(run, "path string, folder boolean, linked boolean")


def _descendants(folders: DataFrame) -> DataFrame:
    """All that is below the folders, level by level; each level is written, and its folders are spread over tasks by their number."""
    spark, levels, here = folders.sparkSession, None, folders
    while True:
        level = materialize(_children(here), "level")
        levels = level if levels is None else levels.union(level)
        here = level.where("folder").select("path")
        n = here.count()
        if not n:
            return levels
        here = here.repartition(min(n, 16 * spark.sparkContext.defaultParallelism))


class PathQuery:
    """Paths of a set that pass a filter; nothing runs before ``eval`` or iteration."""

    def __init__(self, source: PathSet, keep: Column):
        self.source, self.keep = source, keep

    def __and__(self, more: Column) -> PathQuery:
        return PathQuery(self.source, self.keep & more)

    def __or__(self, more: Column) -> PathQuery:
        return PathQuery(self.source, self.keep | more)

    def eval(self) -> PathSet:
        return PathSet(self.source.frame.where(self.keep))

    def __iter__(self) -> Iterator[str]:
        return iter(self.eval())


def ext(wanted: str) -> Column:
    """A filter: paths whose suffix is just ``wanted``."""
    return P.ext("path", wanted)


def matches(pattern: str) -> Column:
    """A filter: paths whose name matches a glob pattern."""
    return P.match_pattern(pattern, P.name("path"))
