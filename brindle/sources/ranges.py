"""Reading a table in closed ranges of an integer key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Range:
    worker: int
    low: int
    high: int


def plan_ranges(low: int, high: int, workers: int) -> list[Range]:
    """At most ``workers`` closed ranges that cover ``low`` to ``high``; the last takes the rest. No range if high < low."""
    size = high - low + 1
    if size <= 0:
        return []
    workers = max(1, min(workers, size))
    chunk = max(1, size // workers)
    return [Range(w, low + w * chunk, high if w == workers - 1 else low + (w + 1) * chunk - 1) for w in range(workers)]


def bounds(table: DataFrame, key: str) -> tuple[int, int]:
    """Least and greatest key; ``(0, -1)`` if there is none."""
    low, high = table.agg(F.min(key), F.max(key)).first()
    return (0, -1) if low is None else (int(low), int(high))


def partition_bounds(table: DataFrame, key: str) -> DataFrame:
    return table.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))


def worker_of(key: Column, low: int, high: int, workers: int) -> Column:
    """Which of the ranges holds a key, by arithmetic; null for a null key."""
    n = len(plan_ranges(low, high, workers))
    chunk = max(1, (high - low + 1) // n) if n else 1
    # whole numbers throughout: doubles would move keys beyond 2 ** 53 to a neighbour
    above = key.cast("decimal(20,0)") - F.lit(str(low)).cast("decimal(20,0)")
    return F.when(key.isNotNull(), F.least(F.call_function("div", above, F.lit(str(chunk)).cast("decimal(20,0)")), F.lit(max(0, n - 1)).cast("bigint")))


def predicates(quoted: str, ranges: list[Range], nulls: bool = True) -> list[str]:
    """SQL conditions, one a range, for a partitioned JDBC read. Rows without a key go with the first. quoted: the key as the database quotes it."""
    out = [f"{quoted} >= {r.low} AND {quoted} <= {r.high}" for r in ranges]
    if nulls and out:
        out[0] = f"({out[0]}) OR {quoted} IS NULL"
    return out


def range_partitioned(table: DataFrame, key: str, workers: int) -> DataFrame:
    """All rows of the table by a shuffle, one partition a range of the key, rows without a key in the first."""
    low, high = bounds(table, key)
    n = max(1, len(plan_ranges(low, high, workers)))
    return table.repartitionById(n, F.coalesce(worker_of(F.col(key), low, high, workers), F.lit(0)).cast("int")) if hasattr(table, "repartitionById") else table.repartitionByRange(n, F.col(key).asc_nulls_first())


def detect_key(schema: T.StructType, primary_key: list[str]) -> str | None:
    """The first integer column of a primary key, which is listed in its own order."""
    kinds = {f.name: f.dataType for f in schema.fields}
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return next((c for c in primary_key if isinstance(kinds.get(c), whole)), None)


def slices(table: DataFrame, n: int, column: str = "slice") -> DataFrame:
    """The rows with the number, from 0, of the one of ``n`` contiguous slices of the table that holds them; slices differ by a row at most.

    Rows are counted by partition first, and only these counts come to the driver. The table must give its rows in the same order twice, as scans do.
    """
    if n < 1:
        raise ValueError(f"there must be at least one slice, not {n}")
    placed = table.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    counts = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())
    before, starts = 0, {}
    for part, many in counts:
        starts[part], before = before, before + many
    start = F.element_at(F.create_map(*(F.lit(x) for pair in starts.items() for x in pair)), F.col("__part")) if starts else F.lit(0)
    index = (F.col("__at") + start).cast("decimal(20,0)")
    return placed.withColumn(column, F.call_function("div", index * n, F.lit(max(1, before)).cast("decimal(20,0)")).cast("int")).drop("__part", "__at")
