"""What loads and saves measured, and how measures of several workers add up."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class SaveMetrics:
    """Seconds of waiting are taken from the slowest worker, seconds of binding and counts are summed, totals stay."""

    rows: int = 0
    batches: int = 0
    workers: int = 1
    bind_seconds: float = 0.0
    write_seconds: float = 0.0
    flush_seconds: float = 0.0
    connect_seconds: float = 0.0
    total_seconds: float = 0.0

    def merge(self, other: SaveMetrics) -> SaveMetrics:
        summed, largest = ("rows", "batches", "bind_seconds"), ("write_seconds", "flush_seconds")
        own = {n: getattr(self, n) + getattr(other, n) for n in summed} | {n: max(getattr(self, n), getattr(other, n)) for n in largest}
        return SaveMetrics(**asdict(self) | own)

    def to_dict(self) -> dict:
        return asdict(self) | {"rows_per_second": self.rows / self.total_seconds if self.total_seconds else 0.0}


@dataclass
class LoadMetrics:
    """Seconds are taken from the slowest worker, rows and blocks are summed."""

    rows: int = 0
    blocks: int = 0
    workers: int = 1
    total_seconds: float = 0.0

    def merge(self, other: LoadMetrics) -> LoadMetrics:
        return LoadMetrics(self.rows + other.rows, self.blocks + other.blocks, self.workers, max(self.total_seconds, other.total_seconds))


def merged(table: DataFrame, group: list[str], seconds: list[str], counts: list[str]) -> DataFrame:
    """Metrics of many workers as rows, put together: the slowest one's seconds and the sums of counts."""
    return table.groupBy(*group).agg(*(F.max(c).alias(c) for c in seconds), *(F.sum(c).alias(c) for c in counts))


def snapshot(table: DataFrame, phase: str, seconds: str) -> DataFrame:
    """Seconds summed by phase."""
    return table.groupBy(phase).agg(F.sum(seconds).alias(seconds))


def field_names(kind: type) -> list[str]:
    return [f.name for f in fields(kind)]


def rate(rows: Column, seconds: Column) -> Column:
    """Rows a second, null where no time was measured."""
    return F.when(seconds > 0, rows / seconds)
