"""Connected components of an edge table by alternating large-star and small-star steps.

Every round is a few shuffles over the edges and ends in a written table, so lineage stays short. The number of rounds
grows with the logarithm of the component size. A vertex's least neighbour is found by an aggregate that combines before
the shuffle and comes back by a join, in which adaptive execution splits a hot vertex's edges; so no vertex, however many
edges it has, has them all sent to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.plans.scratch import materialize, settled


FEW = 200_000


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node's least node, of all edges."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = top(u), top(v)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "label"])


def _with_least(e: DataFrame) -> DataFrame:
    """Edges with ``m``, the least end of all edges of their ``u``, itself included."""
    return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = _with_least(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    hang = down.select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
    return hang.where("u != v").distinct()


@settled
def components(edges: DataFrame, a: str, b: str, few: int | None = None) -> DataFrame:
    """``(node, label)`` for every node of an edge, a whole number; label is the least node of its component.

    Null ends and self-loops are dropped; repeated edges count once; an empty edge table gives an empty result. Nodes
    that are their component's least are listed with themselves as label.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if e.count() <= (FEW if few is None else few):
        return e.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).coalesce(1).mapInArrow(_settle, "node bigint, label bigint")
    state = None
    while True:
        e = materialize(_small_star(materialize(_large_star(e), "edges")), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(nodes.select(F.col("label").alias("node"), "label").distinct())
