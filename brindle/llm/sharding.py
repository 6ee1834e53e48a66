"""Operator 6: sharding by extendible hashing.

A directory maps prefixes of a document's hash to shards. It starts with one bucket of depth 0; a bucket above the byte
limit splits on its next hash bit, others stay as they are, until every shard fits. So a shard is a hash prefix, and
adding rows only ever splits the buckets that overflow.

Splitting goes in rounds of STEP bits: one pass sums bytes by the next STEP bits within the buckets that are still too
large, and every such bucket's subtree, at most 2**STEP sums, is settled in a task of its own. Texts don't move until
they are written; the directory comes back to the documents by one join for each depth that a shard has, on the prefix of
that depth, broadcast where it is small. Shards of like-sized documents have two or three depths. A hash is the first
15 hex digits of an MD5 of doc_id, so that any SQL engine agrees on it.

Defined results
  null text                  0 bytes; the row has a shard like any other
  null doc_id                hashed by the text instead, so that such rows spread like others; null texts among them like an empty string
  repeated doc_ids           always share a shard
  a shard that can't split   one hash with more than the limit: it stays one shard, at depth MAX_BITS, which several tasks write
  no document                no row, an empty directory
  extra or clashing columns  not read by ``assign``
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.plans.scratch import TASK_BYTES, materialize, scope

SHARD_BYTES, STEP, MAX_BITS = 64 << 20, 10, 60
DIRECTORY_TYPE = "prefix bigint, depth int, bytes bigint, rows bigint, open boolean"


def hash_bits(key: Column, text: Column) -> Column:
    """MAX_BITS bits of hash; the text's where there is no key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), text.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _prefix(bits: Column, depth: int) -> Column:
    return F.shiftright(bits, MAX_BITS - depth)


def _start(prefix: str, depth: str) -> Column:
    """The least hash that a prefix holds."""
    return F.call_function("shiftleft", F.col(prefix), F.lit(MAX_BITS) - F.col(depth))


def _settle(depth: int, limit: int):
    """Leaves of one bucket's subtree of STEP levels from the sums at its end."""

    def run(cells: pa.Table) -> pa.Table:
        width = 1 << STEP
        start = cells.column("parent")[0].as_py() << STEP
        at = cells.column("cell").to_numpy() - start
        size, rows = np.zeros(width, np.int64), np.zeros(width, np.int64)
        size[at], rows[at] = cells.column("bytes").to_numpy(), cells.column("rows").to_numpy()
        out, todo = [], [(0, width, 0)]
        while todo:
            a, b, level = todo.pop()
            total, n = int(size[a:b].sum()), int(rows[a:b].sum())
            if n and (total <= limit or level == STEP):
                out.append(((start + a) >> (STEP - level), depth + level, total, n, total > limit and depth + level < MAX_BITS))
            elif n:
                middle = (a + b) // 2
                todo += [(middle, b, level + 1), (a, middle, level + 1)]
        columns = list(zip(*out))
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()))], ["prefix", "depth", "bytes", "rows", "open"])

    return run


def directory(sizes: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``(prefix, depth, bytes, rows)`` of every shard. sizes: ``(bits, bytes)``, one row a document."""
    left, leaves = sizes, None
    for depth in range(0, MAX_BITS, STEP):
        cells = left.groupBy(_prefix(F.col("bits"), depth + STEP).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        cells = cells.withColumn("parent", F.shiftright("cell", STEP))
        found = materialize(cells.groupBy("parent").applyInArrow(_settle(depth, limit), DIRECTORY_TYPE), "directory")
        done = found.where("NOT open").drop("open")
        leaves = done if leaves is None else leaves.unionByName(done)
        if not found.where("open").take(1):
            break
        over = found.where("open").select(F.col("prefix").alias("__over"))
        left = sizes.join(over, _prefix(F.col("bits"), depth + STEP) == F.col("__over"), "left_semi")
    return leaves


def _sized(docs: DataFrame, id_col: str, text_col: str, *columns: Column) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(*columns, F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"), hash_bits(F.col(f"`{id_col}`"), text).alias("bits"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limit: int = SHARD_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, shard, depth)`` of every row; ``shard`` is the bucket's prefix as an integer of ``depth`` bits."""
    sizes = materialize(_sized(docs, id_col, text_col, F.col(id_col).alias("doc_id")), "sizes")
    return placed(sizes, directory(sizes, limit).select("prefix", "depth")).select("doc_id", F.col("bytes").alias("n_bytes"), "shard", "depth")


def placed(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows with ``bits`` and the ``shard`` and ``depth`` that hold them, and more columns of ``shards``: an equi-join for each depth there is."""
    shards = materialize(shards.select(F.col("prefix").alias("shard"), *(c for c in shards.columns if c != "prefix")), "shards")
    out = rows
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect())
    for d in depths:
        own = shards.where(F.col("depth") == d).select(F.col("shard").alias(f"__prefix{d}"), F.struct(*shards.columns).alias(f"__in{d}"))
        out = out.join(own, _prefix(F.col("bits"), d) == F.col(f"__prefix{d}"), "left")
    which = F.coalesce(*(F.col(f"__in{d}") for d in depths)) if depths else F.lit(None).cast(shards.schema.simpleString())
    return out.select(*rows.columns, which.alias("__in")).select(*rows.columns, *(F.col(f"__in.{c}") for c in shards.columns))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = SHARD_BYTES) -> None:
    """Write the documents, one folder ``__shard=depth-shard`` a shard, each that fits the limit by one task; columns unchanged but for the folder's key."""
    with scope(docs.sparkSession):
        sizes = materialize(_sized(docs, id_col, text_col), "sizes")
        shards = materialize(directory(sizes, limit), "directory")
        # neighbouring shards share a task up to TASK_BYTES: a shard is a number of bytes, so even at 100 TB one task can number them
        before = F.sum("bytes").over(Window.orderBy(_start("prefix", "depth"))) - F.col("bytes")
        width = F.ceil(F.col("bytes") / max(limit, TASK_BYTES)).cast("int")
        shards = materialize(shards.select("prefix", "depth", F.floor(before / TASK_BYTES).cast("int").alias("task"), F.greatest(width, F.lit(1)).alias("width")), "tasks")
        row = _sized(docs, id_col, text_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
        out = placed(row, shards).withColumn("__shard", F.concat_ws("-", "depth", "shard"))
        tasks = shards.agg(F.max(F.col("task") + F.col("width"))).first()[0]
        own = F.col("task") + F.pmod(F.xxhash64("bytes", F.col(f"__row.`{text_col}`").cast("string")), F.col("width")).cast("int")
        out.repartitionById(tasks or 1, own).select("__row.*", "__shard").write.partitionBy("__shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """The written documents, of the columns they were written with, and the ``shard`` and ``depth`` that their folder names."""
    found = spark.read.schema(T.StructType([*columns.fields, T.StructField("__shard", T.StringType())])).parquet(path)
    part = lambda k: F.split_part("__shard", F.lit("-"), F.lit(k))
    return found.select(*(F.col(f"`{c}`") for c in columns.names), part(2).cast("bigint").alias("shard"), part(1).cast("int").alias("depth"))


def sql(table: str = "documents", limit: int = SHARD_BYTES) -> str:
    """``assign`` in DuckDB's SQL: a row's depth is the least one at which its prefix fits."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS bits FROM {table}),
p AS (SELECT depth, bits >> ({MAX_BITS} - depth) AS prefix, sum(n_bytes) AS total FROM d, range(0, {MAX_BITS + 1}) r(depth) GROUP BY ALL),
f AS (SELECT d.bits, min(p.depth) AS depth FROM (SELECT DISTINCT bits FROM d) d, p WHERE p.prefix = d.bits >> ({MAX_BITS} - p.depth) AND (p.total <= {limit} OR p.depth = {MAX_BITS}) GROUP BY ALL)
SELECT doc_id, n_bytes, (d.bits >> ({MAX_BITS} - depth)::INT)::BIGINT AS shard, depth::INTEGER AS depth FROM d JOIN f USING (bits)"""
