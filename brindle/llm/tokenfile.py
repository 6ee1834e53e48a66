"""Operator 3: token ids as Parquet list columns.

A written table has one row a document: metadata columns, ``n_tokens`` and ``token_ids`` (list of int32). Ids are
dictionary-encoded, or delta-encoded with the second page version; metadata stay dictionary-encoded. Row groups and
pages have set sizes, and rows of a file are sorted by document, so that the page indexes of ``doc_id`` and ``n_tokens``
let a reader of some documents skip the ids' other pages, and a reader of metadata never touches the ids.

Encoding is one Arrow pass without a shuffle. Files are committed by Spark's protocol, so that a lost executor leaves
no partial file behind.

Defined results
  null text                  null list and null count
  empty text                 empty list, 0
  null or repeated doc_id    kept as they are, nulls first in their file
  no document                a table without rows
  extra columns              only those named as metadata are written; a name that clashes with the table's own is an error
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import bytewords as bw
from brindle.llm import tokens

ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 1 << 18, 1000
OWN = ("doc_id", "n_tokens", "token_ids")


def _encoder(shared):
    """Batches of metadata and, last, text to batches of metadata, number of ids and ids; one small batch for each slice of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, at = batch.schema.names[:-1], 0
            for part in bw.row_slices(batch.column(batch.num_columns - 1), tokens.SLICE):
                ids, bounds = tokens.encode(part, shared.value)
                none = part.is_null()
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=none)
                counts = pa.array(np.diff(bounds).astype(np.int32), mask=np.asarray(none))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(part)).columns[:-1], counts, lists], [*names, "n_tokens", "token_ids"])
                at += len(part)

    return run


def writer_options(encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> dict[str, str]:
    """Parquet settings of a token table. encoding: ``dictionary`` or ``delta`` for the ids."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be 'dictionary' or 'delta', not {encoding!r}")
    own = {} if encoding == "dictionary" else {"parquet.writer.version": "v2", "parquet.enable.dictionary#token_ids.list.element": "false"}
    return own | {
        "compression": "zstd", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows),
        "parquet.column.index.access": "true",
    }


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", metadata: Sequence[str] = (), *, vocabulary: str = tokens.VOCABULARY, **layout) -> None:
    """Write the token table of ``docs`` to ``path``; see ``writer_options`` for the layout."""
    if clash := set(metadata) & set(OWN):
        raise ValueError(f"metadata columns {sorted(clash)} clash with the token table's own")
    rows = docs.select(F.col(id_col).alias("doc_id"), *(F.col(f"`{c}`") for c in metadata), F.col(text_col).cast("string").alias("__text"))
    kinds = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.IntegerType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    made = rows.mapInArrow(_encoder(tokens.broadcast_vocabulary(docs.sparkSession, vocabulary)), kinds)
    made.sortWithinPartitions("doc_id").write.options(**writer_options(**layout)).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Everything but the ids, whose column chunks aren't read."""
    return spark.read.parquet(path).drop("token_ids")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """``(doc_id, token_ids)``, of documents from ``low`` to ``high`` where given; page indexes skip the other pages."""
    table = spark.read.parquet(path).select("doc_id", "token_ids")
    for bound, condition in ((low, F.col("doc_id") >= F.lit(low)), (high, F.col("doc_id") <= F.lit(high))):
        table = table if bound is None else table.where(condition)
    return table


def decode_column(spark: SparkSession, vocabulary: str = tokens.VOCABULARY):
    """A Column function: a list of ids back to its text."""
    shared = tokens.broadcast_vocabulary(spark, vocabulary)

    def run(lists: pa.Array) -> pa.Array:
        own = tokens.encoder(shared.value)
        return pa.array([None if x is None else own.decode(x, errors="strict") for x in lists.to_pylist()], pa.string())

    return F.arrow_udf(run, "string").asNondeterministic()
