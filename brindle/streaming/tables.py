"""A stream appended to a store's table, and a table read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from brindle.sources.query import qualified
from brindle.sources.store import DataStore


def read_stream(store: DataStore, name: str) -> DataFrame:
    """Files added to the table's folder as a stream."""
    return store.spark.readStream.schema(store.schema(name)).parquet(store._path(name))


def save_stream(stream: DataFrame, store: DataStore, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to a table, each row once even if the query is started again with its checkpoint."""
    target = store._path(qualified(name))
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
