"""A store of tables: a folder of Parquet, or a database reached by JDBC.

``load`` gives a DataFrame for a table's name, SQL text or a Query; nothing is read before an action. ``save`` appends a
frame to a table through Spark's commit protocol and returns counts and times.
"""

from __future__ import annotations

import enum
import os
import re
import time
from collections.abc import Callable, Iterable

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from brindle.metrics import LoadMetrics, SaveMetrics
from brindle.sources import ranges
from brindle.sources.query import Query, from_tsql, qualified, sortable, split_name, split_with
from brindle.sources.sqltypes import custom_schema


class StoreError(RuntimeError):
    """Loading or saving failed."""


class Format(enum.Enum):
    SPARK, PANDAS, ARROW = "spark", "pandas", "arrow"

    @classmethod
    def of(cls, value: str | Format) -> Format:
        try:
            return value if isinstance(value, Format) else cls(value.lower())
        except ValueError:
            raise ValueError(f"unknown format {value!r}; there are {', '.join(f.value for f in cls)}") from None


def to_frame(spark: SparkSession, data) -> DataFrame:
    """A DataFrame of a DataFrame, Arrow table or batches, pandas frame, or whatever exports an Arrow stream."""
    if isinstance(data, DataFrame):
        return data
    if hasattr(data, "__arrow_c_stream__") and not isinstance(data, pa.Table):
        data = pa.table(data)
    elif isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    elif not isinstance(data, pa.Table) and hasattr(data, "to_arrow"):
        data = data.to_arrow()
    if isinstance(data, pa.Table):
        return spark.createDataFrame(_signed(data))
    if hasattr(data, "iloc"):
        return spark.createDataFrame(data)
    raise TypeError(f"can't make a table of {type(data).__name__}")


_WIDER = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}


def _signed(table: pa.Table) -> pa.Table:
    """Unsigned columns as the next wider signed ones, which Spark has."""
    return table.cast(pa.schema([f.with_type(_WIDER.get(f.type, f.type)) for f in table.schema]))


def _names(session: SparkSession) -> list[str]:
    """The temporary views of a session, which would hide tables of the store."""
    return [t.name for t in session.catalog.listTables() if t.isTemporary]


def _relations(java, text: str) -> list[str]:
    """Names of one part that the parsed statement reads, subqueries included; some may be its own common table expressions'."""
    try:
        plan = java.sessionState().sqlParser().parsePlan(text)
    except Exception:  # running the statement says what is wrong with it
        return []
    return re.findall(r"'UnresolvedRelation \[([^\],]+)\]", plan.toString())


def _seconds(text: str) -> float:
    """The total of a timing metric as Spark writes it, such as ``12 ms`` or, below a line of headings, ``1.2 s (...)``."""
    found = re.search(r"([\d.,]+)\s*(ms|s|m|min|h)\b", text.splitlines()[-1]) if text else None
    return float(found[1].replace(",", "")) * {"ms": 1e-3, "s": 1.0, "m": 60.0, "min": 60.0, "h": 3600.0}[found[2]] if found else 0.0


def _chain(failure: BaseException):
    """The database's own exceptions behind a failure, each with those chained to it."""
    java, seen = getattr(failure, "java_exception", None) or getattr(failure, "_origin", None), 0
    while java is not None and seen < 10:
        if hasattr(java, "getSQLState") and "SQLException" in java.getClass().getName() or java.getClass().getName().startswith("java.sql"):
            nested = java
            while nested is not None and seen < 10:
                seen += 1
                yield nested.getSQLState(), nested.getMessage()
                nested = nested.getNextException()
            return
        java, seen = java.getCause(), seen + 1


def said(failure: BaseException) -> str:
    """A failure's text: up to ten of the database's diagnostics, or what Python has of it."""
    try:
        return "; ".join(f"[{state}] {message}" for state, message in _chain(failure)) or str(failure)
    except (Py4JError, AttributeError, TypeError):
        return str(failure)


def _again(action: Callable):
    """What ``action`` gives; once more if the connection was lost. Tasks are repeated by Spark, this is for the driver's own probes."""
    try:
        return action()
    except Exception as failure:
        lost = "Communication link" in str(failure) or any((state or "")[:2] == "08" for state, _ in _chain(failure))
        if not lost:
            raise
        return action()


class DataStore:
    """Tables below ``location``: a folder with one Parquet folder or file a table, or a ``jdbc:`` URL.

    ``table_hint`` (``TABLOCK``) and ``packet_size`` become connection properties of SQL Server, whose they are; for
    another database, or for files, they are errors. ``column_types`` says of a table's columns what SQL types they have,
    where the driver's answer shouldn't count.
    """

    def __init__(
        self,
        spark: SparkSession,
        location: str,
        format: str | Format = "spark",
        *,
        batch_size: int = 100_000,
        block_size: int = 4096,
        table_hint: str = "",
        packet_size: int | None = None,
        workers: int = 0,
        default_schema: str = "",
        primary_keys: dict[str, list[str]] | None = None,
        column_types: dict[str, dict[str, str]] | None = None,
        options: dict[str, str] | None = None,
    ):
        if block_size <= 0:
            raise ValueError("block_size must be positive")
        self.spark, self.location, self.format = spark, location.rstrip("/"), Format.of(format)
        self.batch_size, self.block_size = (batch_size if batch_size > 0 else 100_000), block_size
        self.workers, self.default_schema = workers, default_schema
        self.primary_keys, self.column_types, self.options = primary_keys or {}, column_types or {}, {**self._hints(table_hint, packet_size), **(options or {})}
        self.last_load = LoadMetrics()
        self._pre: list[Callable] = []
        self._post: list[Callable] = []

    @property
    def is_jdbc(self) -> bool:
        return self.location.startswith("jdbc:")

    @property
    def is_sql_server(self) -> bool:
        return self.location.startswith("jdbc:sqlserver:")

    def _hints(self, table_hint: str, packet_size: int | None) -> dict[str, str]:
        """Connection properties for what only one database has."""
        if not table_hint and packet_size is None:
            return {}
        if not self.is_sql_server:
            raise ValueError("table_hint and packet_size are of SQL Server alone")
        if table_hint and table_hint.upper() != "TABLOCK":
            raise ValueError(f"the only hint that a save takes is TABLOCK, not {table_hint!r}")
        own = {"useBulkCopyForBatchInsert": "true", "bulkCopyForBatchInsertTableLock": "true"} if table_hint else {}
        # a size that the URL has already is the user's own choice
        return own | ({} if packet_size is None or "packetsize=" in self.location.lower() else {"packetSize": str(packet_size)})

    # hooks

    def add_pre_transform(self, hook: Callable) -> None:
        """Run ``hook()`` before every load and save; one that takes a frame gets it before a save and may return another."""
        self._pre.append(hook)

    def add_post_transform(self, hook: Callable) -> None:
        """Run ``hook()`` after every successful load and save; one that takes a frame gets the loaded one and may return another."""
        self._post.append(hook)

    def clear_transforms(self) -> None:
        self._pre.clear()
        self._post.clear()

    @staticmethod
    def _run(hooks: Iterable[Callable], frame=None):
        import inspect

        for hook in hooks:
            takes = any(p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in inspect.signature(hook).parameters.values())
            if not takes:
                hook()
            elif frame is not None and (made := hook(frame)) is not None:
                frame = made
        return frame

    # loading

    def load(self, source: str | Query, load_workers: int = 1, partition_column: str = "", *, sql: str | None = None, table: str | None = None):
        """A table by name, SQL text (a string with a space, or ``sql=``), or a query.

        With ``load_workers`` above one a database's table is read in that many ranges of ``partition_column``, or of the
        table's integer primary key where it is known; projection, condition and limit hold in either case. Files need no
        ranges: Spark splits them by their bytes, and nothing is shuffled or looked up for it.
        """
        began = time.perf_counter()
        self._run(self._pre)
        query = Query.raw(sql) if sql else Query(table) if table else source if isinstance(source, Query) else Query.raw(source) if " " in source else Query(source)
        try:
            frame = self._query(query, load_workers, partition_column)
        except Exception as failure:
            raise StoreError(f"loading {query.raw_sql or query.table!r} failed: {said(failure)}") from failure
        out = self.export(self._run(self._post, frame))
        # a Spark frame is read later, and not by this call
        rows = 0 if self.format is Format.SPARK else len(out)
        self.last_load = LoadMetrics(rows=rows, blocks=-(-rows // self.block_size), workers=max(1, load_workers), total_seconds=time.perf_counter() - began)
        return out

    def _query(self, query: Query, workers: int, column: str) -> DataFrame:
        if query.is_raw():
            return self._sql(query)
        if not self.is_jdbc or workers <= 1:
            return query.apply(self.table(query.table))
        key = column or ranges.detect_key(self.table(query.table).schema, self._primary_key(query.table))
        return query.apply(self._ranged(query.table, key, workers) if key else self.table(query.table))

    def table(self, name: str) -> DataFrame:
        """A scan of the table."""
        if self.is_jdbc:
            reader = self._jdbc().option("dbtable", name)
            return (reader.option("customSchema", custom_schema(self.column_types[name].items())) if name in self.column_types else reader).load()
        path = self._found(name)
        if path:
            return self.spark.read.parquet(path)
        return self.spark.table(".".join(f"`{p}`" for p in split_name(name)))

    def schema(self, name: str):
        return self.table(name).schema

    def empty(self, name: str) -> DataFrame:
        """No row, with the table's columns."""
        return self.table(name).limit(0)

    def _ranged(self, name: str, key: str, workers: int) -> DataFrame:
        table = self.table(name)
        plan = ranges.plan_ranges(*_again(lambda: ranges.bounds(table, key)), workers)
        if not plan:
            return table
        types = {"customSchema": custom_schema(self.column_types[name].items())} if name in self.column_types else {}
        quoted = self.spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.location).quoteIdentifier(key)
        return self.spark.read.jdbc(self.location, name, predicates=ranges.predicates(quoted, plan), properties=self._properties() | types)

    def _sql(self, query: Query) -> DataFrame:
        if self.is_jdbc:
            before, text = split_with(query.raw_sql)
            if self.is_sql_server:
                text = sortable(text)
            reader = self._jdbc().option("query", text)
            return (reader.option("prepareQuery", before) if before else reader).load()
        return self._local_sql(from_tsql(query.raw_sql), query.args)

    def _local_sql(self, text: str, args: dict | None) -> DataFrame:
        """A statement over the folder's tables. Those that it names are made known to a copy of the session, so that no view of the
        user's is replaced and no table is looked at that isn't named; the user's own views, and tables of the catalog, are there
        where the folder has none of that name."""
        java = self.spark._jsparkSession.cloneSession()
        own = SparkSession(self.spark.sparkContext, java)
        known: set[str] = set()

        def register(name: str) -> bool:
            path = None if name in known or "." in name else self._found(name)
            if path:
                own.read.parquet(path).createOrReplaceTempView(f"`{name}`")
                known.add(name)
            return bool(path)

        for table in {*_names(own), *_relations(java, text)}:
            register(table)
        while True:  # for names that the plan's text doesn't show plainly
            try:
                frame = own.sql(text, args=args or None)
                break
            except AnalysisException as missing:
                named = (missing.getMessageParameters() or {}).get("relationName", "") if missing.getCondition() == "TABLE_OR_VIEW_NOT_FOUND" else ""
                if not register(named.strip("`").replace("``", "`")):
                    raise
        # the analysed plan, as a frame of the user's session
        return DataFrame(self.spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, frame._jdf.queryExecution().analyzed()), self.spark)

    def _found(self, name: str) -> str | None:
        """The folder or file that is the table, if there is one."""
        return next((p for p in (self._path(name), f"{self._path(name)}.parquet") if self._exists(p)), None)

    def register_views(self) -> list[str]:
        """Make every table of the folder known to the session's SQL by its name, in place of views of that name; the names."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.location)
        found = []
        for status in root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root):
            name = status.getPath().getName()
            if name.endswith(".parquet") or status.isDirectory() and not name.startswith((".", "_")):
                short = name.removesuffix(".parquet")
                self.spark.read.parquet(status.getPath().toString()).createOrReplaceTempView(f"`{short}`")
                found.append(short)
        return sorted(found)

    def _path(self, name: str) -> str:
        return "/".join([self.location, *split_name(name)])

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _properties(self) -> dict[str, str]:
        return {"fetchsize": str(self.block_size), **self.options}

    def _jdbc(self):
        return self.spark.read.format("jdbc").option("url", self.location).options(**self._properties())

    def _primary_key(self, name: str) -> list[str]:
        if name in self.primary_keys or not self.is_jdbc:
            return self.primary_keys.get(name, [])
        return _again(lambda: self._keys(name))

    def _keys(self, name: str) -> list[str]:
        connection = self.spark.sparkContext._jvm.java.sql.DriverManager.getConnection(self.location)
        try:
            schema, table = (None, name) if "." not in name else split_name(name)[-2:]
            rows, keys = connection.getMetaData().getPrimaryKeys(None, schema, table), []
            while rows.next():
                keys.append((rows.getInt("KEY_SEQ"), rows.getString("COLUMN_NAME")))
            return [c for _, c in sorted(keys)]
        finally:
            connection.close()

    def export(self, frame: DataFrame):
        """The frame in the store's format; only ``spark`` leaves the rows where they are."""
        return {Format.SPARK: lambda: frame, Format.PANDAS: frame.toPandas, Format.ARROW: frame.toArrow}[self.format]()

    # saving

    def save(self, data, table_name: str, workers: int = -1) -> dict:
        """Append ``data`` by position to a table; its metrics. No row is an error that leaves nothing behind, and no table is created in a database."""
        began = time.perf_counter()
        ready = to_frame(self.spark, data) if isinstance(data, DataFrame) else None
        made = self._run(self._pre, ready)  # before the data is looked at
        frame = made if made is not None else to_frame(self.spark, data)
        target = qualified(table_name, self.default_schema)
        prepared = time.perf_counter()
        workers = self.workers if workers < 0 else workers
        if workers == 1:
            frame = frame.coalesce(1)
        elif workers > 1:
            frame = frame.repartition(workers)
        seen = Observation()
        try:
            before = None if self.is_jdbc else self._files(target)
            ready = self._writer(frame.observe(seen, F.count(F.lit(1)).alias("rows")), target)
            connected = time.perf_counter()
            ready()
            rows = seen.get["rows"]
            if not rows and not self.is_jdbc:
                self._undo(target, before)
        except Exception as failure:
            raise StoreError(f"saving to {target} failed: {said(failure)}") from failure
        if not rows:
            raise StoreError(f"nothing to save to {target}: the data has no row")
        done = time.perf_counter()
        self._run(self._post)
        return SaveMetrics(
            rows=rows, batches=-(-rows // self.batch_size), workers=max(1, workers), bind_seconds=prepared - began, connect_seconds=connected - prepared, write_seconds=done - connected, flush_seconds=self._commit_seconds(), total_seconds=done - began
        ).to_dict()

    def _writer(self, frame: DataFrame, target: str) -> Callable[[], None]:
        if self.is_jdbc:
            writer = frame.write.format("jdbc").mode("append").option("url", self.location).option("dbtable", target).option("batchsize", self.batch_size)
            return writer.options(**self.options).save
        path = self._path(target)
        if self._exists(path):
            known = self.spark.read.parquet(path).schema
            if len(known) != len(frame.columns):
                raise ValueError(f"{target} has {len(known)} columns, the data {len(frame.columns)}")
            frame = frame.toDF(*known.names).select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in known))
        return lambda: frame.write.mode("append").parquet(path)

    def _commit_seconds(self) -> float:
        """How long the last write's tasks and job took to commit their files, by Spark's own measures; 0 where it has none."""
        try:
            store = self.spark._jsparkSession.sharedState().statusStore()
            last = store.executionsList().last()
            values, total = store.executionMetrics(last.executionId()), 0.0
            metrics = last.metrics()
            for k in range(metrics.size()):
                m = metrics.apply(k)
                if "commit time" in m.name() and values.contains(m.accumulatorId()):
                    total += _seconds(values.apply(m.accumulatorId()))
            return total
        except Py4JError:
            return 0.0

    def _files(self, target: str) -> set[str] | None:
        """Names of what lies in the table's folder; nothing if there is no folder."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(target))
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else None

    def _undo(self, target: str, before: set[str] | None) -> None:
        """Take away the files without a row that a save of nothing has left, and the folder if it was the first."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(target))
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(p):
            name = status.getPath().getName()
            if name.endswith(".parquet") and name not in (before or ()) and self.spark.read.parquet(status.getPath().toString()).isEmpty():
                fs.delete(status.getPath(), False)
        if before is None and not any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(p)):
            fs.delete(p, True)

    def __repr__(self) -> str:
        return f"DataStore(backend={'jdbc' if self.is_jdbc else 'parquet'}, format={self.format.value}, transforms={len(self._pre)}/{len(self._post)})"


def acquire_datastore(spark: SparkSession, location: str, format: str | Format = "spark", **options) -> DataStore:
    """A store over a folder or a database; see DataStore for the options."""
    if "://" not in location and not location.startswith(("jdbc:", "file:")):
        location = os.path.abspath(location)
    return DataStore(spark, location, format, **options)
