"""Queries over the driver's tables that show each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle import more_queries
from brindle.functions import arrays, moments, paths, scalars, units
from brindle.operators import keyed, merge
from brindle.operators.pathset import PathSet, ext
from brindle.plans.scratch import new_path
from brindle.sources import datagen, documents, ranges
from brindle.sources.query import Query, SparkDialect
from brindle.sources.store import DataStore, acquire_datastore

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return keep


def _store(spark: SparkSession, sf_dir: str) -> DataStore:
    return acquire_datastore(spark, sf_dir)


# scans, projection, filter, limit


@_query("SELECT * FROM nation")
def load_table(spark, sf_dir):
    return _store(spark, sf_dir).load("nation")


@_query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def load_filter(spark, sf_dir):
    return _store(spark, sf_dir).load(Query().select("l_orderkey", "l_linenumber", "l_quantity").from_table("lineitem").where("l_quantity > 45"))


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def load_filter_args(spark, sf_dir):
    return _store(spark, sf_dir).load(Query().select("o_orderkey", "o_totalprice").from_table("orders").where("o_orderstatus = :status AND o_totalprice > :least", status="F", least=100000))


@_query("SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 100)")
def load_limit_count(spark, sf_dir):
    return _store(spark, sf_dir).load(Query().from_table("orders").limit(100)).agg(F.count("*").alias("n"))


@_query("SELECT * FROM supplier WHERE false")
def load_empty(spark, sf_dir):
    return _store(spark, sf_dir).empty("supplier")


@_query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def rendered_query(spark, sf_dir):
    """A query written as SQL by the dialect and run as such."""
    q = Query().select("c_custkey", "c_acctbal").from_table("customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 0")
    return _store(spark, sf_dir).load(q.to_sql(SparkDialect()))


@_query(
    """SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'), (3, 'o_totalprice', 'double'),
(4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string')) t(position, column_name, column_type)"""
)
def describe_table(spark, sf_dir):
    """Names, types and places of a table's columns."""
    fields = _store(spark, sf_dir).schema("orders").fields
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "position int, column_name string, column_type string")


# raw SQL: joins, aggregates, windows, set operations, sorts are Spark's own


def _raw(name: str, spark_sql: str, duck_sql: str | None = None):
    def run(spark, sf_dir):
        return _store(spark, sf_dir).load(spark_sql)

    run.__name__ = name
    _query(duck_sql or spark_sql)(run)


_raw("raw_sql_join_agg", "SELECT r_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_raw(
    "raw_sql_pricing",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
)
_raw("raw_sql_left_join", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_raw("raw_sql_window", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders", "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INTEGER AS place FROM orders")
_raw("raw_sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_raw("raw_sql_set_ops", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier) EXCEPT SELECT 0 AS k")
_raw("raw_sql_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_raw("raw_sql_semi_join", "SELECT p_partkey FROM part LEFT SEMI JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
_raw("raw_tsql_top", "SELECT TOP 10 [o_orderkey], [o_totalprice] FROM [orders] ORDER BY [o_orderkey]", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")


# ranges


@_query("SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def partition_bounds(spark, sf_dir):
    return ranges.partition_bounds(_store(spark, sf_dir).table("orders"), "o_orderkey")


_RANGES_SQL = """WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders)
SELECT least((o_orderkey - lo) // greatest((hi - lo + 1) // 4, 1), 3)::BIGINT AS worker, count(*) AS n, min(o_orderkey) AS lo_key, max(o_orderkey) AS hi_key FROM orders, b GROUP BY 1"""


@_query(_RANGES_SQL)
def parallel_range_load(spark, sf_dir):
    table = _store(spark, sf_dir).table("orders")
    low, high = ranges.bounds(table, "o_orderkey")
    worker = ranges.worker_of(F.col("o_orderkey"), low, high, 4).alias("worker")
    return table.groupBy(worker).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo_key"), F.max("o_orderkey").alias("hi_key"))


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def parallel_load_query(spark, sf_dir):
    """A load in four ranges keeps the query's projection and condition."""
    return _store(spark, sf_dir).load(Query().select("o_orderkey", "o_totalprice").from_table("orders").where("o_totalprice > 200000"), 4, "o_orderkey")


# saving


@_query("SELECT 0::BIGINT AS missing, 0::BIGINT AS added, count(*) AS saved FROM orders")
def roundtrip_diff(spark, sf_dir):
    """Rows that differ after a table was saved by four workers and loaded again."""
    store, orders = DataStore(spark, new_path(spark, "store")), _store(spark, sf_dir).table("orders")
    done = store.save(orders, "orders", 4)
    back = store.load("orders")
    lost = orders.exceptAll(back).agg(F.count("*").alias("missing"))
    return lost.crossJoin(back.exceptAll(orders).agg(F.count("*").alias("added"))).select("*", F.lit(done["rows"]).cast("bigint").alias("saved"))


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation")
def save_append(spark, sf_dir):
    """Columns are saved by position, whatever their names."""
    store, nation = DataStore(spark, new_path(spark, "store")), _store(spark, sf_dir).table("nation")
    store.save(nation, "nation")
    store.save(nation.select((F.col("n_nationkey") + 100).alias("a"), F.col("n_name").alias("b"), F.col("n_regionkey").alias("c")), "nation", 2)
    return store.load("nation")


# merging and registration

_SIDES = """l AS (SELECT l_suppkey AS key, sum(l_linenumber)::BIGINT AS v FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1), r AS (SELECT l_suppkey + 3 AS key, sum(l_linenumber)::BIGINT AS v FROM lineitem WHERE l_linenumber > 4 GROUP BY 1)"""


def _sides(spark, sf_dir):
    lines = _store(spark, sf_dir).table("lineitem")
    left = lines.where("l_linenumber <= 4").groupBy(F.col("l_suppkey").alias("key")).agg(F.sum("l_linenumber").alias("value"))
    right = lines.where("l_linenumber > 4").groupBy((F.col("l_suppkey") + 3).alias("key")).agg(F.sum("l_linenumber").alias("value"))
    return left, right


def _merged(name: str, strategy: str, sql: str):
    def run(spark, sf_dir):
        left, right = _sides(spark, sf_dir)
        return merge.merge(left, right, rules=merge.Rules.of(int=strategy))

    run.__name__ = name
    _query(f"WITH {_SIDES} SELECT key, {sql} AS value FROM l FULL JOIN r USING (key)")(run)


_merged("merge_sum", "sum", "coalesce(l.v + r.v, l.v, r.v)")
_merged("merge_max", "max", "greatest(l.v, r.v)")
_merged("merge_min", "min", "least(l.v, r.v)")
_merged("merge_replace", "replace", "coalesce(r.v, l.v)")


@_query(f"WITH {_SIDES} SELECT key, CASE WHEN key = 5 THEN coalesce(r.v, l.v) ELSE greatest(l.v, r.v) END AS value FROM l FULL JOIN r USING (key)")
def merge_key_strategy(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return merge.merge(left, right, rules=merge.Rules.of(int=max).set_strategy(5, "replace"))


@_query("SELECT user_id, event_type AS key, count(*) AS value FROM events GROUP BY ALL")
def merge_map_columns(spark, sf_dir):
    """Counts of two halves as maps, put together map by map."""
    counts = _store(spark, sf_dir).table("events").groupBy("user_id", "event_type").agg(F.count_if(F.col("event_id") % 2 == 0).alias("even"), F.count_if(F.col("event_id") % 2 == 1).alias("odd"))
    maps = counts.groupBy("user_id").agg(*(F.map_from_entries(F.collect_list(F.when(F.col(c) > 0, F.struct("event_type", c)))).alias(c) for c in ("even", "odd")))
    return maps.select("user_id", F.explode(merge.merge_maps("even", "odd", T.LongType())).alias("key", "value"))


@_query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins(spark, sf_dir):
    return keyed.last_wins(_store(spark, sf_dir).table("events"), "user_id", "event_type", "event_id")


@_query("SELECT * FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def registry_insert_only(spark, sf_dir):
    store = _store(spark, sf_dir)
    known = store.table("lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return keyed.insert_only(known, store.table("part"), ["p_partkey"])


@_query("SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def registry_override_only(spark, sf_dir):
    store = _store(spark, sf_dir)
    known = store.table("lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return keyed.override_only(known, store.table("part"), ["p_partkey"])


# generated tables


@_query(
    """SELECT i AS id, (i::DOUBLE * 1.23456789::DOUBLE) AS f64, printf('%s_%07d', 's', i) AS s, (DATE '1970-01-01' + (i % 10000)::INTEGER) AS d,
make_timestamp(1577836800000000 + i * 1000003) AS ts, i * 1000 AS dur, (i + 1)::INTEGER AS n, ((i % 24) * 3600 + (i * 7 % 60) * 60 + i * 13 % 60) * 1000000000 AS t FROM range(20000) r(i)"""
)
def datagen_deterministic(spark, sf_dir):
    made = datagen.create_df(spark, {"f64": "double", "s": "string", "d": "date", "ts": "timestamp", "dur": "duration", "n": "serial", "t": "time"}, 20_000)
    return made.select((F.col("n") - 1).cast("bigint").alias("id"), "f64", "s", "d", "ts", "dur", "n", "t")


@_query(
    """WITH RECURSIVE x(i, s) AS (SELECT 0::BIGINT, 43::HUGEINT UNION ALL
SELECT i + 1, xor(c, (c * 131072) % 18446744073709551616) FROM (SELECT i, xor(b, b // 128) AS c FROM (SELECT i, xor(s, (s * 8192) % 18446744073709551616) AS b FROM x)) WHERE i < 4000)
SELECT i::INTEGER AS n, (max(s) FILTER (k = 0) % 100001)::INTEGER AS a, (max(s) FILTER (k = 1) % 10000000001)::BIGINT AS b FROM
(SELECT (i - 1) % 2000 + 1 AS i, (i - 1) // 2000 AS k, s FROM x WHERE i > 0) GROUP BY i"""
)
def datagen_prng(spark, sf_dir):
    """Two columns drawn from one generator, in tasks that each jump to their rows."""
    return datagen.create_df(spark, {"n": "serial", "a": "int32", "b": "int64"}, 2000)


# scalar functions


@_query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def to_csv(spark, sf_dir):
    return _store(spark, sf_dir).table("nation").groupBy("n_regionkey").agg(arrays.to_csv(F.collect_list("n_name"), sort=True).alias("names"))


@_query("SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 2) AS doubled FROM embeddings")
def each_array(spark, sf_dir):
    return _store(spark, sf_dir).table("embeddings").select("vec_id", arrays.each("embedding")(lambda x, by: x.cast("double") * by, 2).alias("doubled"))


@_query("SELECT o_custkey, list_sort(list(o_orderkey)) AS keys FROM orders GROUP BY o_custkey")
def each_field(spark, sf_dir):
    """One field of every struct in an array."""
    held = _store(spark, sf_dir).table("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("orders"))
    return held.select("o_custkey", arrays.each("orders").o_orderkey.alias("keys"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_keys(props) AS names FROM events")
def json_props(spark, sf_dir):
    return _store(spark, sf_dir).table("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.json_object_keys("props").alias("names"))


@_query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_variant(spark, sf_dir):
    """Documents of any shape as VARIANT values."""
    return _store(spark, sf_dir).table("events").select("event_id", F.variant_get(documents.typed("props"), "$.k", "bigint").alias("k"))


@_query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def decode_documents(spark, sf_dir):
    """Documents decoded strictly by the JSON engine."""
    files = _store(spark, sf_dir).table("events").select(F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.col("props").cast("binary").alias("content"))
    made = documents.read_documents(files)
    return made.select(F.regexp_extract("path", r"^\d+", 0).cast("bigint").alias("event_id"), F.get_json_object("json", "$.k").cast("bigint").alias("k"))


_URL_PATHS = "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS p FROM pages"


def _url_paths(spark, sf_dir) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    return _store(spark, sf_dir).table("pages").select("page_id", bare.alias("p"))


@_query(
    f"""WITH u AS ({_URL_PATHS}), n AS (SELECT page_id, p, regexp_extract(p, '([^/]*)/*$', 1) AS name FROM u)
SELECT page_id, name, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS suffix, CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN regexp_extract(name, '^(.+)\\.[^.]+$', 1) ELSE name END AS stem,
coalesce(nullif(regexp_replace(regexp_replace(p, '/*$', ''), '/[^/]*$', ''), ''), '/') AS parent FROM n"""
)
def path_parts(spark, sf_dir):
    return _url_paths(spark, sf_dir).select("page_id", paths.name("p").alias("name"), paths.suffix("p").alias("suffix"), paths.stem("p").alias("stem"), paths.parent("p").alias("parent"))


@_query("SELECT page_id, url FROM pages WHERE url GLOB 'http://*.example.???/*'")
def glob_match(spark, sf_dir):
    return _store(spark, sf_dir).table("pages").select("page_id", "url").where(paths.match_pattern("http://*.example.???/*", "url"))


@_query(f"WITH u AS ({_URL_PATHS}) SELECT DISTINCT p AS path FROM u WHERE p LIKE '%.html' AND NOT (p LIKE '%/1.html')")
def path_set_filter(spark, sf_dir):
    """Paths with a suffix, less one that is taken out."""
    found = PathSet(_url_paths(spark, sf_dir).select("p"))
    return ((found & ext(".html")) & (paths.name("path") != "1.html")).eval().frame


@_query("SELECT source AS path FROM documents WHERE source IS NOT NULL UNION SELECT 'x' EXCEPT SELECT 'src1'")
def path_set_algebra(spark, sf_dir):
    docs = _store(spark, sf_dir).table("documents")
    return (PathSet(docs.select("source")) + PathSet.of(spark, ["x", "x"]) - "src1").frame


@_query("SELECT l_orderkey, l_linenumber, ((l_linenumber - 4) & 255)::INTEGER AS wrapped FROM lineitem")
def wrap_u8(spark, sf_dir):
    """Signed bytes as unsigned ones."""
    return _store(spark, sf_dir).table("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 4).bitwiseAND(F.lit(255)).alias("wrapped"))


@_query(
    """SELECT event_id, year(ts)::INTEGER AS y, month(ts)::INTEGER AS mo, day(ts)::INTEGER AS d, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS mi, second(ts)::INTEGER AS s,
(microsecond(ts) % 1000000)::INTEGER AS us FROM events"""
)
def ts_parts(spark, sf_dir):
    p = moments.timestamp_parts("ts")
    names = {"year": "y", "month": "mo", "day": "d", "hour": "h", "minute": "mi", "second": "s", "micros": "us"}
    return _store(spark, sf_dir).table("events").select("event_id", p.alias("p")).select("event_id", *(F.col(f"p.{k}").alias(v) for k, v in names.items()))


@_query("SELECT event_id, ts AS again, (ts::DATE - DATE '1970-01-01')::INTEGER AS days FROM events")
def ts_rebuilt(spark, sf_dir):
    """Timestamps put together from their parts again."""
    p = moments.timestamp_parts("ts")
    events = _store(spark, sf_dir).table("events").select("event_id", p.alias("p"))
    again = moments.timestamp_from_parts(*(F.col(f"p.{k}") for k in ("year", "month", "day", "hour", "minute", "second")), F.col("p.micros") * 1000)
    return events.select("event_id", again.alias("again"), moments.days_from_civil(F.col("p.year"), F.col("p.month"), F.col("p.day")).alias("days"))


@_query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice * 1024 / (l_quantity / 1000.0) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN r < 1024 THEN printf('%.2f B/s', r) WHEN r < 1048576 THEN printf('%.2f KB/s', r / 1024) WHEN r < 1073741824 THEN printf('%.2f MB/s', r / 1048576)
ELSE printf('%.2f GB/s', r / 1073741824) END AS rate FROM r"""
)
def rate_format(spark, sf_dir):
    return _store(spark, sf_dir).table("lineitem").select("l_orderkey", "l_linenumber", units.calculate_rate(F.col("l_extendedprice"), "KiB", F.col("l_quantity"), "ms").alias("rate"))


_LITERALS = ["null", "~", "", "Null", "true", "FALSE", "yes", "tRUE", "1", "-12", "+7", "010", "0x1A", "-0x1A", "0o17", "08", "1.5", ".5", "5.", "1e3", "-1.2E-4", ".inf", "-.INF", "+.inf", ".nan", "-.nan", "inf", "1_000", "a b", "."]


@_query(
    "SELECT t AS text, CASE WHEN regexp_full_match(t, '(?:|~|null|Null|NULL)') THEN 'null' WHEN regexp_full_match(t, '(?:true|True|TRUE|false|False|FALSE)') THEN 'bool' "
    "WHEN regexp_full_match(t, '(?:0x[0-9a-fA-F]+|0o[0-7]+|[-+]?[0-9]+)') THEN 'int' WHEN regexp_full_match(t, '(?:[-+]?(?:\\.inf|\\.Inf|\\.INF)|\\.nan|\\.NaN|\\.NAN)') THEN 'float' "
    "WHEN regexp_full_match(t, '[-+]?(?:\\.[0-9]+|[0-9]+(?:\\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?') THEN 'float' ELSE 'string' END AS kind FROM (SELECT unnest(["
    + ", ".join(f"'{x}'" for x in _LITERALS)
    + "]) AS t)"
)
def yaml_scalar_class(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in _LITERALS], "text string").select("text", scalars.scalar_class("text").alias("kind"))


# metrics


@_query("SELECT l_suppkey AS worker, max(l_extendedprice) AS seconds, sum(l_quantity) AS n FROM lineitem GROUP BY 1")
def metric_merge(spark, sf_dir):
    from brindle.metrics import merged

    rows = _store(spark, sf_dir).table("lineitem").select(F.col("l_suppkey").alias("worker"), F.col("l_extendedprice").alias("seconds"), F.col("l_quantity").alias("n"))
    return merged(rows, ["worker"], ["seconds"], ["n"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | more_queries.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | more_queries.oracle_sql()
