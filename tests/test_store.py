import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.metrics import LoadMetrics, SaveMetrics
from brindle.sources import ranges
from brindle.sources import sqltypes
from brindle.sources.query import Query, SparkDialect, TSqlDialect, from_tsql, qualified, sortable, split_with
from brindle.sources.sqltypes import custom_schema
from brindle.sources.store import DataStore, Format, StoreError, _again


def test_queries_are_values():
    q = Query().select("a").from_table("t")
    assert q.select("b").columns == ("a", "b") and q.columns == ("a",)
    assert q.where("x > 1").where("y > 2").where_clause == "y > 2"
    assert Query.raw("SELECT 1").is_raw() and not q.is_raw()
    with pytest.raises(ValueError):
        q.limit(-1)


@pytest.mark.parametrize(
    "query, tsql, spark_sql",
    [
        (Query("users"), "SELECT * FROM [users]", "SELECT * FROM `users`"),
        (Query("users").select("id").limit(5), "SELECT TOP 5 [id] FROM [users]", "SELECT `id` FROM `users` LIMIT 5"),
        (Query("s.t").select("col1").select("col2"), "SELECT [col1], [col2] FROM [s].[t]", "SELECT `col1`, `col2` FROM `s`.`t`"),
        (Query("t").where("a > 1"), "SELECT * FROM [t] WHERE a > 1", "SELECT * FROM `t` WHERE a > 1"),
    ],
)
def test_dialects(query, tsql, spark_sql):
    assert query.to_sql(TSqlDialect()) == tsql
    assert query.to_sql(SparkDialect()) == spark_sql


def test_quoting_and_names():
    assert TSqlDialect().quote_identifier("a]b") == "[a]]b]"
    assert SparkDialect().quote_identifier("a`b") == "`a``b`"
    assert qualified("t", "dbo") == "dbo.t" and qualified("s.t", "dbo") == "s.t"
    for bad in ("a b", "1a", "a.b.c", "a;b", ""):
        with pytest.raises(ValueError):
            qualified(bad)


def test_tsql_is_translated():
    assert from_tsql("SELECT TOP 3 [a b] FROM [t] WHERE x = '[no]'") == "SELECT `a b` FROM `t` WHERE x = '[no]' LIMIT 3"
    assert from_tsql("SELECT xs[0] FROM t") == "SELECT xs[0] FROM t"


@pytest.mark.parametrize("low, high, workers", [(1, 10, 3), (0, 0, 4), (-5, 5, 4), (1, 7, 7), (1, 100, 8), (5, 4, 3)])
def test_ranges_cover_each_key_once(low, high, workers):
    plan = ranges.plan_ranges(low, high, workers)
    assert [k for r in plan for k in range(r.low, r.high + 1)] == list(range(low, high + 1))
    assert len(plan) <= workers


def test_parallel_load_keeps_null_keys_and_the_query(spark, tmp_path):
    store = DataStore(spark, str(tmp_path))
    frame = spark.createDataFrame([(i, i * 2) for i in range(50)] + [(None, 7)], "k long, v long")
    store.save(frame, "t", 2)
    loaded = store.load("t", 4, "k")
    assert loaded.count() == 51 and "Exchange" not in loaded._jdf.queryExecution().toString()  # files have splits of their own
    ranged = ranges.range_partitioned(loaded, "k", 4)
    assert ranged.count() == 51 and ranged.rdd.getNumPartitions() == 4
    assert store.load(Query("t").select("v").where("v < 10"), 4, "k").count() == 6


def test_round_trip_of_every_form(spark, tmp_path):
    store = DataStore(spark, str(tmp_path))
    table = pa.table({"id": pa.array([1, 2, 3], pa.uint32()), "val": [1.25, 2.5, None], "text": ["first", "second", None]})
    metrics = store.save(table, "t")
    assert metrics["rows"] == 3 and metrics["total_seconds"] > 0
    store.save(table.to_pandas(), "t")
    assert store.load("t").count() == 6
    assert store.load("SELECT max(id) AS m FROM t").first()[0] == 3
    assert DataStore(spark, str(tmp_path), "arrow").load("t").num_rows == 6
    assert len(DataStore(spark, str(tmp_path), "pandas").load("t")) == 6
    with pytest.raises(TypeError):
        store.save(object(), "t")


def test_nothing_to_save_and_wrong_width_are_errors(spark, tmp_path):
    store = DataStore(spark, str(tmp_path))
    with pytest.raises(StoreError, match="no row"):
        store.save(spark.createDataFrame([], "a long"), "t")
    assert not (tmp_path / "t").exists()
    store.save(spark.createDataFrame([(1,)], "a long"), "t")
    before = sorted(p.name for p in (tmp_path / "t").glob("*.parquet"))
    with pytest.raises(StoreError, match="no row"):
        store.save(spark.createDataFrame([], "a long"), "t")
    assert sorted(p.name for p in (tmp_path / "t").glob("*.parquet")) == before and store.load("t").count() == 1
    store.save(spark.createDataFrame([(1,)], "a long"), "u")
    with pytest.raises(StoreError):
        store.save(spark.createDataFrame([(1, 2)], "a long, b long"), "u")


def test_sql_leaves_the_sessions_views_alone(spark, tmp_path):
    store = DataStore(spark, str(tmp_path))
    store.save(spark.createDataFrame([(1, "store")], "k long, whose string"), "nation")
    store.save(spark.createDataFrame([(1, 5)], "k long, v long"), "more")
    (tmp_path / "broken.parquet").write_bytes(b"no footer")  # not named, so not looked at
    spark.createDataFrame([(1, "user")], "k long, whose string").createOrReplaceTempView("nation")
    spark.createDataFrame([(1, "mine")], "k long, own string").createOrReplaceTempView("side")
    try:
        found = store.load("WITH n AS (SELECT * FROM nation) SELECT whose, v, own FROM n JOIN more USING (k) JOIN side USING (k) WHERE k IN (SELECT k FROM `more`)")
        assert [tuple(r) for r in found.collect()] == [("store", 5, "mine")]
        assert [tuple(r) for r in store.load(Query.raw("SELECT whose FROM nation WHERE k = :k", k=1)).collect()] == [("store",)]
        assert spark.table("nation").first().whose == "user" and not spark.catalog.tableExists("more")
        assert found.sparkSession is spark and found.join(spark.table("side").select("own"), "own").count() == 1
        with pytest.raises(StoreError, match="TABLE_OR_VIEW_NOT_FOUND"):
            store.load("SELECT * FROM nowhere")
    finally:
        spark.catalog.dropTempView("nation")
        spark.catalog.dropTempView("side")


def test_options_of_one_database(spark, tmp_path):
    server = "jdbc:sqlserver://h;databaseName=d"
    assert DataStore(spark, server, table_hint="TABLOCK").options == {"useBulkCopyForBatchInsert": "true", "bulkCopyForBatchInsertTableLock": "true"}
    assert DataStore(spark, server, packet_size=8192).options == {"packetSize": "8192"} and DataStore(spark, server + ";packetSize=1", packet_size=8192).options == {}
    for location, more in ((str(tmp_path), {"table_hint": "TABLOCK"}), ("jdbc:derby:x", {"packet_size": 1}), (server, {"table_hint": "NOLOCK"})):
        with pytest.raises(ValueError):
            DataStore(spark, location, **more)


def test_statements_in_parentheses():
    text = "WITH a AS (SELECT ')' AS x), b AS (SELECT 1 AS y) SELECT * FROM a, b ORDER BY y -- WITH"
    assert split_with(text) == ("WITH a AS (SELECT ')' AS x), b AS (SELECT 1 AS y)", "SELECT * FROM a, b ORDER BY y -- WITH")
    assert split_with("SELECT 1") == ("", "SELECT 1")
    assert sortable("SELECT a FROM t ORDER BY a;") == "SELECT a FROM t ORDER BY a OFFSET 0 ROWS"
    for same in ("SELECT TOP 3 a FROM t ORDER BY a", "SELECT a FROM (SELECT TOP 1 a FROM t ORDER BY a) q", "SELECT 'ORDER BY' FROM t", "SELECT a FROM t ORDER BY a OFFSET 5 ROWS"):
        assert sortable(same) == same


def test_sql_types():
    assert custom_schema([("a", "DECIMAL(38,4)"), ("b`c", "nvarchar(max)"), ("d", "datetimeoffset(7)")]) == "`a` decimal(38,4), `b``c` string, `d` timestamp"
    assert sqltypes.spark_type("numeric", 40).simpleString() == "string" and sqltypes.spark_type("decimal").simpleString() == "decimal(18,0)"
    with pytest.raises(ValueError):
        sqltypes.spark_type("geography")


def test_large_keys_keep_their_range(spark):
    low, high = 2**53 + 1, 2**53 + 9
    rows = spark.createDataFrame([(k,) for k in range(low, high + 1)] + [(None,)], "k long")
    found = {r.k: r.w for r in rows.select("k", ranges.worker_of(F.col("k"), low, high, 3).alias("w")).collect()}
    assert found == {None: None} | {k: r.worker for r in ranges.plan_ranges(low, high, 3) for k in range(r.low, r.high + 1)}
    wide = spark.createDataFrame([(-(2**63),), (2**63 - 1,)], "k long").select(ranges.worker_of(F.col("k"), -(2**63), 2**63 - 1, 2).alias("w"))
    assert [r.w for r in wide.collect()] == [0, 1]


def test_slices_are_contiguous_and_even(spark):
    for rows, parts, n in ((100, 7, 8), (3, 2, 5), (0, 1, 2), (64, 1, 1)):
        made = [r.slice for r in ranges.slices(spark.range(0, rows, 1, parts), n).orderBy("id").collect()]
        assert made == [i * n // rows for i in range(rows)]
    with pytest.raises(ValueError):
        ranges.slices(spark.range(3), 0)


def test_metrics_are_measured(spark, tmp_path):
    store = DataStore(spark, str(tmp_path), batch_size=30)
    made = store.save(spark.range(100), "t", 2)
    assert made["batches"] == 4 and made["connect_seconds"] > 0 and made["write_seconds"] > 0 and 0 <= made["flush_seconds"] <= made["write_seconds"]
    arrow = DataStore(spark, str(tmp_path), "arrow", block_size=30)
    arrow.load("t")
    assert (arrow.last_load.rows, arrow.last_load.blocks) == (100, 4)


def test_the_databases_own_words(spark):
    store = DataStore(spark, "jdbc:derby:memory:words;create=true")
    with pytest.raises(StoreError, match=r"\[42X05\]"):
        store.load("MISSING")
    tries = []

    def once_lost():
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("Communication link failure")
        return 7

    assert _again(once_lost) == 7
    with pytest.raises(KeyError):
        _again(lambda: {}["x"])


def test_column_types_of_a_database(spark):
    store = DataStore(spark, "jdbc:derby:memory:kinds;create=true", column_types={"K": {"N": "bigint"}})
    DataStore(spark, store.location).save(spark.createDataFrame([(3, "x")], "N int, T string"), "K")
    assert store.load("K").schema["N"].dataType.simpleString() == "bigint"


def test_hooks_run_in_order_and_post_not_after_failure(spark, tmp_path):
    store, seen = DataStore(spark, str(tmp_path)), []
    for name in ("pre1", "pre2"):
        store.add_pre_transform(lambda name=name: seen.append(name))
    store.add_post_transform(lambda: seen.append("post"))
    with pytest.raises(TypeError):
        store.save(object(), "t")
    assert seen == ["pre1", "pre2"]
    store.save(spark.createDataFrame([(1,)], "a long"), "t")
    assert seen[2:] == ["pre1", "pre2", "post"]
    store.clear_transforms()
    store.add_post_transform(lambda frame: frame.where("a > 1"))
    assert store.load("t").count() == 0


def test_formats_options_and_text(spark, tmp_path):
    with pytest.raises(ValueError):
        Format.of("xml")
    with pytest.raises(ValueError):
        DataStore(spark, str(tmp_path), block_size=0)
    assert repr(DataStore(spark, str(tmp_path))) == "DataStore(backend=parquet, format=spark, transforms=0/0)"
    with pytest.raises(StoreError):
        DataStore(spark, str(tmp_path)).load("missing")


def test_jdbc_round_trip(spark):
    store = DataStore(spark, "jdbc:derby:memory:brindle;create=true")
    frame = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id int, name string")
    store.save(frame, "T1")
    assert store.load("T1").count() == 20
    assert store.load("T1", 4, "id").rdd.getNumPartitions() == 4 and store.load("T1", 4, "id").count() == 20
    assert store.load('SELECT "id" FROM T1 WHERE "id" > 14').count() == 5
    assert store.load(Query("T1").select("name").where("id < 3")).count() == 3


def test_key_detection(spark):
    schema = spark.createDataFrame([], "name string, n int, k long").schema
    assert ranges.detect_key(schema, ["name", "k", "n"]) == "k"
    assert ranges.detect_key(schema, ["name"]) is None


def test_metrics_merge():
    a, b = SaveMetrics(rows=2, bind_seconds=1, write_seconds=3, total_seconds=9), SaveMetrics(rows=3, bind_seconds=2, write_seconds=1, total_seconds=5)
    both = a.merge(b)
    assert (both.rows, both.bind_seconds, both.write_seconds, both.total_seconds) == (5, 3, 3, 9)
    assert LoadMetrics(1, 1, 1, 2.0).merge(LoadMetrics(2, 2, 1, 1.0)) == LoadMetrics(3, 3, 1, 2.0)


def test_streams(spark, tmp_path):
    from brindle.streaming.tables import read_stream, save_stream

    store = DataStore(spark, str(tmp_path))
    store.save(spark.createDataFrame([(1,), (2,)], "a long"), "t")
    save_stream(read_stream(store, "t"), store, "u", str(tmp_path / "c")).awaitTermination()
    store.save(spark.createDataFrame([(3,)], "a long"), "t")
    save_stream(read_stream(store, "t"), store, "u", str(tmp_path / "c")).awaitTermination()
    assert sorted(r[0] for r in store.load("u").collect()) == [1, 2, 3]


def test_conditions_and_columns_reach_the_scan(spark):
    store = DataStore(spark, "/root/testdata/sf0.001")
    frame = store.load(Query().select("l_orderkey").from_table("lineitem").where("l_quantity > :q", q=45))
    plan = frame._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_primary_key_of_a_database_partitions_a_load(spark):
    url = "jdbc:derby:memory:keys;create=true"
    store = DataStore(spark, url)
    store.save(spark.createDataFrame([(1,)], "a int"), "OTHER")  # loads the driver
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    statement = connection.createStatement()
    statement.execute("CREATE TABLE T (NAME VARCHAR(9) NOT NULL, K BIGINT NOT NULL, V INT, PRIMARY KEY (NAME, K))")
    statement.execute("INSERT INTO T VALUES " + ", ".join(f"('n{i}', {i}, {i * i})" for i in range(40)))
    connection.close()
    assert store._primary_key("T") == ["NAME", "K"]
    loaded = store.load("T", 5)
    assert loaded.rdd.getNumPartitions() == 5 and loaded.count() == 40
    assert store.load("OTHER", 5).count() == 1
