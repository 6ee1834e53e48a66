import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from brindle.llm import packing as P
from brindle.llm import sharding as S
from brindle.llm import tokenfile


def _brute(lengths, capacity):
    """Best-two-fit by trying every pair: the bins' lengths."""
    left, bins = sorted(lengths), []
    while left:
        own = []
        while fits := [x for x in left if x <= capacity - sum(own)]:
            own.append(max(fits))
            left.remove(own[-1])
        room = capacity - sum(own) + own[-1]
        pairs = [(x + y, -min(x, y), max(x, y)) for k, x in enumerate(left) for y in left[k + 1 :] if own[-1] < x + y <= room]
        if pairs:
            total, small, large = max(pairs)
            left.append(own.pop())
            for x in (large, -small):
                left.remove(x)
                own.append(x)
        bins.append(sorted(own))
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_bins_equal_brute_force(seed):
    random.seed(seed)
    lengths = np.array([random.choice((random.randint(1, 40), random.randint(20, 100))) for _ in range(random.randint(1, 90))])
    bins = P.best_two_fit(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert [sorted(lengths[b].tolist()) for b in bins] == _brute(lengths.tolist(), 100)


def test_two_replace_the_smallest():
    # 60 + 30 leaves 10; giving 30 back lets 21 and 19 fill the bin
    bins = P.best_two_fit(np.array([60, 30, 21, 19]), 100)
    assert [sorted(b) for b in bins] == [[0, 2, 3], [1]]


def test_pack_covers_every_byte_once(spark, prose):
    random.seed(4)
    rows = [(i, "x" * random.randint(1, 60)) for i in range(500)] + [(900, "y" * 1234), (901, None), (902, ""), (None, "nul"), (3, "again"), (3, "again"), (903, "é" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pack_group", "'a' AS length")
    for group in (1 << 26, 4000):
        bins = P.pack(docs, capacity=100, group_tokens=group).collect()
        pieces = Counter()
        for b in bins:
            assert b.n_tokens == sum(b.lengths) <= 100 and len(b.doc_ids) == len(b.starts) == len(b.lengths) > 0
            for d, n in zip(b.doc_ids, b.lengths):
                pieces[d] += n
        wanted = Counter()
        for d, t in rows:
            if t:
                wanted[d] += len(t.encode())
        assert pieces == wanted
        assert sum(b.n_tokens for b in bins) / (100 * len(bins)) > 0.95
        starts = sorted((s, n) for b in bins for d, s, n in zip(b.doc_ids, b.starts, b.lengths) if d == 900)
        assert starts == [(100 * k, 100) for k in range(12)] + [(1200, 34)]
    assert P.pack(docs.limit(0), capacity=100).count() == 0


def test_lengths_are_tokens_of_the_written_lists(spark, prose, tmp_path):
    rows = [(i, prose(20 + i)) for i in range(60)] + [(100, prose(9000)), (101, "é漢🎉 " * 40), (102, None), (103, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokenfile.write_tokens(docs, str(tmp_path / "t"))
    count = {r.doc_id: r.n for r in spark.read.parquet(str(tmp_path / "t")).select("doc_id", F.size("token_ids").alias("n")).collect() if r.n and r.n > 0}
    for bins, most in ((P.pack(docs).collect(), P.CAPACITY), (P.pack(docs, sequence_tokens=100).collect(), 100)):
        pieces = {}
        for b in bins:
            assert b.n_tokens == sum(b.lengths) <= most
            for d, s, n in zip(b.doc_ids, b.starts, b.lengths):
                pieces.setdefault(d, []).append((s, n))
        assert {d: sum(n for _, n in p) for d, p in pieces.items()} == count
        assert all(s == sum(n for _, n in sorted(p)[:k]) for p in pieces.values() for k, (s, _) in enumerate(sorted(p)))
    # more bytes than a sequence has tokens, yet it fits whole
    fits = spark.createDataFrame([(1, "the of and to in is " * 450)], "doc_id long, text string")
    assert fits.selectExpr("octet_length(text) AS n").first().n > P.CAPACITY and [r.starts for r in P.pack(fits).collect()] == [[0]]


def test_sequences_are_the_texts_tokens(spark, prose, tmp_path):
    rows = [(i, prose(30 + 3 * i)) for i in range(50)] + [(100, prose(4000)), (101, "é漢🎉 " * 40), (102, None), (103, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokenfile.write_tokens(docs, str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    bins = P.pack(docs, sequence_tokens=500)
    made = {(r.pack_group, r.pack_bin): r.input_ids for r in P.sequences(bins, table).collect()}
    whole, again = {r.doc_id: r.token_ids for r in table.collect() if r.token_ids}, {}
    for b in bins.collect():
        ids = made.pop((b.pack_group, b.pack_bin))
        assert len(ids) == b.n_tokens <= 500
        for d, s, n in zip(b.doc_ids, b.starts, b.lengths):
            again.setdefault(d, {})[s], ids = ids[:n], ids[n:]
    assert not made and {d: [t for s in sorted(p) for t in p[s]] for d, p in again.items()} == whole
    for wrong in (table.union(table), table.where("doc_id != 100")):
        with pytest.raises(PySparkException, match="token list"):
            P.sequences(bins, wrong).collect()
    assert P.sequences(bins.limit(0), table).count() == 0


@pytest.fixture(scope="module")
def shard_docs(spark, tmp_path_factory):
    random.seed(6)
    rows = [(i, "z" * random.randint(0, 400)) for i in range(700)] + [(5000, "big" * 3000), (5000, "big"), (5001, None), (5002, ""), (None, "n"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bits", "2 AS shard", "3 AS bytes")
    path = str(tmp_path_factory.mktemp("d"))
    docs.write.mode("overwrite").parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return docs, con


@pytest.mark.parametrize("limit", [1 << 30, 50_000, 2_000, 300])
def test_shards_equal_their_sql(shard_docs, limit):
    docs, con = shard_docs
    found = sorted(map(tuple, S.assign(docs, limit=limit).collect()), key=str)
    assert found == sorted(con.execute(S.sql(limit=limit)).fetchall(), key=str)
    size = Counter()
    for d, n, shard, depth in found:
        size[shard, depth] += n
    assert all(n <= limit or depth == S.MAX_BITS for (_, depth), n in size.items())


def test_rows_without_an_id_spread(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(400)] + [(None, None), (None, "")], "doc_id long, text string")
    found = S.assign(docs, limit=300).collect()
    size = Counter()
    for r in found:
        size[r.shard, r.depth] += r.n_bytes
    assert len(found) == 402 and max(size.values()) <= 300 and len(size) > 10


def test_a_shard_that_cannot_split_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "TASK_BYTES", 1000)
    docs = spark.createDataFrame([(7, f"copy {i} " * 9) for i in range(300)] + [(i, "other " * 9) for i in range(100)], "doc_id long, text string")
    S.write_shards(docs, str(tmp_path / "s"), limit=2000)
    back = S.read_shards(spark, str(tmp_path / "s"), docs.schema)
    assert back.select("doc_id", "text").exceptAll(docs).count() == 0 and back.count() == 400
    files = {r.depth: r.n for r in back.withColumn("f", F.input_file_name()).groupBy("depth", "shard").agg(F.count_distinct("f").alias("n")).groupBy("depth").agg(F.max("n").alias("n")).collect()}
    assert files.pop(S.MAX_BITS) > 5 and set(files.values()) == {1}


def test_queries_split_the_tables(spark):
    from brindle.llm import queries as Q

    found = Q.sharding_small_shards(spark, "/root/testdata/sf0.01").select("shard", "depth").distinct().collect()
    assert len(found) > 20 and len({r.depth for r in found}) >= 3
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    assert sorted(map(tuple, Q.op6_sharding(spark, "/root/testdata/sf0.01").collect())) == sorted(con.execute(Q.oracle_sql()["op6_sharding"]).fetchall())


def test_written_shards_and_empty_tables(spark, shard_docs, tmp_path):
    docs, con = shard_docs
    S.write_shards(docs, str(tmp_path / "s"), limit=20_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.drop("__shard").exceptAll(docs).count() == 0 and docs.exceptAll(back.drop("__shard")).count() == 0
    assert back.select("__shard", F.input_file_name().alias("f")).groupBy("__shard").agg(F.count_distinct("f").alias("n")).where("n > 1").count() == 0
    placed = S.read_shards(spark, str(tmp_path / "s"), docs.select(F.col("doc_id"), F.col("text")).schema).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), "shard", "depth")
    assert sorted(map(tuple, placed.collect()), key=str) == sorted(con.execute(S.sql(limit=20_000)).fetchall(), key=str)
    S.write_shards(docs.limit(0), str(tmp_path / "e"))
    assert S.assign(docs.limit(0)).count() == 0 and S.read_shards(spark, str(tmp_path / "e"), docs.schema).count() == 0
