import random

import pytest
from pyspark.sql import functions as F

from brindle.plans import components as C
from brindle.plans import scratch


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_equal_brute_force(spark, few):
    random.seed(few)
    edges = [(random.randint(-150, 150), random.randint(-150, 150)) for _ in range(140)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(6000, 6100)] + [(3, 3), (1000, 1001)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(60):
        for u, v in edges:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    frame = spark.createDataFrame([*edges, (None, 4), (4, None)], "u long, v long")
    assert {r.node: r.label for r in C.components(frame, "u", "v", few).collect()} == label
    assert C.components(frame.limit(0), "u", "v", few).count() == 0


def test_scratch_tables_end_with_their_scope(spark):
    fs_has = lambda p: scratch._java_path(spark, p)[1].exists(scratch._java_path(spark, p)[0])
    with scratch.scope(spark) as outer:
        with scratch.scope(spark) as inner:
            gone, kept = (scratch.write(spark.range(3), x) for x in ("gone", "kept"))
            scratch.hand_on(inner, 1)
        assert not fs_has(gone) and fs_has(kept) and outer == [kept]

        @scratch.settled
        def doubled(frame):
            return scratch.materialize(frame.select((2 * F.col("id")).alias("x")), "inside")

        found = doubled(spark.range(4))
        assert sorted(r.x for r in found.collect()) == [0, 2, 4, 6] and len(outer) == 2
    assert not fs_has(kept)
    with pytest.raises(ZeroDivisionError), scratch.scope(spark):
        lost = scratch.write(spark.range(1), "lost")
        1 / 0
    assert not fs_has(lost)


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)
    Context.master = "local-cluster[3,2,1000]"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)


def test_buckets_follow_bytes(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scratch.tasks_for(spark, 0) == 1 and scratch.tasks_for(spark, 10**8) == least and scratch.tasks_for(spark, 10**9, 10**6) == 1000
    rows = spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    table = scratch.materialize_by(rows, "t", "k", spark.range(0, 50, 5).withColumnRenamed("id", "k"), least * 3 * scratch.TASK_BYTES)
    assert table.count() == 10 and "Exchange" not in table.groupBy("k").count()._jdf.queryExecution().executedPlan().toString().replace("AQE", "")
