import pathlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from brindle.llm import classifier, decontam, neardup, packing, rules

ITEM = "the quick fox of the north jumps over the lazy dog in the old town and then it is gone for all of the long winter."


@pytest.fixture(scope="module")
def folder(tmp_path_factory, prose):
    random.seed(21)
    fill = "the of and to in is that for".split()
    text = lambda n, extra="": " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(x for w in prose(n).split() for x in ((w, random.choice(fill)) if random.random() < 0.4 else (w,)))) + extra + "."
    rows = [(i, text(random.randint(60, 200))) for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(220 + i, rows[i][1] + " more words") for i in range(20, 30)]
    rows += [(300 + i, text(60) + " " + ITEM) for i in range(5)] + [(400 + i, text(80, " vile scum trash" * 6)) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "$$$ ### !!! " * 60), (None, text(70))]
    d = tmp_path_factory.mktemp("sf")
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())}), d / "documents.parquet")
    labelled = [r[0] for r in rows if r[0] is not None and r[0] % 2 == 0 and r[0] < 500]
    pq.write_table(pa.table({"doc_id": pa.array(labelled, pa.int64()), "quality": pa.array([1] * len(labelled), pa.int32()), "toxic": pa.array([int(x >= 400) for x in labelled], pa.int32())}), d / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": [ITEM]}), d / "benchmark.parquet")
    return str(d)


def test_stages_are_the_operators_on_what_was_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, labels, items = docs.columns, spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    own = [
        lambda d: rules.keep(d),
        lambda d: classifier.classify(d, classifier.fit(d, labels)),
        lambda d: neardup.deduplicate(d),
        lambda d: decontam.decontaminate(d, items),
        lambda d: packing.pack(d),
    ]
    assert [n for n, _ in P.STAGES] == ["quality_rules", "quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    kept = []
    for (_, stage), plain in zip(P.STAGES, own):
        found = stage(spark, docs, folder)
        assert sorted(map(str, found.collect())) == sorted(map(str, plain(docs).collect()))
        if stage is not P.STAGES[-1][1]:
            assert found.columns == columns
            docs = spark.createDataFrame(found.collect(), found.schema)
            kept.append({r.doc_id for r in docs.collect()})
    assert not {500, 501, 502} & kept[0]
    assert not set(range(400, 460)) & kept[1] and len(set(range(200)) & kept[1]) > 190
    assert not (set(range(200, 210)) | set(range(240, 250))) & kept[2] and kept[1] & set(range(200)) <= kept[2]
    assert not set(range(300, 305)) & kept[3] and None in kept[3]
    final = P.run(spark, folder)
    assert {x for r in final.collect() for x in r.doc_ids} == kept[3]


CLASHING = "node key label hub __row __score v_symbols words posterior __n p_quality keep doc_ids n_tokens pack_group length a b n item_id __gone __again __shard".split()


def test_other_columns_of_any_name_come_along(spark, folder):
    """Columns with the names that stages use themselves change nothing and come out as they went in."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))
    for name, stage in P.STAGES:
        plain, made = stage(spark, docs, folder), stage(spark, wide, folder)
        if name == P.STAGES[-1][0]:
            assert sorted(map(str, made.collect())) == sorted(map(str, plain.collect()))
            break
        assert made.columns == wide.columns
        rows = made.collect()
        assert sorted(map(str, (r[:5] for r in rows))) == sorted(str(tuple(r)) for r in plain.collect())
        assert all(r[5 + k] == f"own {c}" for r in rows for k, c in enumerate(CLASHING))
        wide, docs = (spark.createDataFrame(f.collect(), f.schema) for f in (made, plain))


def test_nothing_but_the_result_stays_in_the_shared_folder(spark, folder):
    from brindle.plans import scratch

    base = pathlib.Path(scratch.shared_dir(spark).removeprefix("file:"))
    before = set(base.iterdir())
    P.run(spark, folder)
    left = [p.name for p in set(base.iterdir()) - before]
    # the bins; packing reads its lengths only while they are written
    assert len(left) == 1 and left[0].startswith("best_fit_packing")


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
