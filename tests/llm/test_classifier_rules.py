import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from brindle.llm import classifier as C
from brindle.llm import rules as R

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy():
    """Half of the labelled documents train, the other half is judged."""
    docs, labels = (pq.read_table(f"{SF}/{t}.parquet").to_pandas() for t in ("documents", "labels"))
    both = labels.groupby("doc_id").agg(quality=("quality", "min"), toxic=("toxic", "max")).reset_index().merge(docs.dropna(subset=["text"]).drop_duplicates("doc_id")[["doc_id", "text"]], on="doc_id")
    both = both.sample(frac=1.0, random_state=1)
    half = len(both) // 2
    label = (2 * both.quality + both.toxic).to_numpy()
    model = C.train(pa.array(both.text[:half]), label[:half], epochs=4)
    p = model.probabilities(pa.array(both.text[half:]))
    good, toxic = p[:, 2] + p[:, 3], p[:, 1] + p[:, 3]
    q, t = both.quality[half:].to_numpy(), both.toxic[half:].to_numpy()
    assert ((good >= 0.5) == (q == 1)).mean() > 0.93 and ((toxic >= 0.5) == (t == 1)).mean() > 0.93
    clean = (q == 1) & (t == 0)
    assert ((good >= C.MIN_QUALITY) & (toxic < C.MAX_TOXIC))[clean].mean() > 0.97


BLANK = b"\t\n\v\f\r "


def _plain_features(text: str, bits: int) -> list[int]:
    """Buckets of a text's tokens and n-grams, one after the other, by plain whole numbers."""
    raw, mask, base = (text or "").encode(), (1 << 64) - 1, 0x9E3779B97F4A7C15
    out, token = [], b""
    for c in raw + b" ":
        if c not in BLANK:
            token += bytes([c])
        elif token:
            x = (sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(token)) + len(token)) & mask
            x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
            out.append((x ^ (x >> 31)) >> (64 - bits))
            token = b""
    for size in C.GRAMS:
        for i in range(len(raw) - size + 1):
            gram = raw[i : i + size]
            if any(b in BLANK for b in gram[1:-1]):
                continue
            h = 0
            for b in gram:
                h = (h * 0x01000193 + b) & 0xFFFFFFFF
            x = ((h ^ (size * 0x3C6EF372 & 0xFFFFFFFF)) * 0x9E3779B1) & 0xFFFFFFFF
            out.append((((x ^ (x >> 15)) * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - bits))
    return out


TEXTS = ["a", "two words", "  blanks\n\n around \t it ", "über Größe 漢字かな 🎉", "same same same", "", None, "x" * 40, "the end."]


@pytest.mark.parametrize("piece", [1 << 20, 8, 13])
def test_features_equal_plain_ones(piece, monkeypatch, prose):
    """Also where a text is looked at in pieces: n-grams across the cuts are there."""
    monkeypatch.setattr(C, "PIECE", piece)
    texts = [*TEXTS, prose(60)]
    found = [[] for _ in texts]
    for ids, rows in C.features(pa.array(texts), 12):
        for i, r in zip(ids.tolist(), rows.tolist()):
            found[r].append(i)
    assert [sorted(x) for x in found] == [sorted(_plain_features(t, 12)) for t in texts]


def _plain_training(texts, labels, bits, dimensions, epochs, rate, seed):
    """The same descent, number by number; gives a function from a text to class probabilities."""
    k, random_state = len(C.CLASSES), np.random.default_rng(seed)
    vectors = random_state.uniform(-1 / dimensions, 1 / dimensions, (1 << bits, dimensions)).tolist()
    layer = random_state.normal(0, 1, (k, dimensions)).tolist()
    share = [labels.count(c) / len(labels) for c in range(k)]
    bias = [math.log(max(s, 1e-3)) for s in share]
    met, met_layer = [1e-8] * (1 << bits), [1e-2] * k
    weights = []
    for t in texts:
        ids = _plain_features(t, bits)
        weights.append({i: ids.count(i) / len(ids) for i in set(ids)})

    def forward(w):
        hidden = [sum(x * vectors[i][d] for i, x in w.items()) for d in range(dimensions)]
        z = [sum(a * h for a, h in zip(layer[c], hidden)) + bias[c] for c in range(k)]
        e = [math.exp(x - max(z)) for x in z]
        return hidden, [x / sum(e) for x in e]

    steps, done = epochs * len(texts), 0
    for _ in range(epochs):
        for d in random_state.permutation(len(texts)).tolist():
            done += 1
            w = weights[d]
            if not w:
                continue
            hidden, p = forward(w)
            error = [(c == labels[d]) - p[c] for c in range(k)]
            now = rate * (1 - done / (steps + 1))
            back = [sum(error[c] * layer[c][j] for c in range(k)) for j in range(dimensions)]
            for i, x in w.items():
                met[i] += x * x * sum(b * b for b in back)
                for j in range(dimensions):
                    vectors[i][j] += now * x / math.sqrt(met[i]) * back[j]
            for c in range(k):
                met_layer[c] += error[c] ** 2 * sum(h * h for h in hidden)
                for j in range(dimensions):
                    layer[c][j] += now / math.sqrt(met_layer[c]) * error[c] * hidden[j]
                bias[c] += now * 0.1 * error[c]
    return lambda text: forward(weights[texts.index(text)])[1]


def test_training_and_scores_equal_plain_ones():
    texts, labels = ["kind words here", "vile words", "a kind one", "", "vile vile thing", "dull"], [2, 1, 2, 0, 1, 0]
    how = {"bits": 8, "dimensions": 3, "epochs": 3, "rate": 0.5, "seed": 3}
    model = C.train(pa.array(texts), np.array(labels), **how)
    plain = _plain_training(texts, labels, **how)
    assert np.allclose(model.probabilities(pa.array(texts)), [plain(t) for t in texts], atol=2e-3)


def test_ties_at_the_thresholds(spark):
    rows = spark.createDataFrame([(0.5, 0.0), (0.5, 0.5), (0.49, 0.0), (1.0, 0.49)], "p_quality double, p_toxic double").select(F.struct("p_quality", "p_toxic").alias("s"))
    assert [r[0] for r in rows.select(C._kept("s")).collect()] == [True, False, False, True]


def test_a_posterior_of_just_one_half_is_kept(spark, monkeypatch):
    """Rules that say nothing leave the share of good documents, here one half."""
    monkeypatch.setattr(R, "learn", lambda voted: R.Accuracies(0.5, np.full(len(R.RULES), 0.5), np.full(len(R.RULES), 0.5)))
    docs = spark.createDataFrame([(1, "word"), (2, ""), (3, "of the words and more of them")], "doc_id long, text string")
    assert [(r.doc_id, r.posterior) for r in R.kept(docs).orderBy("doc_id").collect()] == [(1, 0.5), (3, 0.5)]
    assert sorted(r.doc_id for r in R.keep(docs).collect()) == [1, 3]


def test_scores_dont_depend_on_batches(prose):
    texts = pa.array([prose(n) for n in (1, 5, 900)] + ["", None, "x" * 70_000, "é " * 40_000])
    model = C.train(pa.array([prose(30), "bad " * 20, prose(20), "bad words " * 9]), np.array([2, 1, 2, 1]), bits=10, epochs=3)
    whole = model.probabilities(texts)
    each = np.concatenate([model.probabilities(texts.slice(i, 1)) for i in range(len(texts))])
    assert np.allclose(whole, each) and np.allclose(whole.sum(axis=1), 1)


def test_classifier_defined_results(spark, prose):
    random.seed(1)
    rows = [(i, ("awful rotten " if i % 2 else "kind gentle ") * 8 + prose(3)) for i in range(60)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows] + [(100, None, "x", 1.0), (101, "", "x", 1.0), (None, "kind gentle " * 9, "x", 1.0), (0, rows[0][1], "x", 1.0)], "doc_id long, text string, p_quality string, keep double")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)] + [(3, None, 0), (None, 1, 1), (999, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = C.fit(docs, labels)
    kept = C.classify(docs, model)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id < 60").collect())
    assert ids == [0, 0] + list(range(2, 60, 2))
    assert kept.where("doc_id IS NULL").count() == 1
    assert C.score(docs, model).count() == 64
    none = C.fit(docs, labels.limit(0))
    assert C.classify(docs, none).count() == 64
    one = C.fit(docs, labels.where("quality = 1"))
    assert C.classify(docs, one).count() == 64
    assert C.classify(docs.limit(0), model).count() == 0
    assert C.training_sample(docs, labels, most_bytes=100).count() < 10 and C.training_sample(docs, labels, most_docs=10).count() == 10


def test_sample_takes_present_documents_that_fit(spark, prose):
    docs = spark.createDataFrame([(i, "kind words " * 5) for i in range(40)] + [(100, "x" * 5000), (101, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (*range(40), 100, 101, *range(1000, 3000))], "doc_id long, quality int, toxic int")
    ids = lambda **how: {r.id for r in C.training_sample(docs, labels, **how).collect()}
    # labels of absent documents, or of those without a text, take up none of the bound
    assert ids(most_docs=41) == {*range(40), 100} and len(ids(most_docs=30)) == 30
    # neither a text above the bound nor one above what is left of it ends the sample
    assert ids(most_bytes=40 * 55) == set(range(40)) and len(ids(most_bytes=5100)) >= 1
    order = spark.createDataFrame([(i,) for i in range(20)], "doc_id long").orderBy(F.xxhash64("doc_id")).collect()
    second = order[1].doc_id
    mixed = spark.createDataFrame([(i, "y" * (900 if i == second else 50)) for i in range(20)], "doc_id long, text string")
    assert {r.id for r in C.training_sample(mixed, labels, most_bytes=940).collect()} == set(range(20)) - {second} - {r.doc_id for r in order[19:]}
    with pytest.raises(ValueError, match="usable labels"):
        C.fit(docs, labels.where("doc_id >= 1000"))
    with pytest.raises(ValueError, match="usable labels"):
        C.fit(docs, labels, most_bytes=10)
    assert C.classify(docs, C.fit(docs, labels.where("doc_id > 9999"))).count() == 42
    assert C.classify(docs.limit(0), C.fit(docs.limit(0), labels)).count() == 0


@pytest.fixture(scope="module")
def edge_docs(spark, prose):
    random.seed(9)
    rows = [(i, " ".join(x.capitalize() + " of the and it." if k % 9 == 0 else x for k, x in enumerate(prose(random.randint(5, 300)).split()))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "   \n\t "), (None, "the end of it."), (203, "$$$ %%% ### " * 200), (204, "BUY NOW!!! " * 100), (205, "line\n" * 50), (206, prose(60_000)), (206, "the end of it."), (207, "ü ß 漢字 🎉 " * 30), (208, "it's 'quoted' \"text\" \\ back % slash"), (209, "\n\na\n\nb\n")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_rules_equal_their_sql(spark, edge_docs, tmp_path):
    edge_docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    wanted = sorted(con.execute(R.sql()).fetchall(), key=str)
    assert sorted(map(tuple, R.kept(edge_docs).collect()), key=str) == wanted and 40 < len(wanted) < 92


def test_rules_defined_results(spark, edge_docs):
    wide = edge_docs.selectExpr("doc_id", "text", "1 AS v_symbols", "2 AS words", "3 AS __n", "4 AS posterior")
    kept = R.keep(wide)
    assert kept.columns == wide.columns and kept.count() == R.kept(edge_docs).count()
    ids = [r.doc_id for r in kept.collect()]
    assert not {200, 201, 202, 203, 204} & set(ids)
    assert R.keep(wide.limit(0)).count() == 0
    assert R.keep(wide.where("text IS NULL")).count() == 0


def test_estimated_accuracies_find_the_good_rules():
    random_state = np.random.default_rng(2)
    good = random_state.random(20_000) < 0.8
    accuracy = np.array([0.97, 0.9, 0.75, 0.97])
    votes = np.where(random_state.random((20_000, 4)) < accuracy, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[random_state.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    a = R.estimate(patterns, counts.astype(float))
    assert abs(a.share - 0.8) < 0.03 and np.abs(a.on_good - accuracy).max() < 0.05
