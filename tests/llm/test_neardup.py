import random
import re

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import bytewords as bw
from brindle.llm import neardup as N


def _corpus(prose):
    random.seed(3)
    texts = [prose(random.randint(20, 150)) for _ in range(60)]
    for base in texts[:12]:
        words = base.split()
        for _ in range(random.randint(1, 4)):
            near = words.copy()
            for _ in range(max(1, len(near) // 30)):
                near[random.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    return texts + [texts[0], texts[0].upper(), texts[5] + ".", "one", "one", "two words", "two words"]


def _brute(texts, threshold=N.THRESHOLD):
    """(class, links) of every text: word sets compared pair by pair, without anything of the module."""
    def shingles(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        return frozenset(tuple(words[i : i + N.SHINGLE]) for i in range(max(1, len(words) - N.SHINGLE + 1))) if words else frozenset()

    sets = [shingles(t) for t in texts]
    label, links = list(range(len(texts))), [set() for _ in texts]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and len(x & y) >= threshold * len(x | y):
                if x != y:
                    links[i].add(y), links[j].add(x)
                a, b = sorted((label[i], label[j]))
                label = [a if z == b else z for z in label]
    return {i: (g, len(n)) for i, (g, n) in enumerate(zip(label, links))}


def _found(frame):
    return {r.doc_id: (r.class_id, r.n_links) for r in frame.collect()}


def test_classes_and_links_equal_brute_force(spark, prose):
    texts = _corpus(prose)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    wanted = _brute(texts)
    assert _found(N.near_duplicates(docs)) == wanted and max(n for _, n in wanted.values()) > 3
    assert {r.doc_id for r in N.deduplicate(docs).collect()} == {i for i, (g, _) in wanted.items() if g == i}


@pytest.mark.parametrize("block", [3, 8])
def test_groups_and_buckets_of_many_blocks(spark, prose, monkeypatch, block):
    """Blocks so small that stars, buckets and groups all take several; near, less near and chained texts."""
    monkeypatch.setattr(N, "BLOCK", block)
    random.seed(5)
    base = prose(80).split()
    texts = [" ".join(base[:k] + [f"own{i}"] + base[k:]) for i, k in enumerate(random.choices(range(80), k=40))]
    texts += [" ".join(base[: 80 - k] + prose(k).split()) for k in range(8, 40, 4)]
    texts += [" ".join(base[k:] + prose(k).split()) for k in range(8, 40, 4)]
    texts += [prose(60) for _ in range(10)] + texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # one coordinate a band: every pair at the threshold is all but sure to meet
    assert _found(N.near_duplicates(docs, rows_a_band=1)) == _brute(texts)


def test_a_bucket_of_dissimilar_texts(spark, prose, monkeypatch):
    """A passage that all share makes buckets of texts below the threshold; none is linked, nor compared in one unit."""
    monkeypatch.setattr(N, "BLOCK", 16)
    passage = prose(40)
    texts = [f"{prose(45)} {passage}" for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert _found(N.near_duplicates(docs, rows_a_band=1)) == _brute(texts) == {i: (i, 0) for i in range(150)}


def test_repeated_ids_in_any_order(spark, prose):
    a, b, c = prose(50), prose(50), prose(50)
    rows = [(2, a), (2, b), (3, a + " end"), (4, b + " end"), (5, c), (1, c), (1, c), (6, None), (6, prose(9))]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        found = _found(N.near_duplicates(docs))
        assert found == {1: (1, 0), 2: (2, 1), 3: (2, 1), 4: (2, 1), 5: (1, 0), 6: (6, 0)}
        kept = sorted(((r.doc_id, r.text) for r in N.deduplicate(docs).collect()), key=str)
        assert [d for d, _ in kept] == [1, 2, 6] and kept == first if order is not rows else (first := kept)


def test_overlaps_are_set_intersections():
    random_state = np.random.default_rng(4)
    sets = [np.unique(random_state.integers(0, 60, n)) for n in (1, 5, 30, 0, 12, 40)]
    ids, ptr = np.concatenate(sets).astype(np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    both = N.overlaps(ids, ptr, np.arange(6), np.array([1, 3, 5]))
    assert all(both[i, k] == len(set(x.tolist()) & set(sets[j].tolist())) for i, x in enumerate(sets) for k, j in enumerate((1, 3, 5)) if i != j)


def test_sketch_estimates_and_is_always_full():
    random_state = np.random.default_rng(5)
    base = random_state.integers(1, 1 << 47, 900, dtype=np.uint64)
    for share in (0.2, 0.5, 0.8):
        n = int(600 * 2 * share / (1 + share))
        a, b = base[:600], np.concatenate([base[:n], base[600 : 1200 - n]])
        ids = np.concatenate([np.unique(a), np.unique(b)])
        s = N.sketch(ids, np.array([0, len(a), len(a) + len(b)]), 400)
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs((s[0] == s[1]).mean() - true) < 0.1
    for n in (1, 2, 7):
        s = N.sketch(np.arange(n, dtype=np.uint64), np.array([0, n]), 64)
        assert (s != np.uint64((1 << 64) - 1)).all()


def test_defined_results(spark, prose):
    long = prose(40_000)
    rows = [(1, long, 5, "a"), (2, long + " end", 5, "b"), (3, None, 1, "c"), (4, None, 1, "d"), (5, "", 1, "e"), (6, "  \n", 1, "f"), (7, "", 1, "g"), (None, long, 1, "h"), (8, "x y z w", 1, "i"), (8, "x y z w", 1, "j"), (9, "x y z w", 1, "k"), (10, "Größe ÜBER alles 東京都", 1, "l"), (11, "größe über ALLES 東京都!", 1, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, rep string")
    assert _found(N.near_duplicates(docs)) == {1: (1, 1), 2: (1, 1), 9: (8, 0), 8: (8, 0), 11: (10, 0), 10: (10, 0), **{i: (i, 0) for i in (3, 4, 5, 6, 7)}}
    kept = N.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x) == [1, 3, 4, 5, 6, 7, 8, 10] and ids.count(None) == 1
    assert N.near_duplicates(docs.limit(0)).count() == 0 and N.deduplicate(docs.limit(0)).count() == 0


def test_large_groups_of_one_bucket(spark, prose):
    base = prose(60).split()
    texts = [" ".join(base[:50] + [f"own{i}"] + base[50:]) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert _found(N.near_duplicates(docs)) == {i: (0, 399) for i in range(400)}


def test_words_across_pieces(prose):
    text = prose(3000)
    whole = bw.words(pa.array([text, None, "a"]))
    old, bw.CHUNK = bw.CHUNK, 97
    try:
        data, off = bw.utf8(pa.array([text, None, "a"]))
        assert sum(b - a for a, b, _, _ in bw.pieces(data, off, 97)) == len(data)
    finally:
        bw.CHUNK = old
    assert np.diff(whole.ptr).tolist() == [3000, 0, 1]
    assert (bw.words(pa.array([text.upper()])).hashes == whole.hashes[:3000]).all()
