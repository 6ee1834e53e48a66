"""Operator 5: near-duplicate groups by fast similarity sketching, banding and exact verification.

The sketch follows Dahlgaard, Knudsen and Thorup (FOCS 2017): t coordinates are filled in at most 2t rounds. In round
i < t every shingle is hashed to one coordinate and to a value in [i, i + 1); in round t + j every shingle is hashed to
a value for coordinate j alone, so that each coordinate is sure to be filled. A coordinate keeps its least value, and
two sets agree in a coordinate with probability equal to their Jaccard similarity, with Chernoff-type concentration.

Plan: one Arrow pass over the texts makes a digest, a size and bands per document; texts with one shingle set are one
set from then on, however many copies there are. Sets meet in buckets of a band. Every set is compared with its bucket's
least one; what is then left in different groups of one bucket, the least one aside, is compared in blocks. So all pairs
that share a band are settled, by verified links or by links in between, none is dropped on an estimate, and groups are
the connected components. Links are then counted within each group over all its pairs, whether they share a band or not.

Comparing is done by units of bounded size, at most BLOCK sets and BLOCK_SHINGLES shingles (or one set with more) a side:
a task holds the sets of a unit and hands on counts or links, never pairs; a bucket or group of any size is many units.
In a group of several blocks the Jaccard distance, a metric, spares most units: two sets whose distances to the group's
least set add up to at most 1 - threshold are linked, two whose distances differ by that or more aren't, and only what
neither says is compared. A group of close copies costs one comparison a member.

Defined results
  null doc_id                  never compared, no row in ``near_duplicates``, kept
  null, empty or wordless text never compared: a class of its own without a link, kept
  fewer words than a shingle   the text is one shingle
  repeated rows                one document
  one doc_id, several texts    one document: whatever is near one of its texts is in its class; its links are those of the text that has most
  ties                         the least doc_id of a group stays, of its rows the least by a hash of text and columns
  extra or clashing columns    untouched; only the id and text columns are read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import bytewords as bw
from brindle.plans.components import components
from brindle.plans.scratch import hand_on, materialize, materialize_by, scope, settled, tasks_for

SHINGLE, COORDINATES, ROWS, THRESHOLD = 3, 160, 4, 0.5
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: Distances to a group's least set are known in steps of 1 / STEPS, rounded up.
STEPS = 64
#: About what a shingle's share of a text takes, for the number of tasks.
SHINGLE_BYTES = 8
ID_BITS = 48
SKETCH_TYPE = "struct<a: bigint, b: bigint, n: bigint, bands: array<bigint>>"


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit shingle ids of every row, flat, and the row bounds."""
    h, rows = bw.windows(bw.words(texts), size)
    key = np.unique((rows.astype(np.uint64) << np.uint64(ID_BITS)) | (h >> np.uint64(64 - ID_BITS)))
    owner = (key >> np.uint64(ID_BITS)).astype(np.int64)
    return key & np.uint64((1 << ID_BITS) - 1), np.searchsorted(owner, np.arange(len(texts) + 1))


def sketch(ids: np.ndarray, ptr: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of every set; a coordinate is (round << 40) | value. Empty sets have all ones."""
    n, none = len(ptr) - 1, np.uint64((1 << 64) - 1)
    out = np.full(n * t, none, np.uint64)
    sizes = np.diff(ptr)
    open_rows = np.flatnonzero(sizes > 0)
    for i in range(2 * t):
        if not len(open_rows):
            break
        if len(open_rows) == n:
            x, owner = ids, np.repeat(np.arange(n), sizes)
        else:
            x, owner = _gather(ids, ptr, sizes, open_rows)
        h = bw.mix(x * np.uint64(0x9FB21C651E98DF25) + np.uint64((i + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1)))
        value = np.uint64(i << 40) | (h & np.uint64((1 << 40) - 1))
        at = owner * t + (((h >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24)).astype(np.int64) if i < t else owner * t + (i - t)
        np.minimum.at(out, at, value)
        full = (out.reshape(n, t)[open_rows] != none).all(axis=1)
        open_rows = open_rows[~full]
    return out.reshape(n, t)


def _gather(ids, ptr, sizes, rows):
    count = sizes[rows]
    owner = np.repeat(rows, count)
    start = np.repeat(ptr[:-1][rows] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return ids[start + np.arange(len(owner))], owner


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band of ``rows`` coordinates; the band's number is part of the key."""
    n, t = coordinates.shape
    parts = coordinates[:, : t - t % rows].reshape(n, -1, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        key = bw.mix(key * np.uint64(0x100000001B3) + parts[:, :, k])
    return key


def _sketch_udf(size: int, t: int, rows: int):
    def run(texts: pa.Array) -> pa.Array:
        out = [pa.array([], _arrow_type())]
        for part in bw.row_slices(texts):
            ids, ptr = shingle_sets(part, size)
            n, sizes = len(part), np.diff(ptr)
            digest = []
            for salt in (0x1B873593CC9E2D51, 0x52DCE729DA3ED6C5):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bw.mix(ids ^ np.uint64(salt)), dtype=np.uint64)])
                digest.append((total[ptr[1:]] - total[ptr[:-1]]).view(np.int64))
            keys = bands(sketch(ids, ptr, t), rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1).view(np.int64)))
            out.append(pa.StructArray.from_arrays([pa.array(digest[0]), pa.array(digest[1]), pa.array(sizes.astype(np.int64)), lists], ["a", "b", "n", "bands"], mask=pa.array(sizes == 0)))
        return pa.concat_arrays(out)

    return F.arrow_udf(run, SKETCH_TYPE)


def _arrow_type() -> pa.DataType:
    return pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])


def overlaps(ids: np.ndarray, ptr: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each row of ``left`` shares with each other one of ``right``. Rows are numbers into ``ptr``."""
    out = np.zeros((len(left), len(right)))
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], row[order]
    again = np.zeros(len(ids), bool)
    again[1:] = ids[1:] == ids[:-1]
    shared = again.copy()
    shared[:-1] |= again[1:]  # what one row alone has needs no column
    row, column = row[shared], np.cumsum(~again[shared]) - 1
    width = max(1, (1 << 22) // max(1, len(ptr)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        has = np.zeros((len(ptr) - 1, min(width, int(column[-1]) + 1 - start)), np.float32)
        has[row[a:b], column[a:b] - start] = 1
        out += has[left] @ has[right].T
    return out


def _similar(ids, ptr, left, right, threshold: float) -> np.ndarray:
    """Which pairs of left and right reach the threshold."""
    size, both = np.diff(ptr), overlaps(ids, ptr, left, right)
    return both >= threshold * (size[left][:, None] + size[right][None, :] - both)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows in a row that agree in the first ``keys`` columns."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        new = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(int(c[a]) for c in columns)
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            now = key
    if held:
        yield pa.Table.from_batches(held)


def _by_unit(rows: DataFrame, texts: DataFrame, keys: list[str], work, kind: str, shingle: int) -> DataFrame:
    """``work(columns, ids, ptr)`` over every unit: rows that agree in ``keys``, with their shingle sets; it gives columns of ``kind``.

    rows: keys, other whole numbers, ``n`` and ``node``, whose text comes from ``texts``.
    """
    rows = materialize(rows, "units")
    total = rows.agg(F.sum("n")).first()[0] or 0
    others = [c for c in rows.columns if c not in keys]
    laid = rows.join(texts, "node").select(*keys, *others, "text").repartition(tasks_for(rows.sparkSession, SHINGLE_BYTES * total), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for unit in _runs(batches, len(keys)):
            ids, ptr = shingle_sets(unit.column("text").combine_chunks(), shingle)
            made.append(work({c: unit.column(c).to_numpy() for c in unit.column_names if c != "text"}, ids, ptr))
            if len(made) == 256:
                yield _batch(made)
                made = []
        if made:
            yield _batch(made)

    return laid.mapInArrow(run, kind)


def _batch(made: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: np.concatenate([m[c] for m in made]).astype(np.int64) for c in made[0]})


def _blocks(count: str = "c", shingles: str = "s") -> Column:
    """How many blocks so many sets make."""
    return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("bigint")


def _salt(blocks: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(blocks))


def _in_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``k``, the number of blocks of their group, and ``salt``, their block."""
    k = rows.groupBy(*keys).agg(F.count("*").alias("c"), F.sum("n").alias("s")).select(*keys, _blocks().alias("k")).where("k > 1")
    return rows.join(materialize(k, "blocks"), keys, "left").withColumn("k", F.coalesce("k", F.lit(1).cast("bigint"))).withColumn("salt", _salt("k"))


def _pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """Every row once for each pair of blocks that its own is part of: ``u`` and ``v``, and ``side``: 0 for u's, 1 for v's, 2 where they are one."""
    each = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    side = F.when(F.col("salt") == F.col("other"), 2).when(F.col("salt") < F.col("other"), 0).otherwise(1).cast("bigint")
    return each.select("*", F.least("salt", "other").alias("u"), F.greatest("salt", "other").alias("v"), side.alias("side")).drop("k", "salt", "other")


def _stars(stars: DataFrame, sizes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``(node, hub, shared, total)`` of each pair of a node and its hub: shingles of both, and of either."""
    split = _in_blocks(stars.join(sizes, "node"), ["hub"]).select("hub", "salt", "node", "n", F.lit(0).cast("bigint").alias("own"))
    hubs = split.select("hub", "salt").distinct().join(sizes.withColumnRenamed("node", "hub"), "hub").select("hub", "salt", F.col("hub").alias("node"), "n", F.lit(1).cast("bigint").alias("own"))

    def work(x, ids, ptr):
        left, right = np.flatnonzero(x["own"] == 1)[:1], np.flatnonzero(x["own"] == 0)
        both = overlaps(ids, ptr, left, right)[0]
        size = np.diff(ptr)
        return {"node": x["node"][right], "hub": x["hub"][right], "shared": both, "total": size[right] + size[left[0]] - both}

    return _by_unit(split.unionByName(hubs), texts, ["hub", "salt"], work, "node bigint, hub bigint, shared bigint, total bigint", shingle)


def _between(mixed: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """``(node, hub)``: links that join the groups, by ``label``, which a bucket's sets are in. mixed: (key, node, n, label)."""
    rows = _pairs_of_blocks(_in_blocks(mixed, ["key"]))

    def work(x, ids, ptr):
        left, right = np.flatnonzero(x["side"] != 1), np.flatnonzero(x["side"] != 0)
        label, root, found = x["label"], {}, []

        def top(g):
            while g in root:
                g = root[g]
            return g

        good = _similar(ids, ptr, left, right, threshold) & (label[left][:, None] != label[right][None, :])
        for i, j in zip(*np.nonzero(good)):
            a, b = top(int(label[left[i]])), top(int(label[right[j]]))
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((x["node"][left[i]], x["node"][right[j]]))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return {"node": a, "hub": b}

    return _by_unit(rows, texts, ["key", "u", "v"], work, "node bigint, hub bigint", shingle)


def _links(groups: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """``(node, links)``: how many sets of its group each set reaches the threshold with. groups: (node, label, n)."""
    split = _in_blocks(groups, ["label"])
    none = F.lit(0).cast("bigint")
    rows = split.where("k = 1").select("label", *(none.alias(c) for c in ("c1", "u", "c2", "v")), F.lit(2).cast("bigint").alias("side"), "node", "n")
    large = materialize(split.where("k > 1").select("node", "label", "n"), "large")
    sure = None
    if not large.isEmpty():
        far = _stars(large.where("node != label").select("node", F.col("label").alias("hub")), large.select("node", "n"), texts, shingle)
        cell = far.select("node", F.ceil((F.col("total") - F.col("shared")) * STEPS / F.col("total")).cast("bigint").alias("cell"))
        large = materialize(large.join(cell, "node", "left").withColumn("cell", F.coalesce("cell", none)), "large")
        count = large.groupBy("label", "cell").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        count = materialize(count.select("label", F.col("cell").alias("c2"), "c", _blocks().alias("k2")), "cells")
        most = int(STEPS * (1 - threshold))
        met = large.join(count.select("label", F.col("c2").alias("cell"), F.col("k2").alias("k")), ["label", "cell"]).withColumn("salt", _salt("k")).join(count, "label")
        linked = F.col("cell") + F.col("c2") <= most
        sure = met.where(linked).groupBy("node", "cell").agg(F.sum("c").alias("c")).select("node", (F.col("c") - F.when(2 * F.col("cell") <= most, 1).otherwise(0)).alias("links"))
        open_ = met.where(~linked & (F.abs(F.col("cell") - F.col("c2")) - 1 < STEPS * (1 - threshold)))
        open_ = open_.withColumn("other", F.explode(F.sequence(none, F.col("k2") - 1)))
        mine, its = F.struct(F.col("cell").alias("c"), F.col("salt").alias("s")), F.struct(F.col("c2").alias("c"), F.col("other").alias("s"))
        side = F.when(mine == its, 2).when(mine < its, 0).otherwise(1).cast("bigint")
        open_ = open_.select("label", F.least(mine, its).alias("p"), F.greatest(mine, its).alias("q"), side.alias("side"), "node", "n")
        rows = rows.unionByName(open_.select("label", F.col("p.c").alias("c1"), F.col("p.s").alias("u"), F.col("q.c").alias("c2"), F.col("q.s").alias("v"), "side", "node", "n"))

    def work(x, ids, ptr):
        left, right = np.flatnonzero(x["side"] != 1), np.flatnonzero(x["side"] != 0)
        good = _similar(ids, ptr, left, right, threshold) & (x["node"][left][:, None] != x["node"][right][None, :])
        nodes, links = x["node"][left], good.sum(axis=1)
        if len(left) and x["side"][left[0]] != 2:
            nodes, links = np.concatenate([nodes, x["node"][right]]), np.concatenate([links, good.sum(axis=0)])
        return {"node": nodes, "links": links}

    found = _by_unit(rows, texts, ["label", "c1", "u", "c2", "v"], work, "node bigint, links bigint", shingle)
    found = found if sure is None else found.unionByName(sure)
    return found.groupBy("node").agg(F.sum("links").alias("links"))


def _source(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``(doc_id, node, text)``, and whether a doc_id has several texts. A node is its doc_id, or, where that has several texts, a hash of both."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    several = source.withColumn("h", F.xxhash64("text")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low != high")
    several = materialize(several.select("doc_id", F.lit(True).alias("several")), "several")
    if several.isEmpty():
        return source.withColumn("node", F.col("doc_id")), False
    return source.join(several, "doc_id", "left").select("doc_id", "text", F.when(F.col("several"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("node")), True


@settled
def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, coordinates: int, rows: int, threshold: float, count_links: bool) -> DataFrame:
    source, several = _source(docs, id_col, text_col)
    made = source.withColumn("s", _sketch_udf(shingle, coordinates, rows).asNondeterministic()("text"))
    made = materialize(made.select("doc_id", "node", "s.*"), "sketches")
    sets = made.where("a IS NOT NULL").groupBy("a", "b").agg(F.min("node").alias("node"), F.min("doc_id").alias("first_doc"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    sets = materialize(sets, "sets")
    members = sets.select("node", F.explode(F.array_distinct("bands")).alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1")
    met = materialize(members.join(materialize(shared.select("key", "hub"), "shared"), "key").where("node != hub"), "met")
    sizes = materialize(met.select("node").union(met.select("hub")).distinct().join(sets.select("node", "n"), "node"), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    repeated = not made.groupBy("node").count().where("count > 1").isEmpty()
    # the only shuffle of texts by node: of those that met another; all comparing joins against its buckets
    texts = source.select("node", "text")
    texts = materialize_by(texts.dropDuplicates(["node"]) if repeated else texts, "texts", "node", sizes, SHINGLE_BYTES * total)

    linked = F.col("shared") >= threshold * F.col("total")
    good = materialize(_stars(met.select("node", "hub").distinct(), sizes, texts, shingle).where(linked).select("node", "hub"), "links")
    label = components(good, "node", "hub")
    mixed = materialize(met.join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "labelled")
    h = F.xxhash64("node")
    keys = mixed.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("c"), F.sum(h.cast("decimal(38,0)")).alias("x"), F.bit_xor(h).alias("y"))
    keys = materialize(keys.where("least != most").groupBy("c", "x", "y").agg(F.min("key").alias("key")), "mixed")  # buckets of the same sets are one
    good = materialize(good.unionByName(_between(mixed.join(keys, "key", "left_semi").join(sizes, "node"), texts, shingle, threshold)), "links")
    label = components(good, "node", "hub")

    sets = sets.select("a", "b", "node", "first_doc").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if count_links:
        groups = materialize(label.join(sizes, "node"), "groups")
        sets = sets.join(_links(groups, texts, shingle, threshold), "node", "left")
    else:
        sets = sets.withColumn("links", F.lit(None).cast("bigint"))
    sets = materialize(sets, "labels")
    if several:  # texts of one doc_id belong together
        held = materialize(made.where("a IS NOT NULL").join(sets, ["a", "b"]).select("doc_id", "label").distinct(), "held")
        joined = components(held.join(held.groupBy("doc_id").agg(F.min("label").alias("least")), "doc_id").where("label != least"), "label", "least")
        sets = sets.join(joined.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").withColumn("label", F.coalesce("top", "label"))
    first = sets.groupBy("label").agg(F.min("first_doc").alias("class_id"))
    sets = materialize(sets.join(first, "label").select("a", "b", "class_id", "links"), "classes")
    out = made.select("doc_id", "a", "b").join(sets, ["a", "b"], "left")
    out = out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("n_links"))
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, coordinates: int = COORDINATES, rows_a_band: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, class_id, n_links)``: one row for each document.

    Documents are near-duplicates if the Jaccard similarity of their word-shingle sets is at least ``threshold``; classes
    are closed under that relation, and ``class_id`` is the least doc_id of the class. ``n_links`` is how many other
    shingle sets of the class are near-duplicates of the document's; copies of one set count once, and not for each other.
    """
    return _classes(docs, id_col, text_col, shingle, coordinates, rows_a_band, threshold, True)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, coordinates: int = COORDINATES, rows_a_band: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those of which a class keeps another, by ``near_duplicates``; columns unchanged.

    Rows that share a doc_id are one document, of which one row stays. Rows without a doc_id all stay.
    """
    # rows as one column, so that whatever they hold clashes with nothing
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    order = F.struct(F.xxhash64(F.col(f"`{text_col}`")).alias("t"), F.xxhash64(F.to_json(row)).alias("r"))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("key"), row.alias("row"))
    with scope(docs.sparkSession) as made:
        found = _classes(docs, id_col, text_col, shingle, coordinates, rows_a_band, threshold, False)
        gone = materialize(found.where("doc_id != class_id").select(F.col("doc_id").alias("key")), "gone")
        again = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 AND key IS NOT NULL").select("key"), "again")
        hand_on(made, 2)  # both tables are read by the result
    kept = rows.join(gone, "key", "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    once = kept.join(again, "key", "left_anti").select("row.*")
    some = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("key"), row.alias("row"), order.alias("order")).join(gone, "key", "left_anti").join(again, "key", "left_semi")
    return once.unionByName(some.groupBy("key").agg(F.min_by("row", "order").alias("row")).select("row.*"))
