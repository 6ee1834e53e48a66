"""Operator 2: best-two-fit packing of documents into training sequences of a fixed length.

Lengths are token counts of whole texts in the vocabulary of ``tokens``, so starts and lengths are places in the token lists
that ``tokenfile`` writes. Other units are options: a capacity given is one in UTF-8 bytes, or in a named column's counts. A bin is filled greedily, largest document first and
then always the largest that fits. When nothing fits any more, the bin's smallest document is put back if two unpacked
documents fit the gap that it leaves, and fill it better; of all such pairs the tightest is taken.

Documents longer than a bin are cut into full bins and a rest that is packed like a document. Bins are made within
groups of documents picked by a hash of doc_id; there are enough documents in a group for its last bins not to matter,
and their number follows the corpus, so that every task has the same work at any scale. Texts are encoded once, where they
are read; only ids and lengths are written, and move.

Defined results
  null or empty text, length 0 or null   in no bin
  null doc_id                            packed; the list of ids has a null there
  repeated rows                          each row is packed by itself
  ties                                   of equal lengths the least doc_id goes first
  no document                            no bin
  extra or clashing columns              not read
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import tokens
from brindle.plans.scratch import materialize

CAPACITY, GROUP_TOKENS = 8192, 1 << 26
BIN_TYPE = "pack_group bigint, pack_bin bigint, n_tokens bigint, doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>"


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions into ``lengths``, each at most ``capacity`` long in sum. Equal lengths are taken in order."""
    order = np.argsort(lengths, kind="stable")
    sizes, first, count = np.unique(lengths[order], return_index=True, return_counts=True)
    left = np.zeros(capacity + 1, np.int64)
    taken = {int(s): (int(f), int(f + c)) for s, f, c in zip(sizes, first, count)}
    left[sizes] = count
    stock: list[int] = sizes.tolist()  # sizes with an unpacked document, ascending

    def take(size: int) -> int:
        at, end = taken[size]
        taken[size] = (at + 1, end)
        left[size] -= 1
        if at + 1 == end:
            del stock[bisect_right(stock, size) - 1]
        return int(order[at])

    bins = []
    while stock:
        size = stock[-1]
        own, held, gap = [take(size)], [size], capacity - size
        while stock and stock[0] <= gap:
            size = stock[bisect_right(stock, gap) - 1]
            own.append(take(size))
            held.append(size)
            gap -= size
        small = held[-1]  # sizes fall, so the last is the least
        if gap and len(stock) and stock[0] < small + gap:
            pair = _tightest_pair(stock, left, small + gap, small)
            if pair:
                back = own.pop()
                a, b = take(pair[0]), take(pair[1])
                _put_back(small, back, taken, left, stock, order)
                own += [a, b]
        bins.append(own)
    return bins


def _put_back(size, item, taken, left, stock, order) -> None:
    at, end = taken[size]
    taken[size] = (at - 1, end)
    order[at - 1] = item
    if not left[size]:
        stock.insert(bisect_right(stock, size), size)
    left[size] += 1


def _tightest_pair(stock: list[int], left: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """Sizes of the two unpacked documents with the largest sum of at most ``room``, if that is above ``more_than``."""
    fit = np.array(stock[: bisect_right(stock, room)])
    if not len(fit):
        return None
    mate = np.searchsorted(fit, room - fit, side="right") - 1
    same = (mate >= 0) & (fit[mate] == fit) & (left[fit] < 2)
    mate = np.where(same, mate - 1, mate)
    total = np.where(mate >= 0, fit + fit[np.maximum(mate, 0)], -1)
    k = int(total.argmax())
    return (int(max(fit[k], fit[mate[k]])), int(min(fit[k], fit[mate[k]]))) if total[k] > more_than else None


def _pack_group(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("length", "ascending")])
        group = rows.column("pack_group")[0].as_py()
        ids, length = rows.column("doc_id"), rows.column("length").to_numpy()
        ids_null = np.asarray(ids.is_null())
        ids = ids.fill_null(0).to_numpy()
        full = length // capacity
        which, start, size = [], [], []
        for k in np.flatnonzero(full):
            for p in range(full[k]):
                which.append([k]), start.append([p * capacity]), size.append([capacity])
        rest = np.flatnonzero(length % capacity)
        for own in best_two_fit((length % capacity)[rest], capacity):
            k = rest[own]
            which.append(k), start.append(full[k] * capacity), size.append(length[k] % capacity)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in which])]).astype(np.int32)
        flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (which, start, size)]
        names = pa.array(ids[flat[0]], mask=ids_null[flat[0]]) if len(flat[0]) else pa.array([], pa.int64())
        lists = [pa.ListArray.from_arrays(pa.array(bounds), x) for x in (names, pa.array(flat[1]), pa.array(flat[2]))]
        total = np.add.reduceat(flat[2], bounds[:-1]) if len(which) else np.zeros(0, np.int64)
        return pa.table([pa.array(np.full(len(which), group)), pa.array(np.arange(len(which))), pa.array(total), *lists], ["pack_group", "pack_bin", "n_tokens", "doc_ids", "starts", "lengths"])

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    sequence_tokens: int = CAPACITY,
    vocabulary: str = tokens.VOCABULARY,
    length_col: str | None = None,
    capacity: int | None = None,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row a bin: its group and number, tokens used, and for each piece the doc_id, where it starts and its length.

    Bins hold ``sequence_tokens`` tokens of the vocabulary. With ``length_col`` its counts are lengths, and with a
    ``capacity`` alone UTF-8 bytes; either way ``capacity`` and all that is returned are in that unit.
    """
    text = F.col(text_col).cast("string")
    counted = length_col is None and capacity is None
    length = tokens.counter(docs.sparkSession, vocabulary)(text) if counted else F.col(length_col) if length_col else F.octet_length(text)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), length.cast("bigint").alias("length"))
    rows = (materialize(rows, "lengths") if counted else rows).where("length > 0")
    capacity = capacity or sequence_tokens
    total = rows.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / group_tokens))
    rows = rows.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("length"))), F.lit(groups)))
    # a number of partitions of its own: rows are so slim that by bytes all groups would share one task
    tasks = min(groups, 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "pack_group").groupBy("pack_group").applyInArrow(_pack_group(capacity), BIN_TYPE)


def sequences(bins: DataFrame, tokens_table: DataFrame) -> DataFrame:
    """``(pack_group, pack_bin, input_ids)``: the token ids of every bin, its pieces one after the other, at most a bin's capacity.

    bins: of ``pack`` in tokens. tokens_table: ``(doc_id, token_ids)`` as ``tokenfile`` writes it, one row a document; a
    repeated doc_id is an error, since starts then name no place. Pieces without a doc_id have no ids to be found by: an
    error too. The ids move once, each piece by itself.
    """
    piece = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("doc_ids") - 1).alias("at"), "doc_ids", "starts", "lengths")).alias("p")
    pieces = bins.select("pack_group", "pack_bin", piece).select("pack_group", "pack_bin", "p.at", F.col("p.doc_ids").alias("doc_id"), "p.starts", "p.lengths")
    one = tokens_table.groupBy("doc_id").agg(F.count("*").alias("n"), F.any_value("token_ids").alias("token_ids"))
    ids = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several token lists of document "), F.col("doc_id").cast("string"))).cast("array<int>"))
    ids = ids.when(F.col("token_ids").isNull(), F.raise_error(F.concat(F.lit("no token list of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("array<int>"))
    held = pieces.join(one, "doc_id", "left").select("pack_group", "pack_bin", F.struct("at", ids.otherwise(F.slice("token_ids", (F.col("starts") + 1).cast("int"), F.col("lengths").cast("int"))).alias("ids")).alias("x"))
    inside = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["ids"])
    return held.groupBy("pack_group", "pack_bin").agg(F.flatten(inside).alias("input_ids"))
