"""Operator 4: benchmark decontamination by canonical templates.

Words of a text become template words: numbers, names and units of measure turn into typed placeholders (runs of one
type into one), all else is folded. Every window of WINDOW template words is hashed, documents' windows meet the
benchmark's by a hash join, and the slots, the words that placeholders stand for, must be consistent along each
alignment: a window at odds with what a value of the item meets at most of its places doesn't count, unless its slots
are the item's own; where a value has no such majority, only windows with the item's own slots count. So a question is caught with other names and
numbers in it too, but not a text that merely shares the frame while mixing up its slots.

There are two templates of each text, and its folded words as they are. In the first, numbers and units are slots and all other words literal whatever
their case; in the second, capitalised words are names as well, but for stop words that begin a sentence. The third kind has no slots: its windows, of
which no share of literals is asked, find copies word for word, also of items that are all numbers and measures.

Plan: one Arrow pass makes windows, keeping those whose hash falls on a bit that a window of the benchmark has set; the
others never leave the worker. The map of bits is broadcast: 16 bits a hash, and FILTER_BITS as its logarithm at most,
64 MB, however large the benchmark; a fuller map lets more windows through, which the join then drops, so results are the
same. The join, the consistency check and the count of matched windows are built-in operators.

A document leaks an item if at least half of the item's windows, or MANY of them, are matched consistently; MANY
neighbouring windows are thirteen template words in a row. An item shorter than WINDOW is one window of its whole length.
Words count as they are in the third kind.

What is given up, by definition of a template: an item of fewer than MIN_WORDS template words, which any text may hold by
chance, is only found where a document is that item and nothing else; and an item that has more slots than other words
is found word for word, but not with other numbers and names in it, for its frame says next to nothing.

Defined results
  null or empty text          no leak, kept
  null doc_id                 reported with a null, dropped by ``decontaminate``
  repeated rows               each is reported, once for every item; one doc_id with several texts has their union
  null or empty items         match nothing
  short items                 fewer than MIN_WORDS words match the documents that have just these words
  repeated items              reported under each item_id
  no document, no benchmark   no leak
  extra or clashing columns   carried along untouched by ``decontaminate``
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import bytewords as bw
from brindle.plans.scratch import hand_on, materialize, scope

WINDOW, MIN_WORDS, LITERALS, SHARE, MANY = 8, 5, 0.5, 0.5, 6
FILTER_BITS = 29
NUMBERS = "zero two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = (
    "km kilometer kilometers kilometre kilometres m meter meters metre metres cm mm mile miles yard yards foot feet ft inch inches kg g mg gram grams kilogram kilograms "
    "lb lbs pound pounds ounce ounces oz ton tons tonne tonnes l ml liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours hr day days "
    "week weeks month months year years dollar dollars cent cents euro euros percent degree degrees mph kmh kwh watt watts volt volts"
).split()
STOP = (
    "the of and to in is that for with was as it be by this from are a an on at or if then so but he she they we you i his her its their there what when where who how which why "
    "der die das und den von zu mit ist nicht ein eine auf im le la les de des du et en un une est que qui dans pour sur el los las y del se por con para al"
).split()
NUMBER, UNIT, NAME = 1, 2, 3
EXACT, ALONE = 2, 3
WINDOW_TYPE = "array<struct<hash: bigint, pos: int, kind: int, slots: array<bigint>, spots: array<int>>>"
_SLOT_HASH = bw.mix(np.arange(4, dtype=np.uint64) + np.uint64(0x5107))


def _known(words: list[str]) -> np.ndarray:
    return np.sort(bw.words(pa.array(words)).hashes)


def _in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def _bit(x: np.ndarray, size: int) -> np.ndarray:
    return (x >> np.uint64(64 - (size * 8).bit_length() + 1)).astype(np.int64)


def _marked(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether the bits of hashes are set in a map of a power of two bits."""
    at = _bit(x, len(marks))
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _marks(hashes: DataFrame, most_bits: int) -> np.ndarray:
    """The map of bits of all hashes, made by one task that reads them as they come."""
    bits = max(3, min(most_bits, (16 * hashes.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = _bit(batch.column(0).to_numpy().view(np.uint64), len(marks))
            np.bitwise_or.at(marks, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([marks.tobytes()], pa.binary())], ["marks"])

    row = hashes.coalesce(1).mapInArrow(run, "marks binary").first()
    return np.frombuffer(row["marks"], np.uint8) if row else np.zeros(1 << (bits - 3), np.uint8)


_sets: list[np.ndarray] = []


def templates(texts: pa.Array):
    """For both templates and the words as they are (EXACT): (kind, hash of each template word, its slot type or 0, its value, row bounds)."""
    if not _sets:
        _sets[:] = [_known(NUMBERS), _known(UNITS), _known(STOP)]
    data, off = bw.utf8(texts)
    n = len(off) - 1
    parts, counts = [], np.zeros(n, np.int64)
    for a, b, inner, rows in bw.pieces(data, off):
        raw = data[a:b]
        low, word, new, capital = bw.fold(raw)
        s, e, k = bw.spans(word, inner, new)
        np.add.at(counts, rows, k)
        if not len(s):
            continue
        # a word begins a sentence after . ! ? : or a line's end, or where a text begins
        ends = np.cumsum(np.isin(raw, np.frombuffer(b".!?:\n", np.uint8)), dtype=np.int64)
        first = np.ones(len(s), bool)
        first[1:] = ends[s[1:]] > ends[e[:-1] - 1]
        first[np.searchsorted(s, inner[:-1])[k > 0] if len(rows) > 1 or a == off[rows[0]] else []] = True
        digit = (raw[s] >= 48) & (raw[s] <= 57)
        parts.append((bw.span_hashes(low, s, e), digit, capital[s], first))
    ptr = np.concatenate([[0], np.cumsum(counts)])
    h, digit, capital, first = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, bool)] * 3)
    row = np.repeat(np.arange(n), counts)
    same = np.zeros(len(h), bool)
    same[1:] = row[1:] == row[:-1]
    slot = np.where(digit | _in(h, _sets[0]), NUMBER, 0)
    after = np.zeros(len(h), bool)
    after[1:] = slot[:-1] == NUMBER
    slot[after & same & (slot == 0) & _in(h, _sets[1])] = UNIT
    yield 0, *_collapse(h, slot, row, same, n)
    named = slot.copy()
    named[(slot == 0) & capital & ~(first & _in(h, _sets[2]))] = NAME
    yield 1, *_collapse(h, named, row, same, n)
    yield EXACT, *_collapse(h, np.zeros_like(slot), row, same, n)


def _collapse(h, slot, row, same, n):
    """Runs of one slot type become one template word, whose value is that of all its words."""
    go_on = np.zeros(len(h), bool)
    go_on[1:] = same[1:] & (slot[1:] > 0) & (slot[1:] == slot[:-1])
    heads = np.flatnonzero(~go_on)
    value = h.copy()
    if len(heads) < len(h):
        place = np.arange(len(h)) - np.repeat(heads, np.diff(np.append(heads, len(h))))
        value = np.add.reduceat(bw.mix(h + place.astype(np.uint64)), heads)
    slot = slot[heads]
    return np.where(slot > 0, _SLOT_HASH[slot], h[heads]), slot, value, np.searchsorted(row[heads], np.arange(n + 1))


def windows(texts: pa.Array, size: int, whole: bool, known: np.ndarray | None, sizes: tuple[int, ...] = ()):
    """Per template and size: (kind, size, hash, row, position, slot types, values) of the windows.

    whole: a text shorter than ``size`` is one window of all its words; else windows of each of ``sizes`` are made too.
    known: a map of bits, by its hash, that a window must have to be listed.
    """
    for kind, h, slot, value, ptr in templates(texts):
        n = np.diff(ptr)
        row = np.repeat(np.arange(len(n)), n)
        short = np.unique(n[(n < size) & (n >= MIN_WORDS)]).tolist() if whole else [s for s in sizes if s < size]
        literal = np.concatenate([[0], np.cumsum(slot == 0)])
        for s in [size, *short]:
            room = len(h) - s + 1
            if room <= 0:
                continue
            total = np.full(room, kind * 64 + s, np.uint64)
            for k in range(s):
                total = total * np.uint64(0x100000001B3) + h[k : k + room]
            total = bw.mix(total)
            ok = (row[:room] == row[s - 1 :]) & (literal[s:] - literal[:room] >= LITERALS * s)  # all words of EXACT are literal
            if s < size and whole:
                ok &= n[row[:room]] == s
            at = np.flatnonzero(ok)
            if known is not None:
                at = at[_marked(total[at], known)]
            yield kind, s, total[at], row[at], at - ptr[row[at]], at, slot, value
        for s in range(1, MIN_WORDS) if kind == EXACT else ():  # texts of few words, as a whole
            at = ptr[:-1][n == s]
            total = np.full(len(at), ALONE * 64 + s, np.uint64)
            for k in range(s):
                total = total * np.uint64(0x100000001B3) + h[at + k]
            total = bw.mix(total)
            kept = np.flatnonzero(_marked(total, known)) if known is not None else np.arange(len(at))
            yield ALONE, s, total[kept], row[at[kept]], np.zeros(len(kept), np.int64), at[kept], slot, value


def _lists(texts: pa.Array, size: int, whole: bool, known, sizes) -> pa.Array:
    out = [pa.array([], _arrow_type())]
    for part in bw.row_slices(texts):
        found = []
        for kind, s, h, row, pos, at, slot, value in windows(part, size, whole, known, sizes):
            spot = at[:, None] + np.arange(s)
            filled = slot[spot] > 0
            found.append((h, row, pos, np.full(len(h), kind), filled.sum(axis=1), value[spot][filled], np.nonzero(filled)[1]))
        h, row, pos, kind, many, slots, spots = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(row, kind="stable")
        begin = (np.cumsum(many) - many)[order]
        many = many[order]
        at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
        bounds = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
        values, spots = (pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (slots[at].view(np.int64), spots[at].astype(np.int32)))
        item = pa.StructArray.from_arrays([pa.array(h[order].view(np.int64)), pa.array(pos[order].astype(np.int32)), pa.array(kind[order].astype(np.int32)), values, spots], ["hash", "pos", "kind", "slots", "spots"])
        out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(len(part) + 1)).astype(np.int32)), item))
    return pa.concat_arrays(out)


def _arrow_type() -> pa.DataType:
    return pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32()), ("kind", pa.int32()), ("slots", pa.list_(pa.int64())), ("spots", pa.list_(pa.int32()))]))


def _item_windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """One row a window of the benchmark; ``item_windows`` is how many windows its item has in that template."""
    made = F.arrow_udf(lambda texts: _lists(texts, WINDOW, True, None, ()), WINDOW_TYPE).asNondeterministic()
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), made(F.col(text_col).cast("string")).alias("w")).where("size(w) > 0")
    items = items.select("item_id", F.explode("w").alias("w")).select("item_id", "w.*")
    count = items.groupBy("item_id", "kind").agg(F.count_distinct("pos").alias("item_windows"))
    return materialize(items.join(count, ["item_id", "kind"]).select("hash", "item_id", "kind", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "item_windows").distinct(), "items")


def _short_sizes(benchmark: DataFrame, text_col: str) -> tuple[int, ...]:
    """Lengths, in template words, of the items that are shorter than a window."""
    def run(texts: pa.Array) -> pa.Array:
        sizes = [np.diff(ptr) for _, _, _, _, ptr in templates(texts)]
        return pa.array(np.stack(sizes, axis=1).tolist() if len(texts) else [], pa.list_(pa.int64()))

    found = benchmark.select(F.explode(F.arrow_udf(run, "array<bigint>").asNondeterministic()(F.col(text_col).cast("string"))).alias("n"))
    return tuple(sorted(r[0] for r in found.where(f"n < {WINDOW} AND n >= {MIN_WORDS}").distinct().collect()))


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Tells documents apart even where doc_id repeats or is null."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))


def _consistent(windows: Column) -> Column:
    """Positions of an alignment's windows that count: those with the item's own values, and those at odds with no value's majority.

    A value of the item is represented by what it meets at most of its places; where one has no majority, only the former count.
    """
    pairs = F.array_distinct(F.flatten(F.transform(windows, lambda w: w["pairs"])))
    same = lambda p, q: (p["item_slots"] == q["item_slots"]) & (p["slots"] == q["slots"])
    several = lambda p: F.exists(pairs, lambda q: (p["item_slots"] == q["item_slots"]) & (p["slots"] != q["slots"]))
    most = lambda p: 2 * F.size(F.filter(pairs, lambda q: same(p, q))) > F.size(F.filter(pairs, lambda q: p["item_slots"] == q["item_slots"]))
    odd = F.filter(pairs, lambda p: several(p) & ~most(p))
    split = F.exists(odd, lambda p: ~F.exists(pairs, lambda q: (p["item_slots"] == q["item_slots"]) & most(q)))
    verbatim = lambda w: F.forall(w["pairs"], lambda p: p["item_slots"] == p["slots"])
    agrees = lambda w: ~F.exists(w["pairs"], lambda p: F.exists(odd, lambda q: same(p, q)))
    kept = F.when(F.size(odd) == 0, windows).when(split, F.filter(windows, verbatim)).otherwise(F.filter(windows, lambda w: verbatim(w) | agrees(w)))
    return F.transform(kept, lambda w: w["item_pos"])


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, filter_bits: int) -> DataFrame:
    spark = docs.sparkSession
    items, sizes = _item_windows(benchmark, item_col, item_text_col), _short_sizes(benchmark, item_text_col)
    known = spark.sparkContext.broadcast(_marks(items.select("hash"), filter_bits))
    made = F.arrow_udf(lambda texts: _lists(texts, WINDOW, False, known.value, sizes), WINDOW_TYPE).asNondeterministic()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _key(docs, id_col, text_col).alias("key"), made(F.col(text_col).cast("string")).alias("w"))
    # a generator instead of a filter keeps the optimizer from running the function twice
    hits = rows.select("doc_id", "key", F.explode("w").alias("w")).select("doc_id", "key", "w.*")
    met = hits.join(items, ["hash", "kind"]).withColumn("spot", F.transform("spots", lambda k: k + F.col("item_pos"))).drop("spots").distinct()
    own = F.struct("item_pos", F.arrays_zip("spot", "item_slots", "slots").alias("pairs"))
    along = met.groupBy("doc_id", "key", "item_id", "kind", "item_windows", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(F.collect_set(own).alias("windows"))
    along = along.withColumn("places", _consistent(F.col("windows"))).where(F.size("places") > 0)
    found = along.groupBy("doc_id", "key", "item_id", "kind", "item_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("matched"))
    found = found.where((F.col("matched") >= MANY) | (F.col("matched") >= SHARE * F.col("item_windows")))
    return found.groupBy("doc_id", "key", "item_id").agg(F.max("matched").cast("bigint").alias("matched_windows"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``(doc_id, item_id, matched_windows)``: which documents hold which items."""
    found = _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, filter_bits)
    return found.groupBy("doc_id", "item_id").agg(F.max("matched_windows").alias("matched_windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The documents that leak no item; columns unchanged."""
    with scope(docs.sparkSession) as made:
        gone = materialize(_leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, filter_bits).select("key").distinct(), "gone")
        hand_on(made, 1)
    rows = docs.select(_key(docs, id_col, text_col).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(gone, "key", "left_anti").select("row.*")
