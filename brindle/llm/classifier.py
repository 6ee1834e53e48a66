"""Operator 1: a supervised subword-embedding classifier of quality and toxicity.

A document is the average of learned vectors, one for each hashed white-space token and each hashed character n-gram (of
bytes, reaching at most one white-space byte at either end); a softmax layer over the average gives the four joint
classes of (quality, toxic). Vectors and layer are trained together by stochastic gradient descent in numpy, one
document a step, with a step size per vector that falls with the squared gradients it has met.

After training the linear layer is folded into the table (the softmax's input is linear in the average), so scoring
adds one row of four numbers for each n-gram. Scoring is a single Arrow pass over whole texts, without a shuffle.

Defined results
  null, empty or blank text   no evidence: the class priors of the training sample; kept only if they say so
  labels                      rows with a null are ignored; of repeated doc_ids the worst quality and toxicity count
  no usable label             priors are (quality 1, not toxic): everything is kept
  labels of absent documents  not counted in the sample; where usable labels leave no sample of a table with rows, an error
  one class only              the priors alone decide
  ties at the thresholds      p_quality equal to its threshold keeps, p_toxic equal to its threshold rejects
  repeated rows               each row is scored by itself
  extra or clashing columns   carried along untouched by ``classify``
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import bytewords as bw
from brindle.plans.scratch import materialize, scope

#: The training sample's bounds; scoring and everything else covers all rows.
TRAIN_DOCS, TRAIN_BYTES = 12_000, 36_000_000
#: Bytes that are looked at together; longer texts are cut at a blank.
PIECE = 1 << 20
BUCKET_BITS, DIMENSIONS, GRAMS = 17, 16, (3, 4, 5)
EPOCHS, RATE, SEED = 6, 4.0, 20240229
MIN_QUALITY, MAX_TOXIC = 0.5, 0.5
CLASSES = ((0, 0), (0, 1), (1, 0), (1, 1))
SCORE_TYPE = "struct<p_quality: double, p_toxic: double>"


def features(texts: pa.Array, bits: int = BUCKET_BITS, grams: tuple[int, ...] = GRAMS):
    """For runs of rows: (bucket of each token or n-gram, its row). A row may be spread over several runs."""
    data, off = bw.utf8(texts)
    for a, b, inner, rows in bw.pieces(data, off, PIECE):
        if b < off[rows[-1] + 1]:  # a row is cut at this blank, with which n-grams on both sides may end or begin
            b, inner = b + 1, inner + [0, 1]
        raw = data[a:b]
        n = len(raw)
        if not n:
            continue
        blank = bw.SPACE[raw]
        owner = np.repeat(rows, np.diff(inner)).astype(np.int32)
        s, e, _ = bw.spans(~blank, inner, None)
        yield (bw.span_hashes(raw, s, e) >> np.uint64(64 - bits)).astype(np.int32), owner[s]
        gaps = np.concatenate([[0], np.cumsum(blank, dtype=np.int32)])
        ends_row = inner[1:][np.searchsorted(inner[1:], np.arange(n), side="right")] if len(rows) > 1 else np.full(n, n)
        h = raw.astype(np.uint32)
        for size in range(2, max(grams) + 1):
            if n < size:
                break
            h = h[: n - size + 1] * np.uint32(0x01000193) + raw[size - 1 :]
            if size in grams:
                at = np.flatnonzero((gaps[size - 1 : n] - gaps[1 : n - size + 2] == 0) & (ends_row[: n - size + 1] >= np.arange(size, n + 1)))
                x = (h[at] ^ np.uint32(size * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
                yield ((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - bits)).astype(np.int32), owner[at]


def _sparse(texts: pa.Array, bits: int, rows: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text with their share of the average, as slices of arrays over ``rows`` texts."""
    out = []
    for start in range(0, len(texts), rows):
        part = texts.slice(start, rows)
        found = [(owner.astype(np.int64) << bits) | ids for ids, owner in features(part, bits)]
        key, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        owner = key >> bits
        ids, share = (key & ((1 << bits) - 1)).astype(np.int32), (count / np.bincount(owner, count, len(part))[owner]).astype(np.float32)
        bounds = np.searchsorted(owner, np.arange(len(part) + 1))
        out += [(ids[i:j], share[i:j]) for i, j in zip(bounds, bounds[1:])]
    return out


@dataclass
class Model:
    """Folded class scores of every bucket, and the layer's bias."""

    table: np.ndarray
    bias: np.ndarray
    bits: int = BUCKET_BITS

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        n, k = len(texts), self.table.shape[1]
        total, count = np.zeros((n, k)), np.zeros(n)
        for ids, rows in features(texts, self.bits):
            if len(ids):
                heads = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
                total[rows[heads]] += np.add.reduceat(self.table[ids], heads, axis=0)
                count[rows[heads]] += np.diff(np.concatenate([heads, [len(ids)]]))
        z = total / np.maximum(count, 1)[:, None] + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def prior_model(share: np.ndarray) -> Model:
    return Model(np.zeros((1 << BUCKET_BITS, len(CLASSES))), np.log(np.maximum(share, 1e-9)))


def train(texts: pa.Array, labels: np.ndarray, *, bits: int = BUCKET_BITS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Fit vectors and layer. labels: the index of each text's class in CLASSES."""
    share = np.bincount(labels, minlength=len(CLASSES)) / max(1, len(labels))
    if len(np.unique(labels)) < 2:
        return prior_model(share if len(labels) else np.array([0, 0, 1, 0]))
    random = np.random.default_rng(seed)
    docs = _sparse(texts, bits)
    vectors = random.uniform(-1 / dimensions, 1 / dimensions, (1 << bits, dimensions)).astype(np.float32)
    layer = random.normal(0, 1, (len(CLASSES), dimensions)).astype(np.float32)
    bias = np.log(np.maximum(share, 1e-3)).astype(np.float32)
    met, met_layer = np.full(1 << bits, 1e-8, np.float32), np.full(len(CLASSES), 1e-2, np.float32)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for d in random.permutation(len(docs)):
            ids, weight = docs[d]
            done += 1
            if not len(ids):
                continue
            own = vectors[ids]
            hidden = weight @ own
            z = layer @ hidden + bias
            z = np.exp(z - z.max())
            error = -z / z.sum()
            error[labels[d]] += 1
            now = rate * (1 - done / (steps + 1))
            back = error @ layer
            met[ids] += (weight * weight) * float(back @ back)
            vectors[ids] = own + (now * weight / np.sqrt(met[ids]))[:, None] * back
            met_layer += error * error * float(hidden @ hidden)
            layer += (now / np.sqrt(met_layer))[:, None] * np.outer(error, hidden)
            bias += now * 0.1 * error
    return Model(vectors.astype(np.float64) @ layer.T.astype(np.float64), bias.astype(np.float64), bits)


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, most_docs: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """``(id, q, t, text)`` of at most ``most_docs`` labelled documents and ``most_bytes`` of text, whole ones, picked by a hash of doc_id.

    Labels count only where ``docs`` has a text for them. A document that doesn't fit what is left of ``most_bytes`` is passed over.
    """
    one = _usable(labels, id_col).groupBy("id").agg(F.min("q").alias("q"), F.max("t").alias("t"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").where(F.octet_length("text") <= most_bytes)
    one = materialize(one.join(texts.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(most_docs), "labels")
    sample = materialize(texts.join(one, "id").groupBy("id", "q", "t").agg(F.min("text").alias("text")), "sample")
    # the bound holds for at most most_docs rows, so one task may order them
    sizes = sample.select("id", F.octet_length("text").cast("bigint").alias("n")).repartition(1).sortWithinPartitions(F.xxhash64("id"), "id")
    return sample.join(sizes.mapInArrow(_fitting(most_bytes), "id bigint"), "id")


def _usable(labels: DataFrame, id_col: str) -> DataFrame:
    return labels.select(F.col(id_col).cast("bigint").alias("id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).dropna()


def _fitting(most: int):
    """In order, the ids of (id, size) whose sizes fit what those before have left of ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = most
        for batch in batches:
            chosen = []
            for doc, n in zip(*(c.to_pylist() for c in batch.columns)):
                if n <= left:
                    left -= n
                    chosen.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.int64())], ["id"])

    return run


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sample's model as one row of bytes."""
    rows = pa.Table.from_batches(list(batches), pa.schema([("q", pa.int32()), ("t", pa.int32()), ("text", pa.string())]))
    q, t = (rows.column(c).to_numpy() for c in ("q", "t"))
    model = train(rows.column("text").combine_chunks(), 2 * (q > 0) + (t > 0))
    yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in (model.table, model.bias)), pa.array([len(rows)], pa.int64())], ["table", "bias", "n"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> Model:
    """A model of the labelled documents, of which a bounded sample is used; see ``training_sample``.

    Descent is sequential, so one task trains; only the model, of a size that BUCKET_BITS fixes, comes to the driver.
    """
    with scope(docs.sparkSession):
        sample = training_sample(docs, labels, id_col, text_col, **bounds).repartition(1).sortWithinPartitions("id").select("q", "t", "text")
        row = sample.mapInArrow(_train_task, "table binary, bias binary, n bigint").first()
    if row is None or not row["n"]:
        if not _usable(labels, id_col).isEmpty() and not docs.isEmpty():
            raise ValueError("there are usable labels, but none of a document that is present and fits the sample's bounds")
        return prior_model(np.array([0, 0, 1, 0]))
    return Model(np.frombuffer(row["table"]).reshape(-1, len(CLASSES)), np.frombuffer(row["bias"]))


def scorer(spark, model: Model):
    """A Column function: text to ``p_quality`` and ``p_toxic``. The model's size is fixed by BUCKET_BITS."""
    shared = spark.sparkContext.broadcast(model)
    good, toxic = (np.array([c[k] for c in CLASSES], float) for k in (0, 1))

    def run(texts: pa.Array) -> pa.Array:
        out = [np.zeros((0, len(CLASSES)))] + [shared.value.probabilities(part) for part in bw.row_slices(texts)]
        p = np.concatenate(out)
        return pa.StructArray.from_arrays([pa.array(p @ good), pa.array(p @ toxic)], ["p_quality", "p_toxic"])

    return F.arrow_udf(run, SCORE_TYPE).asNondeterministic()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, p_quality, p_toxic, keep)`` for every row."""
    s = docs.select(F.col(id_col).alias("doc_id"), scorer(docs.sparkSession, model)(F.col(text_col).cast("string")).alias("s"))
    return s.select("doc_id", "s.p_quality", "s.p_toxic", _kept("s").alias("keep"))


def _kept(s: str):
    return (F.col(f"{s}.p_quality") >= MIN_QUALITY) & (F.col(f"{s}.p_toxic") < MAX_TOXIC)


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents of good quality that aren't toxic; columns unchanged."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    s = docs.select(row, scorer(docs.sparkSession, model)(F.col(text_col).cast("string")).alias("__score"))
    return s.where(_kept("__score")).select("__row.*")
