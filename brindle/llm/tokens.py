"""Operator 8: token counts. Texts are encoded in batches inside Arrow functions that return lengths only.

A batch is one call of the encoder: texts put together up to BATCH bytes, whatever their number, with a special token
between them, at which the ids are parted again. A text above PIECE characters is cut at safe boundaries, where a
white-space run follows other characters: the vocabulary's pre-tokenizer never joins characters across such a place, so
the pieces' counts add up to the whole text's exactly; its pieces are spread over batches like texts. A text without such
a place stays whole. There is no shuffle, and ids never leave the worker.

The vocabulary is a file of base64 tokens and ranks whose path is a parameter. The driver reads it once and broadcasts
its bytes (fixed size, about a megabyte); a worker builds the encoder once.

Defined results
  null text                  null count
  empty text                 0
  null or repeated doc_id    each row is counted by itself
  no document                no row
  extra or clashing columns  not read
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bytewords as bw

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE, BATCH, SLICE = 1 << 18, 1 << 18, 1 << 22
#: What stands between two texts of a batch. A batch in which a text has it is encoded text by text.
BREAK = "\x00<|between texts|>\x00"


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: bytes):
    """The byte-level encoder of a vocabulary file's bytes."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={BREAK: max(ranks.values()) + 1})


def safe_pieces(text: str, most: int = PIECE) -> list[str]:
    """The text in pieces of about ``most`` characters, cut only before a white-space run that follows other characters."""
    out, start = [], 0
    while len(text) - start > most:
        cut = _boundary(text, start + 1, start + most, -1)
        if cut is None:
            cut = _boundary(text, start + most, len(text), 1)
        if cut is None:
            break
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]


def _boundary(text: str, low: int, high: int, step: int) -> int | None:
    places = range(low, high) if step > 0 else range(high - 1, low - 1, -1)
    return next((i for i in places if text[i] in " \n\t\r" and not text[i - 1].isspace()), None)


def batches(texts: list[str | None], most: int = BATCH):
    """Runs of ``(row, piece)`` of about ``most`` bytes each; a piece above that is a run of its own."""
    run, size = [], 0
    for row, text in enumerate(texts):
        for piece in safe_pieces(text) if text else ():
            n = len(piece) if piece.isascii() else len(piece.encode())
            if run and size + n > most:
                yield run
                run, size = [], 0
            run.append((row, piece))
            size += n
    if run:
        yield run


def _encoded(own, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, flat, and how many each has."""
    whole = BREAK.join(pieces)
    if whole.count(BREAK) == len(pieces) - 1:
        found = own.encode_to_numpy(whole, allowed_special={BREAK}, disallowed_special=())
        between = found == own.encode_single_token(BREAK)
        ends = np.flatnonzero(between)
        return found[~between], np.diff(np.concatenate([[-1], ends, [len(found)]])) - 1
    each = [own.encode_to_numpy(p, disallowed_special=()) for p in pieces]
    return np.concatenate(each), np.array([len(x) for x in each])


def encode(texts: pa.Array, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, flat, and the row bounds. Null texts have none."""
    own, ids, counts = encoder(vocabulary), [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
    for run in batches(texts.to_pylist()):
        found, many = _encoded(own, [p for _, p in run])
        np.add.at(counts, [row for row, _ in run], many)
        ids.append(found)
    return np.concatenate(ids).astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


def lengths(texts: pa.Array, vocabulary: bytes) -> pa.Array:
    """How many ids each row has; null for null."""
    own, out = encoder(vocabulary), [pa.array([], pa.int64())]
    for part in bw.row_slices(texts, SLICE):
        counts = np.zeros(len(part), np.int64)
        for run in batches(part.to_pylist()):
            np.add.at(counts, [row for row, _ in run], _encoded(own, [p for _, p in run])[1])
        out.append(pa.array(counts, mask=np.asarray(part.is_null())))
    return pa.concat_arrays(out)


def broadcast_vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def counter(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A Column function: text to its number of tokens."""
    shared = broadcast_vocabulary(spark, vocabulary)

    def run(texts: pa.Array) -> pa.Array:
        return lengths(texts, shared.value)

    return F.arrow_udf(run, "bigint").asNondeterministic()


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)`` of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), counter(docs.sparkSession, vocabulary)(F.col(text_col).cast("string")).alias("n_tokens"))
