"""Deterministic synthetic tables.

Values come either from the row number alone, and are plain expressions then, or from one xorshift generator that all
columns share in schema order. The generator's step is linear over bits, so any place of its stream is reached by
multiplying powers of a bit matrix; every task jumps to its own rows and draws them in lanes. Where nulls are asked
for, how many draws a column takes depends on the draws themselves: then one sequential pass on the driver notes where
each block of rows begins. ``exact=False`` draws by hashing (seed, column, row) instead, which has neither limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BLOCK, LANES = 8192, 4096
_MASK = (1 << 64) - 1
_ALIASES = {
    "int8": "int8 tinyint", "int16": "int16 smallint", "int32": "int32 int integer", "int64": "int64 bigint long", "uint8": "uint8", "uint16": "uint16",
    "uint32": "uint32", "uint64": "uint64", "bool": "bool boolean bit", "float32": "float32 real", "float64": "float64 double float",
    "string": "string utf8 varchar nvarchar text nchar", "date": "date date32", "time": "time time64", "timestamp": "timestamp datetime datetime2",
    "duration": "duration", "binary": "binary varbinary bytes", "uuid": "uuid uniqueidentifier guid", "serial": "serial sequence identity",
}
TYPES = {alias: kind for kind, names in _ALIASES.items() for alias in names.split()}
#: Least value, greatest value, Spark type and Arrow type.
INTEGERS = {
    "int8": (-120, 120, "tinyint", pa.int8()), "int16": (-15000, 15000, "smallint", pa.int16()), "int32": (0, 100_000, "int", pa.int32()), "int64": (0, 10_000_000_000, "bigint", pa.int64()),
    "uint8": (0, 250, "smallint", pa.int16()), "uint16": (0, 30_000, "int", pa.int32()), "uint32": (0, 2_000_000_000, "bigint", pa.int64()), "uint64": (0, 4_000_000_000, "decimal(20,0)", pa.decimal128(20, 0)),
}
_DRAWN = {k: (v[2], v[3]) for k, v in INTEGERS.items()} | {"bool": ("boolean", pa.bool_()), "binary": ("binary", pa.binary()), "uuid": ("binary", pa.binary())}
#: Draws a value; binary takes 1 to 16 by row.
_DRAWS = dict.fromkeys([*INTEGERS, "bool"], 1) | {"uuid": 2}


def supported_types() -> list[str]:
    return sorted(TYPES)


# the generator


def _steps(state: np.ndarray) -> np.ndarray:
    state = state ^ (state << U64(13))
    state ^= state >> U64(7)
    return state ^ (state << U64(17))


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """matrix: 64 columns as words, the image of each bit."""
    out = np.zeros_like(x)
    for bit in range(64):
        out ^= np.where((x >> U64(bit)) & U64(1), matrix[bit], U64(0))
    return out


_powers: list[np.ndarray] = []


def _power(k: int) -> np.ndarray:
    """The bit matrix of 2**k steps."""
    if not _powers:
        _powers.append(_steps(U64(1) << np.arange(64, dtype=U64)))
    while len(_powers) <= k:
        _powers.append(_apply(_powers[-1], _powers[-1]))
    return _powers[k]


def jump(state: np.ndarray, steps: int) -> np.ndarray:
    """States after ``steps`` steps."""
    k = 0
    while steps:
        if steps & 1:
            state = _apply(_power(k), state)
        steps, k = steps >> 1, k + 1
    return state


def stream(seed: int, start: int, count: int) -> np.ndarray:
    """Draws ``start`` to ``start + count`` of the generator."""
    if count <= 0:
        return np.zeros(0, U64)
    each = max(1, -(-count // LANES))
    size = each.bit_length() - 1 if each & (each - 1) == 0 else each.bit_length()
    each = 1 << size
    lanes = jump(np.array([(seed & _MASK) | 1], U64), start)
    k = size
    while len(lanes) * each < count:
        lanes = np.concatenate([lanes, _apply(_power(k), lanes)])
        k += 1
    out = np.empty((len(lanes), each), U64)
    for i in range(each):
        lanes = _steps(lanes)
        out[:, i] = lanes
    return out.reshape(-1)[:count]


# where each column's draws begin


@dataclass(frozen=True)
class Spec:
    name: str
    kind: str


def parse_schema(schema: Mapping[str, str]) -> list[Spec]:
    out = []
    for name, text in schema.items():
        kind = TYPES.get(text.lower())
        if kind is None:
            raise ValueError(f"unknown column type {text!r} of {name!r}; there are {', '.join(supported_types())}")
        out.append(Spec(name, kind))
    return out


def _per_value(kind: str, rows: np.ndarray) -> np.ndarray:
    return 1 + rows % 16 if kind == "binary" else np.full(len(rows), _DRAWS.get(kind, 0))


def _closed(kind: str, row: int) -> int:
    """Draws before a row where nothing is null."""
    if kind == "binary":
        whole, rest = divmod(row, 16)
        return 136 * whole + rest * (rest + 1) // 2
    return _DRAWS.get(kind, 0) * row


def _coins(draws: np.ndarray, share: float) -> np.ndarray:
    return (draws >> U64(11)).astype(np.float64) * 2.0**-53 < share


def _walk(kind: str, seed: int, at: int, first: int, rows: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For rows from ``first`` on whose draws begin at ``at``: draws, where each row's value begins, which are null, and the next place."""
    row = np.arange(first, first + rows)
    need = _per_value(kind, row)
    if share <= 0:
        begin = np.cumsum(need) - need
        return stream(seed, at, int(need.sum())), begin, np.zeros(rows, bool), at + int(need.sum())
    draws = stream(seed, at, int(need.sum()) + rows)
    null = _coins(draws, share)
    if not need.any():
        return draws, np.zeros(rows, np.int64), null[:rows], at + rows
    begin, place, flags = np.empty(rows, np.int64), 0, null.tolist()
    for i, n in enumerate(need.tolist()):
        begin[i] = place
        place += 1 if flags[place] else 1 + n
    return draws, begin + 1, null[begin], at + place


def _offsets(specs: list[Spec], seed: int, rows: int, share: float) -> list[list[int] | int]:
    """For each column, where the draws of each block of rows begin; where that follows from the row, only where the column's begin."""
    at, out = 0, []
    for spec in specs:
        if spec.kind == "serial" or (share <= 0 and spec.kind not in _DRAWN):
            out.append([])
        elif share <= 0:
            out.append(at)
            at += _closed(spec.kind, rows)
        elif spec.kind not in _DRAWN:
            out.append(at)
            at += rows
        else:
            own = []
            for r in range(0, rows, BLOCK):
                own.append(at)
                *_, at = _walk(spec.kind, seed, at, r, min(BLOCK, rows - r), share)
            out.append(own)
    return out


def _values(kind: str, draws: np.ndarray, begin: np.ndarray, null: np.ndarray, first: int) -> pa.Array:
    row = np.arange(first, first + len(begin))
    if kind in INTEGERS:
        low, high, _, arrow = INTEGERS[kind]
        span = U64(high - low + 1)
        x = low + (draws[np.minimum(begin, max(len(draws) - 1, 0))] % span).astype(np.int64)
        found = pa.array(x, mask=null)
        return found.cast(pa.decimal128(20, 0)) if kind == "uint64" else found.cast(arrow)
    if kind == "bool":
        return pa.array((draws[np.minimum(begin, len(draws) - 1)] & U64(1)).astype(bool), mask=null)
    size = np.where(null, 0, 16 if kind == "uuid" else 1 + row % 16)
    if kind == "uuid":
        at = begin[~null]
        raw = np.stack([draws[at], draws[at + 1]], axis=1).astype("<u8").view(np.uint8).reshape(-1, 16)
        raw[:, 7] = (raw[:, 7] & 0x0F) | 0x40
        raw[:, 8] = (raw[:, 8] & 0x3F) | 0x80
    else:
        stop = np.cumsum(size)
        raw = draws[np.repeat(begin, size) + np.arange(stop[-1]) - np.repeat(stop - size, size)].astype(np.uint8)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    valid = pa.array(~null).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(begin), [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(raw).tobytes())])


# columns that follow from the row number


def _expression(spec: Spec, i: Column) -> Column:
    k = spec.kind
    if k == "float32":
        return i.cast("float") * F.lit(1.23456789).cast("float")
    if k == "float64":
        return i.cast("double") * F.lit(1.23456789)
    if k == "string":
        return F.format_string("%s_%07d", F.lit(spec.name), i)
    if k == "date":
        return F.date_from_unix_date((i % 10000).cast("int"))
    if k == "time":  # nanoseconds since midnight
        return ((i % 24) * 3600 + (i * 7 % 60) * 60 + i * 13 % 60) * 1_000_000_000
    if k == "timestamp":
        from brindle.functions.moments import timestamp_from_micros

        return timestamp_from_micros(F.lit(1_577_836_800_000_000) + i * 1_000_003)
    if k == "duration":  # microseconds
        return i * 1000
    return (i + 1).cast("int")  # serial


def _hashed(spec: Spec, i: Column, seed: int) -> Column:
    def draw(salt: int) -> Column:
        return F.xxhash64(F.lit(seed | 1), F.lit(spec.name), i, F.lit(salt))

    if spec.kind in INTEGERS:
        low, high, kind, _ = INTEGERS[spec.kind]
        return (F.lit(low) + F.pmod(draw(0), F.lit(high - low + 1))).cast(kind)
    if spec.kind == "bool":
        return F.pmod(draw(0), F.lit(2)) == 1
    text = F.concat(*(F.lpad(F.hex(draw(k)), 16, "0") for k in (0, 1)))
    if spec.kind == "uuid":
        return F.unhex(F.concat(F.substring(text, 1, 14), F.lit("4"), F.substring(text, 16, 1), F.lit("8"), F.substring(text, 18, 15)))
    return F.substring(F.unhex(text), F.lit(1), (F.lit(1) + i % 16).cast("int"))


def create_df(spark: SparkSession, schema: Mapping[str, str], rows: int = 100_000, *, seed: int = 42, null_fraction: float = 0.0, exact: bool = True, partitions: int | None = None) -> DataFrame:
    """A table of ``rows`` rows with the columns and types of ``schema``; the same arguments always give the same rows."""
    if rows <= 0:
        raise ValueError("rows must be positive")
    if not 0.0 <= null_fraction <= 1.0:
        raise ValueError("null_fraction must be between 0 and 1")
    if not schema:
        raise ValueError("at least one column is needed")
    specs = parse_schema(schema)
    i = F.col("__i")
    drawn = [s for s in specs if s.kind in _DRAWN]
    if not exact:
        base = spark.range(0, rows, 1, partitions).withColumnRenamed("id", "__i")

        def sometimes(s: Spec, value: Column) -> Column:
            if s.kind == "serial" or not null_fraction:
                return value
            coin = F.shiftrightunsigned(F.xxhash64(F.lit(seed | 1), F.lit(s.name), i, F.lit(-1)), 11).cast("double") * F.lit(2.0**-53)
            return F.when(coin >= null_fraction, value)

        return base.select(*(sometimes(s, _hashed(s, i, seed) if s.kind in _DRAWN else _expression(s, i)).alias(s.name) for s in specs))
    if not drawn and not null_fraction:
        base = spark.range(0, rows, 1, partitions).withColumnRenamed("id", "__i")
        return base.select(*(_expression(s, i).alias(s.name) for s in specs))
    offsets = _offsets(specs, seed, rows, null_fraction)
    work = [(k, s, o) for k, (s, o) in enumerate(zip(specs, offsets)) if o != []]
    fields = [pa.field("__i", pa.int64())] + [pa.field(f"__c{k}", _DRAWN[s.kind][1] if s.kind in _DRAWN else pa.bool_()) for k, s, _ in work]
    types = ", ".join(["__i bigint", *(f"__c{k} {_DRAWN[s.kind][0] if s.kind in _DRAWN else 'boolean'}" for k, s, _ in work)])
    blocks = -(-rows // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                first, n = block * BLOCK, min(BLOCK, rows - block * BLOCK)
                columns = [pa.array(np.arange(first, first + n))]
                for _, s, own in work:
                    at = own[block] if isinstance(own, list) else own + (_closed(s.kind, first) if s.kind in _DRAWN else first)
                    draws, begin, null, _ = _walk(s.kind, seed, at, first, n, null_fraction)
                    columns.append(_values(s.kind, draws, begin, null, first) if s.kind in _DRAWN else pa.array(null))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    made = spark.range(0, blocks, 1, min(blocks, partitions or spark.sparkContext.defaultParallelism)).mapInArrow(run, types)
    place = {s.name: f"__c{k}" for k, s, _ in work}
    out = []
    for s in specs:
        if s.kind in _DRAWN:
            value = F.col(place[s.name])
        else:
            value = _expression(s, i)
            if s.name in place:
                value = F.when(~F.col(place[s.name]), value)
        out.append(value.alias(s.name))
    return made.select(*out)
