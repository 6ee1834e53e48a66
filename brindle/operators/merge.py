"""Key-wise merging of two keyed tables, or of two map columns, by strategies.

A key that both sides have is combined: ``sum`` (of text: joined), ``max``, ``min`` or ``replace`` by the right value.
The strategy is the key's own, else that of the right value's type, else of the left one's, else the default, else ``sum``
for numbers and ``replace`` for all else, by the right value's type. It is the left side's configuration that counts. A
key of one side only keeps its value.

Null keys match nothing and are kept as they are. A null value gives way to the other side's under every strategy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, MutableMapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRATEGIES = ("sum", "max", "min", "replace")


def strategy_name(strategy: str | Callable) -> str:
    """A strategy by its name, or by a function of that name such as ``max``."""
    name = strategy if isinstance(strategy, str) else getattr(strategy, "__name__", None)
    if name not in STRATEGIES:
        raise ValueError(f"unknown merge strategy: {strategy!r}")
    return name


def type_name(kind: T.DataType) -> str:
    """The name under which a value's type has its strategy."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0:
        return "int"
    if isinstance(kind, T.NumericType):
        return "float"
    return {T.StringType: "str", T.BinaryType: "bytes", T.ArrayType: "list", T.MapType: "dict"}.get(type(kind), kind.simpleString())


@dataclass(frozen=True)
class Rules:
    """Which strategy holds for which key and type; methods return new rules."""

    by_key: tuple[tuple[object, str], ...] = ()
    by_type: tuple[tuple[str, str], ...] = ()
    default: str = ""

    @classmethod
    def of(cls, **types: str | Callable) -> Rules:
        return cls(by_type=tuple((t, strategy_name(s)) for t, s in types.items()))

    def set_strategy(self, key, strategy) -> Rules:
        return replace(self, by_key=(*(x for x in self.by_key if x[0] != key), (key, strategy_name(strategy))))

    def set_type_strategy(self, kind: str | type, strategy) -> Rules:
        kind = kind if isinstance(kind, str) else kind.__name__
        return replace(self, by_type=(*(x for x in self.by_type if x[0] != kind), (kind, strategy_name(strategy))))

    def set_default_strategy(self, strategy) -> Rules:
        return replace(self, default=strategy_name(strategy))

    def type_strategy(self, kind: str) -> str | None:
        return dict(self.by_type).get(kind)

    def default_strategy(self) -> str:
        return self.default or "type-default"

    def for_names(self, right: str, left: str) -> str:
        """The strategy of two values by the names of their types."""
        return self.type_strategy(right) or self.type_strategy(left) or self.default or ("sum" if right in ("int", "float", "bool") else "replace")

    def for_types(self, right: T.DataType, left: T.DataType) -> str:
        return self.for_names(type_name(right), type_name(left))


def combine(left: Column, right: Column, kind: T.DataType, strategy: str) -> Column:
    """The value of a key that both sides have."""
    if strategy == "sum":
        if isinstance(kind, T.BooleanType):
            both, left, right = left.cast("int") + right.cast("int"), left.cast("int"), right.cast("int")
        elif isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType)):
            both = F.concat(left, right)
        elif isinstance(kind, T.NumericType):
            both = left + right
        else:
            raise TypeError(f"values of type {kind.simpleString()} can't be added")
    else:
        both = {"max": F.greatest, "min": F.least, "replace": lambda a, b: b}[strategy](left, right)
    return F.coalesce(both, right, left)


def _merged(key: Column, left: Column, right: Column, kind: T.DataType, other_kind: T.DataType, rules: Rules) -> Column:
    """By key where keys have their own strategy. other_kind: the right value's type."""
    chain = None
    for k, strategy in rules.by_key:
        value = combine(left, right, kind, strategy)
        chain = F.when(key == F.lit(k), value) if chain is None else chain.when(key == F.lit(k), value)
    other = combine(left, right, kind, rules.for_types(other_kind, kind))
    return other if chain is None else chain.otherwise(other)


def _checked(left: T.DataType, right: T.DataType) -> T.DataType:
    """Numbers of different types are fine, other types must agree."""
    if type(left) is not type(right) and not (isinstance(left, T.NumericType) and isinstance(right, T.NumericType)):
        raise TypeError(f"can't merge values of types {left.simpleString()} and {right.simpleString()}")
    return left


def merge(left: DataFrame, right: DataFrame, key: str = "key", value: str = "value", rules: Rules = Rules()) -> DataFrame:
    """Both tables' keys, each once, with the merged value. Keys must be unique within a side; one shuffle a side."""
    kind, other_kind = left.schema[value].dataType, right.schema[value].dataType
    _checked(kind, other_kind)
    a = left.select(F.col(key).alias("__k"), F.col(value).alias("__l"), F.lit(True).alias("__in_l"))
    b = right.select(F.col(key).alias("__k"), F.col(value).alias("__r"), F.lit(True).alias("__in_r"))
    both = a.join(b, "__k", "full_outer")
    joined = _merged(F.col("__k"), F.col("__l"), F.col("__r"), kind, other_kind, rules)
    alone_l, alone_r = F.col("__l"), F.col("__r")
    if isinstance(kind, T.BooleanType):  # sums of truth values are numbers, so all values of the column are
        joined, alone_l, alone_r = (c.cast("int") for c in (joined, alone_l, alone_r))
    out = F.when(F.col("__in_l") & F.col("__in_r"), joined).when(F.col("__in_l"), alone_l).otherwise(alone_r)
    return both.select(F.col("__k").alias(key), out.alias(value))


def merge_maps(left: Column | str, right: Column | str, kind: T.DataType, rules: Rules = Rules()) -> Column:
    """Two map columns merged by key, without a shuffle. kind: the values' type."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (left, right))
    nothing_of = lambda m: F.map_filter(m, lambda k, v: F.lit(False))
    found_l, found_r = F.coalesce(a, nothing_of(b)), F.coalesce(b, nothing_of(a))
    cast = "int" if isinstance(kind, T.BooleanType) else kind
    merged = F.map_zip_with(found_l, found_r, lambda k, x, y: F.coalesce(*(c.cast(cast) for c in (_merged(k, x, y, kind, kind, rules), x, y))))
    return F.when(a.isNotNull() | b.isNotNull(), merged)


def merge_in(table: DataFrame, updates: DataFrame, order: str, key: str = "key", value: str = "value", rules: Rules = Rules()) -> DataFrame:
    """Fold a series of single merges, in their order, into a table: what repeated ``merge`` of one key each gives.

    The table's own value goes first. Text, bytes and lists are joined in order, which takes a key's values together as its
    result does; all else is combined before the shuffle. Truth values are numbers, as in ``merge``. Values that can't be
    added raise where a strategy adds them. Nulls are passed over. The order of updates of one key must be unique.
    """
    kind, other_kind = table.schema[value].dataType, updates.schema[value].dataType
    _checked(kind, other_kind)
    rows = [
        table.select(F.lit(None).cast(updates.schema[order].dataType).alias("__o"), F.col(key).alias("__k"), F.col(value).alias("__v")),
        updates.select(F.col(order).alias("__o"), F.col(key).alias("__k"), F.col(value).cast(kind).alias("__v")),
    ]
    if isinstance(kind, T.BooleanType):
        kind, rows = T.IntegerType(), [r.withColumn("__v", F.col("__v").cast("int")) for r in rows]
    when = F.when(F.col("__v").isNotNull(), F.struct(F.col("__o").isNotNull().alias("later"), F.col("__o").alias("o")))

    def fold(strategy: str) -> Column:
        if strategy == "replace":
            return F.max_by("__v", when)
        if strategy != "sum":
            return {"max": F.max, "min": F.min}[strategy]("__v")
        if isinstance(kind, T.NumericType):
            return F.sum("__v").cast(kind)
        if not isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType)):
            raise TypeError(f"values of type {kind.simpleString()} can't be added")
        values = F.transform(F.array_sort(F.collect_list(F.when(when.isNotNull(), F.struct(when.alias("w"), F.col("__v").alias("v"))))), lambda x: x["v"])
        if isinstance(kind, T.ArrayType):
            return F.when(F.size(values) > 0, F.flatten(values))
        # bytes are joined as their hexadecimal digits
        text = values if isinstance(kind, T.StringType) else F.transform(values, F.hex)
        joined = F.array_join(text, "")
        return F.when(F.size(values) > 0, joined if isinstance(kind, T.StringType) else F.unhex(joined))

    chain = None
    for k, s in rules.by_key:
        chain = F.when(F.first("__k") == F.lit(k), fold(s)) if chain is None else chain.when(F.first("__k") == F.lit(k), fold(s))
    other = fold(rules.for_types(other_kind, table.schema[value].dataType))
    return rows[0].unionByName(rows[1]).groupBy("__k").agg((other if chain is None else chain.otherwise(other)).alias(value)).select(F.col("__k").alias(key), value)


class MergeMap(MutableMapping):
    """A plain mapping on the driver that merges by the same rules; ``a | b`` leaves both as they are."""

    def __init__(self, values: Mapping | None = None, rules: Rules = Rules(), **types):
        self._values = dict(values or {})
        self.rules = rules if not types else Rules(rules.by_key, (*rules.by_type, *Rules.of(**types).by_type), rules.default)

    def __getitem__(self, key):
        return self._values[key]

    def __setitem__(self, key, value) -> None:
        self._values[key] = value

    def __delitem__(self, key) -> None:
        del self._values[key]

    def __iter__(self) -> Iterator:
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def get(self, key, *default):
        """The key's value; without a default a missing key is an error."""
        return self._values.get(key, *default) if default else self._values[key]

    def strategy(self, key, left, right) -> str:
        """By key, by the right value's type, by the left one's, by default."""
        return dict(self.rules.by_key).get(key) or self.rules.for_names(type(right).__name__, type(left).__name__)

    def merge_in(self, key, value) -> None:
        """Merge one key's value."""
        if key not in self._values:
            self._values[key] = value
            return
        old = self._values[key]
        self._values[key] = {"sum": lambda: old + value, "max": lambda: max(old, value), "min": lambda: min(old, value), "replace": lambda: value}[self.strategy(key, old, value)]()

    def merge(self, other: Mapping) -> MergeMap:
        out = MergeMap(self._values, self.rules)
        for key, value in other.items():
            out.merge_in(key, value)
        return out

    __or__ = merge

    def to_dict(self) -> dict:
        return dict(self._values)
