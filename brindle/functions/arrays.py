"""One attribute or one method over all elements of an array, and lists as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class each:
    """``each(xs).name`` is the field ``name`` of every element; ``each(xs)(f, *args)`` is ``f`` of every element.

    An empty array gives an empty array, and a null one null.
    """

    def __init__(self, xs: Column | str):
        self._xs = F.col(xs) if isinstance(xs, str) else xs

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return F.transform(self._xs, lambda x: x[name])

    def __call__(self, method: Callable[..., Column], *args) -> Column:
        return F.transform(self._xs, lambda x: method(x, *args))


def to_csv(xs: Column | str, sort: bool = False) -> Column:
    """Elements joined by a comma and a space, in their order or in that of their text."""
    xs = (F.col(xs) if isinstance(xs, str) else xs).cast("array<string>")
    return F.array_join(F.sort_array(xs) if sort else xs, ", ")
