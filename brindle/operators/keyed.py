"""Strict registration by key, relationally: inserting only what is new, replacing only what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_only(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key the table lacks."""
    return rows.join(table.select(*keys).distinct(), keys, "left_anti")


def override_only(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key the table has."""
    return rows.join(table.select(*keys).distinct(), keys, "left_semi")


def register(table: DataFrame, rows: DataFrame, keys: list[str], override: bool = False) -> DataFrame:
    """The table with the rows in it. Without ``override`` every key must be new, with it every key must be there."""
    wrong = (insert_only if override else override_only)(table, rows, keys)
    if found := wrong.select(*keys).take(1):
        raise ValueError(f"key {tuple(found[0])} is " + ("not registered, so it can't be overridden" if override else "registered already"))
    kept = table.join(rows.select(*keys), keys, "left_anti") if override else table
    return kept.unionByName(rows)


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """For each key the value that comes last in ``order``."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))
