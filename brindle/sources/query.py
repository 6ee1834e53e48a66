"""A query over one table as an immutable value, and the dialects that write it as SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    """What to read: columns of a table, a condition and a limit, or raw SQL, which goes before all else.

    Every method returns a new query. ``select`` adds columns, the others replace what was set before.
    """

    table: str = ""
    columns: tuple[str, ...] = ()
    where_clause: str = ""
    limit_value: int | None = None
    raw_sql: str = ""
    args: dict[str, Any] = field(default_factory=dict, compare=False)

    @classmethod
    def raw(cls, text: str, **args) -> Query:
        return cls(raw_sql=text, args=args)

    def is_raw(self) -> bool:
        return bool(self.raw_sql)

    def select(self, *columns: str) -> Query:
        return replace(self, columns=(*self.columns, *columns))

    def from_table(self, table: str) -> Query:
        return replace(self, table=table)

    def where(self, text: str, **args) -> Query:
        """A condition as SQL text; ``:name`` in it stands for the argument of that name."""
        return replace(self, where_clause=text, args=args)

    def limit(self, n: int) -> Query:
        if n < 0:
            raise ValueError(f"limit must not be negative, but is {n}")
        return replace(self, limit_value=n)

    def to_sql(self, dialect: Dialect | None = None) -> str:
        return self.raw_sql or (dialect or SparkDialect()).render(self)

    def apply(self, table: DataFrame) -> DataFrame:
        """The query over a given DataFrame; what it reads reaches the scan by Catalyst."""
        if self.where_clause:
            view = "{table}"
            table = table.sparkSession.sql(f"SELECT * FROM {view} WHERE {self.where_clause}", args=self.args or None, table=table)
        if self.columns:
            table = table.select(*(F.col(SparkDialect().quote_identifier(c)) for c in self.columns))
        return table if self.limit_value is None else table.limit(self.limit_value)


class Dialect(Protocol):
    def render(self, query: Query) -> str: ...

    def quote_identifier(self, name: str) -> str: ...


def _clauses(query: Query, dialect: Dialect, top: str, bottom: str) -> str:
    if not query.table:
        raise ValueError("the query has no table")
    columns = ", ".join(map(dialect.quote_identifier, query.columns)) or "*"
    table = ".".join(map(dialect.quote_identifier, split_name(query.table)))
    return f"SELECT {top}{columns} FROM {table}" + (f" WHERE {query.where_clause}" if query.where_clause else "") + bottom


class SparkDialect:
    """Back-ticks, and LIMIT at the end."""

    def quote_identifier(self, name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    def render(self, query: Query) -> str:
        return _clauses(query, self, "", "" if query.limit_value is None else f" LIMIT {query.limit_value}")


class TSqlDialect:
    """Brackets, and TOP at the front."""

    def quote_identifier(self, name: str) -> str:
        return "[" + name.replace("]", "]]") + "]"

    def render(self, query: Query) -> str:
        return _clauses(query, self, "" if query.limit_value is None else f"TOP {query.limit_value} ", "")


def split_name(name: str) -> tuple[str, ...]:
    """The one to three parts of a table's name."""
    parts = tuple(name.split("."))
    if not 1 <= len(parts) <= 3 or not all(parts):
        raise ValueError(f"not a table's name: {name!r}")
    return parts


_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def qualified(name: str, default_schema: str = "") -> str:
    """A table to save to: an identifier, or schema and identifier; without a schema the default one is put before it."""
    parts = name.split(".")
    if len(parts) > 2 or not all(map(_IDENTIFIER.match, parts)):
        raise ValueError(f"not a valid table to save to: {name!r}")
    return ".".join([default_schema, *parts] if default_schema and len(parts) == 1 else parts)


_TOP = re.compile(r"\A\s*SELECT\s+TOP\s+(\d+)\s+(.*)\Z", re.I | re.S)


def from_tsql(text: str) -> str:
    """Spark SQL for a statement that uses T-SQL's TOP or brackets; string literals stay as they are."""
    pieces = re.split(r"('(?:[^']|'')*')", text)
    text = "".join(p if k % 2 else re.sub(r"\[((?:[^\]\[]|\]\])+)\]", lambda m: "`" + m[1].replace("]]", "]").replace("`", "``") + "`" if not m[1].isdigit() else m[0], p) for k, p in enumerate(pieces))
    found = _TOP.match(text)
    return f"SELECT {found[2].rstrip().rstrip(';')} LIMIT {found[1]}" if found else text


_QUOTED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\[[^\]]*\]|--[^\n]*|/\*.*?\*/", re.S)


def _bare(text: str) -> str:
    """The statement with what is quoted, commented out or in parentheses blanked, place for place."""
    plain, out, depth = _QUOTED.sub(lambda m: " " * len(m[0]), text), [], 0
    for c in plain:
        depth -= c == ")"
        out.append(c if depth == 0 else " ")
        depth += c == "("
    return "".join(out)


def split_with(text: str) -> tuple[str, str]:
    """The common table expressions a statement begins with, and its rest, which may then stand in parentheses."""
    bare = _bare(text)
    if not re.match(r"\s*WITH\b", bare, re.I):
        return "", text
    main = re.search(r"\)\s*(SELECT)\b", bare, re.I)
    return (text[: main.start(1)].strip(), text[main.start(1) :]) if main else ("", text)


def sortable(text: str) -> str:
    """A statement that SQL Server takes in parentheses: an ORDER BY there needs a TOP or an OFFSET."""
    bare = _bare(text)
    if not re.search(r"\bORDER\s+BY\b", bare, re.I) or re.match(r"\s*SELECT\s+TOP\b", bare, re.I) or re.search(r"\bOFFSET\b", bare, re.I):
        return text
    return text.rstrip().rstrip(";") + " OFFSET 0 ROWS"
