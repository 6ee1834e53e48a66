"""Typing of plain scalars by the YAML 1.2 core schema, and checks of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tested in this order; what matches none is a string.
PATTERNS = {
    "null": r"(?:|~|null|Null|NULL)",
    "bool": r"(?:true|True|TRUE|false|False|FALSE)",
    "int": r"(?:0x[0-9a-fA-F]+|0o[0-7]+|[-+]?[0-9]+)",
    "special": r"(?:[-+]?(?:\.inf|\.Inf|\.INF)|\.nan|\.NaN|\.NAN)",
    "float": r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?",
}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scalar_class(text: Column | str) -> Column:
    """``null``, ``bool``, ``int``, ``float`` or ``string``."""
    t, chain = _col(text), F
    for kind, pattern in PATTERNS.items():
        chain = chain.when(t.rlike(rf"\A{pattern}\z"), F.lit("float" if kind == "special" else kind))
    return F.when(t.isNotNull(), chain.otherwise(F.lit("string")))


def to_integer(text: Column | str) -> Column:
    """The value of a scalar of class ``int`` as decimal(38,0), null for another class and where it doesn't fit."""
    t = _col(text)
    radix = F.when(t.rlike(r"\A0x"), F.conv(F.substring(t, 3, 64), 16, 10)).when(t.rlike(r"\A0o"), F.conv(F.substring(t, 3, 64), 8, 10)).otherwise(t)
    return F.when(scalar_class(t) == "int", radix.try_cast("decimal(38,0)"))


def to_double(text: Column | str) -> Column:
    """The value of a scalar of class ``float`` or ``int``; null for another class."""
    t = _col(text)
    special = F.when(F.lower(t) == ".nan", F.lit(float("nan"))).when(F.startswith(t, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(t.rlike(rf"\A{PATTERNS['special']}\z"), special).when(scalar_class(t).isin("int", "float"), F.coalesce(to_integer(t).cast("double"), t.try_cast("double")))


def to_boolean(text: Column | str) -> Column:
    t = _col(text)
    return F.when(scalar_class(t) == "bool", F.lower(t) == "true")


def needs_quotes(text: Column | str) -> Column:
    """Whether a string, written plain, would be read back as something else."""
    return scalar_class(text) != "string"


def ascii_lower(text: Column | str) -> Column:
    """A to Z in lower case; all other letters as they are."""
    return F.translate(_col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_dunder(text: Column | str) -> Column:
    """``__x__``, of at least four characters."""
    t = _col(text)
    return F.startswith(t, F.lit("__")) & F.endswith(t, F.lit("__")) & (F.length(t) >= 4)


def is_clean_utf8(content: Column | str) -> Column:
    """Whether bytes are text: valid UTF-8 without NUL, and no mark of UTF-16 at the beginning."""
    c = _col(content)
    mark = F.hex(F.substring(c, 1, 2))
    return F.is_valid_utf8(c.cast("string")) & ~mark.isin("FFFE", "FEFF") & (F.locate("\x00", c.cast("string")) == 0)
