"""Column types of SQL databases as Spark's, for reading a table with a schema of one's own.

``custom_schema`` writes the mapping of a table's columns in the form of the JDBC source's ``customSchema``; columns it isn't
given keep what Spark's dialect makes of them. Decimals stay exact, and one too wide for Spark becomes text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

_PLAIN = {
    "bit": T.BooleanType(), "boolean": T.BooleanType(), "tinyint": T.ShortType(), "smallint": T.ShortType(), "int": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(),
    "real": T.FloatType(), "float": T.DoubleType(), "double": T.DoubleType(), "double precision": T.DoubleType(), "money": T.DecimalType(19, 4), "smallmoney": T.DecimalType(10, 4),
    "char": T.StringType(), "varchar": T.StringType(), "text": T.StringType(), "nchar": T.StringType(), "nvarchar": T.StringType(), "ntext": T.StringType(), "longvarchar": T.StringType(), "xml": T.StringType(),
    "binary": T.BinaryType(), "varbinary": T.BinaryType(), "longvarbinary": T.BinaryType(), "image": T.BinaryType(), "rowversion": T.BinaryType(),
    "date": T.DateType(), "datetime": T.TimestampNTZType(), "datetime2": T.TimestampNTZType(), "smalldatetime": T.TimestampNTZType(), "timestamp": T.TimestampNTZType(), "datetimeoffset": T.TimestampType(),
    "time": T.TimestampNTZType(), "uniqueidentifier": T.StringType(), "uuid": T.StringType(),
}


def spark_type(name: str, precision: int | None = None, scale: int = 0) -> T.DataType:
    """Spark's type for a column type such as ``nvarchar`` or ``decimal``; precision and scale may stand in the name."""
    base, _, inside = name.lower().strip().partition("(")
    base = base.strip()
    if inside:
        numbers = [x.strip() for x in inside.rstrip(") ").split(",")]
        precision, scale = (int(numbers[0]) if numbers[0].isdigit() else None), int(numbers[1]) if len(numbers) > 1 else 0
    if base in ("decimal", "numeric"):
        width = 18 if precision is None else precision
        return T.DecimalType(width, scale) if width <= 38 else T.StringType()
    if base not in _PLAIN:
        raise ValueError(f"no type for a column of {name!r}")
    return _PLAIN[base]


def custom_schema(columns: Iterable[tuple[str, str]]) -> str:
    """``customSchema`` of (column, SQL type)."""
    return ", ".join("`" + column.replace("`", "``") + "` " + spark_type(kind).simpleString() for column, kind in columns)
