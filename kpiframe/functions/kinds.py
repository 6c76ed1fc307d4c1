"""Column kinds: the five roles a column can play in a chart (SCH-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INTEGER = "integer"
NUMERIC = "numeric"
DATE = "date"
DATETIME = "datetime"
CATEGORICAL = "categorical"
QUANTILE = "quantile"  # grouping kind of a chart in quantile mode

ORDERED_KINDS = frozenset({INTEGER, NUMERIC, DATE, DATETIME, QUANTILE})


def kind_of(data_type: T.DataType) -> str:
    """Kind from the Spark type.

    Integral types are ``integer``; float, double and decimal are ``numeric``
    (decimal(38,0), the home of 128-bit integers, stays numeric); timestamps
    are ``datetime``; dates ``date``; everything else — strings, booleans,
    binary, intervals, arrays, maps, structs — is ``categorical``.
    """
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return NUMERIC
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(data_type, T.DateType):
        return DATE
    return CATEGORICAL


def is_numeric_kind(kind: str) -> bool:
    return kind in (INTEGER, NUMERIC)


def column_kinds(df: DataFrame) -> dict[str, str]:
    """Ordered ``{column: kind}`` for the top-level columns of ``df``."""
    return {field.name: kind_of(field.dataType) for field in df.schema.fields}
