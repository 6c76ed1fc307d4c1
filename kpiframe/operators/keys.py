"""Grouping keys for a chart's x-axis (KEY-1, 2, 6..12)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiframe.functions import kinds
from kpiframe.functions.labels import (
    MISSING,
    QUANTILE_MISSING_SORT,
    label_sql,
    quantile_label,
    temporal_label,
)
from kpiframe.functions.arguments import Argument
from kpiframe.functions.numbers import col_of, quote

DATE_BUCKETS = ("hour", "day", "week", "month", "year")


@dataclass(frozen=True)
class XKey:
    """Row-level key, label and sort columns plus the grouping kind."""

    key: Column
    label: Column
    sort: Column
    kind: str


def numeric_key_sql(x: str, band: object = None) -> str:
    """SQL of the raw (KEY-1) or banded (KEY-2) key of a numeric column.

    Spark's ``floor(double)`` is BIGINT and saturates beyond 2^63, so
    quotients outside +-2^53 (integral as doubles already) are kept as is.
    """
    raw = f"TRY_CAST({quote(x)} AS DOUBLE)"
    width = Argument(band).amount()
    if not width:
        return raw
    w = f"{float(width)!r}D"
    q = f"({raw} / {w})"
    return f"(CASE WHEN abs({q}) < 9007199254740992.0D THEN CAST(FLOOR({q}) AS DOUBLE) ELSE {q} END * {w})"


def numeric_key(x: str, kind: str, band: object = None) -> XKey:
    """Raw (KEY-1) or fixed-width band (KEY-2) key of a numeric column, label by kind (KEY-8/9)."""
    key_sql = numeric_key_sql(x, band)
    key = F.expr(key_sql)
    return XKey(key, F.expr(label_sql(key_sql, kind)), key, kind)


def truncate_wall_clock(c: Column, unit: str) -> Column:
    """Bucket start of a timestamp_ntz or date value as timestamp_ntz, without any time zone.

    Built from the calendar fields, so the result does not depend on the
    session time zone (``date_trunc`` would round-trip through it).  Weeks
    start on Monday.
    """
    zero = F.lit(0)
    if unit == "week":
        day = F.to_date(c)
        monday = F.date_sub(day, (F.dayofweek(day) + F.lit(5)) % F.lit(7))
        return F.make_timestamp_ntz(F.year(monday), F.month(monday), F.dayofmonth(monday), zero, zero, zero)
    if unit == "year":
        return F.make_timestamp_ntz(F.year(c), F.lit(1), F.lit(1), zero, zero, zero)
    if unit == "month":
        return F.make_timestamp_ntz(F.year(c), F.month(c), F.lit(1), zero, zero, zero)
    if unit == "day":
        return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), zero, zero, zero)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), zero, zero)


def temporal_key(x: str, kind: str, bucket: object = None, data_type: T.DataType | None = None) -> XKey:
    """Calendar bucket ``hour/day/week/month/year`` (weeks start Monday), else raw (KEY-6, KEY-10)."""
    name = str(bucket or "none").lower()
    c = col_of(x)
    if name in DATE_BUCKETS:
        if isinstance(data_type, T.TimestampType):
            # zoned timestamps are truncated in the session time zone
            key = F.date_trunc(name, c).cast("timestamp_ntz")
        else:
            key = truncate_wall_clock(c, name)
    else:
        key = c
    return XKey(key, temporal_label(key), key, kind)


def categorical_key(x: str) -> XKey:
    """Text of the value, null -> ``(missing)`` (KEY-7)."""
    key = F.coalesce(col_of(x).cast("string"), F.lit(MISSING))
    return XKey(key, key, key, kinds.CATEGORICAL)


def quantile_key(tile: Column) -> XKey:
    """Key from a tile number column (KEY-11, KEY-12)."""
    return XKey(tile, quantile_label(tile), F.coalesce(tile, F.lit(QUANTILE_MISSING_SORT)), kinds.QUANTILE)


def x_key(df: DataFrame, x: str, band: object = None, bucket: object = None) -> XKey:
    """Key of ``x`` by its kind (non-quantile modes)."""
    if x not in df.columns:
        raise ValueError("Choose a valid x-axis feature")
    kind = kinds.column_kinds(df)[x]
    if kinds.is_numeric_kind(kind):
        return numeric_key(x, kind, band)
    if kind in (kinds.DATE, kinds.DATETIME):
        return temporal_key(x, kind, bucket, df.schema[x].dataType)
    return categorical_key(x)
