"""Table profile: columns with type, kind and suggested band width (TOP-3, SCH-1..8).

Row count and integer ranges come from the Parquet footers where they can. What is left is one aggregate over all rows,
of the numeric columns that need a standard deviation only; its one row reaches the driver, bounded by the column count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiframe.functions import kinds
from kpiframe.functions.bands import width_for_spread
from kpiframe.functions.numbers import col_of, try_double
from kpiframe.sources.footers import footer_statistics

#: Integer columns with a smaller range than this are charted value by value (fixed value).
SMALL_RANGE = 120

#: Row count, and (low, high, standard deviation) of every numeric column.
Statistics = tuple[int, dict[str, tuple]]


def table_statistics(df: DataFrame, column_kinds: dict[str, str]) -> Statistics:
    """From the footers and one job over the columns that they don't settle."""
    numeric = [c for c, k in column_kinds.items() if kinds.is_numeric_kind(k)]
    integers = [c for c in numeric if column_kinds[c] == kinds.INTEGER]
    footers = footer_statistics(df, integers)
    ranges = footers.ranges if footers else {}
    spread = [c for c in numeric if not _is_small(*ranges.get(c, (None, None)))]
    if footers and not spread:
        return footers.rows, {c: (*ranges[c], None) for c in numeric}
    aggs: list[Column] = [] if footers else [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(spread):
        aggs.append(F.stddev_samp(try_double(c)).alias(f"s{i}"))
        if c in integers and not footers:
            aggs += [F.min(col_of(c)).alias(f"lo{i}"), F.max(col_of(c)).alias(f"hi{i}")]
    found = df.agg(*aggs).first().asDict()
    out = {c: (*ranges[c], None) for c in numeric if c not in spread}
    for i, c in enumerate(spread):
        low, high = ranges.get(c, (found.get(f"lo{i}"), found.get(f"hi{i}")))
        out[c] = (low, high, found[f"s{i}"])
    return footers.rows if footers else found["rows"], {c: out[c] for c in numeric}


def _is_small(low, high) -> bool:
    return low is not None and high is not None and high - low < SMALL_RANGE


def _suggestion(low, high, spread) -> float | None:
    if _is_small(low, high):
        return 1.0
    return width_for_spread(spread)


def profile(df: DataFrame, statistics: Statistics | None = None) -> DataFrame:
    """One row per column: name, position, type, kind, band_suggestion (+ row_count on every row).

    ``statistics`` may be those that a :class:`~kpiframe.sources.table.Table` keeps.
    """
    column_kinds = {f.name: kinds.kind_of(f.dataType) for f in df.schema.fields}
    count, found = statistics or table_statistics(df, column_kinds)
    rows = []
    for position, f in enumerate(df.schema.fields, start=1):
        low, high, spread = found.get(f.name, (None, None, None))
        suggestion = _suggestion(low, high, spread) if f.name in found else None
        rows.append((f.name, position, f.dataType.simpleString(), column_kinds[f.name], suggestion, low, high, count))
    return df.sparkSession.createDataFrame(
        rows,
        "name string, position int, type string, kind string, band_suggestion double, "
        "min_value long, max_value long, row_count long",
    )


def suggest_band(df: DataFrame, column: str) -> float | None:
    """Suggested band width of one numeric column (SCH-5..7); None for other kinds."""
    kind = kinds.column_kinds(df).get(column)
    if not kind or not kinds.is_numeric_kind(kind):
        return None
    return _suggestion(*table_statistics(df, {column: kind})[1][column])


def chart_defaults(df: DataFrame, requested: dict | None = None) -> dict:
    """Initial chart arguments (ARG-4): x = first column, actual = first numeric column,
    no expected, no weight, numeric x banded at its suggested width; valid requested values win."""
    requested = requested or {}
    column_kinds = kinds.column_kinds(df)
    numeric = [c for c, k in column_kinds.items() if kinds.is_numeric_kind(k)]

    def pick(name, allowed, fallback):
        value = requested.get(name)
        return value if value in allowed else fallback

    x = pick("x", list(column_kinds), next(iter(column_kinds), None))
    out = {
        "x": x,
        "actual": pick("actual", numeric, numeric[0] if numeric else None),
        "expected": pick("expected", numeric, None),
        "weight": pick("weight", numeric, None),
    }
    out["band"] = suggest_band(df, x) if x and kinds.is_numeric_kind(column_kinds[x]) else None
    return out
