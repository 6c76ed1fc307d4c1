"""Row predicates: validation, application and saved-filter combination (FLT-*).

A filter is one Spark SQL boolean expression.  Double-quoted names are
identifiers (``"Gross.Weight" >= 4000``), as in ANSI SQL.  Statement
separators and comments are rejected anywhere in the text, and so are the
reflection functions that would let a filter call arbitrary JVM methods.
"""

from __future__ import annotations

import functools
import re
from contextlib import contextmanager
from typing import Iterable, Iterator

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks that no filter may hold, and the error callers see.
FORBIDDEN_TOKENS = (";", "--", "/*", "*/")
FORBIDDEN_ERROR = "Filter must be a single SQL expression without statement separators or comments"
FORBIDDEN_CALLS = re.compile(r"\b(reflect|java_method|try_reflect)\b", re.IGNORECASE)


_PIECES = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`""", re.DOTALL)


def _spark_identifiers(expression: str) -> str:
    """Double-quoted names as backticked ones; string literals and backticked names stay as they are."""

    def rewrite(found: re.Match) -> str:
        piece = found.group()
        if piece[0] != '"':
            return piece
        return "`" + piece[1:-1].replace('""', '"').replace("`", "``") + "`"

    return _PIECES.sub(rewrite, expression)


def normalise_filter(raw: object) -> str:
    """The filter's text, ``""`` for none; text that could hold more than one expression is an error (FLT-2)."""
    text = "" if raw is None else str(raw).strip()
    if any(mark in text for mark in FORBIDDEN_TOKENS):
        raise ValueError(FORBIDDEN_ERROR)
    if FORBIDDEN_CALLS.search(text):
        raise ValueError("Invalid filter: reflection functions are not allowed")
    return text


@contextmanager
def _readable_errors() -> Iterator[None]:
    try:
        yield
    except (AnalysisException, ParseException, PySparkException) as exc:
        lines = str(exc).strip().splitlines()
        raise ValueError(f"Invalid filter: {lines[0] if lines else type(exc).__name__}") from exc


def apply_filter(df: DataFrame, raw: object) -> DataFrame:
    """``df.where(expr)`` after validation; bind errors -> ``ValueError("Invalid filter: …")``.

    The plan is analysed (not run) here, so a bad column or a non-boolean
    predicate fails before any job starts.  The predicate stays ahead of
    everything else so Catalyst pushes it into the scan.
    """
    expression = normalise_filter(raw)
    if not expression:
        return df
    with _readable_errors():
        filtered = df.where(F.expr(_spark_identifiers(expression)))
        filtered.schema  # analysed now
    return filtered


def combine_filters(expressions: Iterable[str], operator: str = "and") -> str:
    """Combine saved filters with AND / OR / NAND / NOR (FLT-4).

    Each member is parenthesised, so an OR inside one filter keeps its meaning.
    None selected -> ``""`` (no filter).
    """
    members = [e.strip() for e in expressions if e and e.strip()]
    if not members:
        return ""
    op = operator.strip().lower()
    if op not in {"and", "or", "nand", "nor"}:
        raise ValueError("Filter operator must be one of and, or, nand, nor")
    joiner = " OR " if op in {"or", "nor"} else " AND "
    combined = joiner.join(f"({m})" for m in members)
    return f"NOT ({combined})" if op in {"nand", "nor"} else combined


def combine_filter_columns(conditions: Iterable[Column], operator: str = "and") -> Column | None:
    """Column form of :func:`combine_filters`."""
    items = list(conditions)
    if not items:
        return None
    op = operator.strip().lower()
    if op in {"or", "nor"}:
        combined = functools.reduce(lambda a, b: a | b, items)
    else:
        combined = functools.reduce(lambda a, b: a & b, items)
    return ~combined if op in {"nand", "nor"} else combined


def filtered_row_count(df: DataFrame, raw: object) -> int:
    """Rows passing the filter; blank filter = all rows (SCH-4)."""
    return apply_filter(df, raw).count()


def row_counts(df: DataFrame, raw: object) -> DataFrame:
    """One row: ``row_count`` and ``filtered_row_count`` in a single scan (SCH-3, SCH-4)."""
    expression = normalise_filter(raw)
    with _readable_errors():
        passes = F.expr(_spark_identifiers(expression)) if expression else F.lit(True)
        counted = df.agg(
            F.count(F.lit(1)).alias("row_count"), F.count(F.when(passes, F.lit(1))).alias("filtered_row_count")
        )
        counted.schema
    return counted


def check_filters(df: DataFrame, filters: DataFrame | list[tuple[str, str]]) -> list[tuple[str, bool, str]]:
    """Bind every saved filter against ``df``: ``(name, ok, error)`` per filter.

    Analysis only — no job runs.  ``filters`` is the ``(name, expression)``
    DataFrame of :func:`kpiframe.sources.saved_filters.load_saved_filters`
    (a handful of rows) or a list of pairs.
    """
    pairs = [(r["name"], r["expression"]) for r in filters.collect()] if isinstance(filters, DataFrame) else list(filters)
    results = []
    for name, expression in pairs:
        try:
            apply_filter(df, expression)
            results.append((name, True, ""))
        except ValueError as exc:
            results.append((name, False, str(exc)))
    return results
