"""Text labels for grouping keys (KEY-8..11).

Labels must read the same as a SQL engine's ``CAST(x AS VARCHAR)``: doubles
print in plain notation between 1e-4 and 1e16 (Spark's own cast switches to
``1.0E7`` at 1e7), and in ``1e+16`` / ``1e-05`` style outside that range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "(missing)"
QUANTILE_MISSING = "Missing"
QUANTILE_MISSING_SORT = 1000001


def double_text_sql(q: str) -> str:
    """Plain-notation text of the double SQL expression ``q``, as SQL (parsed once by Spark).

    Spark prints the shortest digits that give the double back, as ``d.dddE[-]x`` outside 1e-3 .. 1e7; in the
    plain range only the point moves, over the same digits.
    """
    s = f"CAST({q} AS STRING)"
    sign = f"CASE WHEN startswith({s}, '-') THEN '-' ELSE '' END"
    exponent = f"TRY_CAST(regexp_extract({s}, 'E(-?[0-9]+)$', 1) AS INT)"
    # Digits without the point; the mantissa's trailing ".0" has no digit of its own.
    digits = f"replace(regexp_replace(regexp_extract({s}, '^-?([0-9.]+)E', 1), '\\\\.0$', ''), '.', '')"
    small = f"concat({sign}, '0.', repeat('0', -{exponent} - 1), {digits})"
    # rpad fills up missing digits and cuts those behind the point.
    large = (f"concat({sign}, rpad({digits}, {exponent} + 1, '0'), '.', "
             f"CASE WHEN length({digits}) > {exponent} + 1 THEN substring({digits}, {exponent} + 2) ELSE '0' END)")
    mantissa = f"regexp_replace(regexp_extract({s}, '^(-?[0-9.]+)E', 1), '\\\\.0$', '')"
    power = f"concat(CASE WHEN {exponent} < 0 THEN '-' ELSE '+' END, lpad(CAST(abs({exponent}) AS STRING), 2, '0'))"
    return (
        f"CASE WHEN isnan({q}) THEN 'nan' WHEN {q} = double('inf') THEN 'inf' WHEN {q} = double('-inf') THEN '-inf' "
        f"WHEN NOT contains({s}, 'E') THEN {s} "
        f"WHEN abs({q}) >= 1e-4 AND abs({q}) < 1 THEN {small} "
        f"WHEN abs({q}) >= 1 AND abs({q}) < 1e16 THEN {large} "
        f"ELSE concat({mantissa}, 'e', {power}) END"
    )


def label_sql(q: str, kind: str) -> str:
    """Label SQL for a key SQL expression ``q`` of an integer / numeric / temporal key."""
    if kind == "integer":
        body = f"CAST(TRY_CAST(rint({q}) AS BIGINT) AS STRING)"
    elif kind == "numeric":
        body = double_text_sql(q)
    else:
        body = f"CAST({q} AS STRING)"
    return f"CASE WHEN {q} IS NULL THEN '{MISSING}' ELSE {body} END"


def temporal_label(key: Column) -> Column:
    """Date / datetime label (KEY-10)."""
    return F.when(key.isNull(), F.lit(MISSING)).otherwise(key.cast("string"))


def quantile_label(tile: Column) -> Column:
    """``Q<k>`` or ``Missing`` (KEY-11)."""
    return F.when(tile.isNull(), F.lit(QUANTILE_MISSING)).otherwise(F.concat(F.lit("Q"), tile.cast("string")))
