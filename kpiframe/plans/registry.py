"""Registered queries: each reference operator run over the driver's tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB
SQL over the same parquet views) return the same columns.  Doubles are
rounded to 6 places on both sides so summation order cannot flip a hash.
Nulls, zeros and negatives the tables lack are projected in by the same
rule on both sides (e.g. ``o_orderkey % 7 = 0`` -> null).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiframe.plans import oracle as O
from kpiframe.operators.ordering import PagedRows
from kpiframe.plans.chart import ROW_ORDER, chart

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None):
    def wrap(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Sums (weights, numerators) are rounded to 3 places: finer than the inputs'
# 2-3 decimal granularity, coarser than the engines' different summation
# orders (~1e-6 on sums near 1e9).  Ratios and means keep 6 places.
SUM_COLUMNS = {"volume", "resp0_num", "resp0_den", "resp1_num", "resp1_den", "numerator", "denominator"}
SUM_ROUND = 3


def round_sql(c: str, places: int) -> str:
    """Round like SQL engines do for doubles: scale, round half away from zero on the binary value, unscale.

    (Spark's own ``round`` rounds the shortest decimal text half-up, which
    can break a tie the other way.)
    """
    m = f"{float(10 ** places)!r}D"
    y = f"({c} * {m})"
    return (f"CAST(CASE WHEN abs({y}) >= 4503599627370496D THEN {y} / {m} ELSE signum({y}) * "  # 2^52: no fraction left
            f"CASE WHEN abs({y}) - floor(abs({y})) >= 0.5D THEN ceil(abs({y})) ELSE floor(abs({y})) END / {m} END AS DOUBLE)")


def out(df: DataFrame, columns: list[str]) -> DataFrame:
    """Select ``columns``; doubles rounded (sums to 3 places, other values to 6)."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    sel = []
    for c in columns:
        if isinstance(types.get(c), (T.DoubleType, T.FloatType)):
            places = SUM_ROUND if c in SUM_COLUMNS else O.ROUND
            sel.append(f"{round_sql(c, places)} AS {c}")
        else:
            sel.append(c)
    return df.selectExpr(*sel)


def rd(c: str) -> str:
    places = SUM_ROUND if c in SUM_COLUMNS or c == "num0" else O.ROUND
    return f"{O.r(c, places)} AS {c}"


# --- derived inputs with projected nulls (same rule in Spark and SQL) -------------------

def orders_nulls(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        "o_orderdate",
        F.when(o.o_orderkey % 7 == 0, F.lit(None)).otherwise(o.o_orderpriority).alias("priority"),
        F.when(o.o_orderkey % 11 == 0, F.lit(None)).otherwise(o.o_totalprice).alias("price"),
        (o.o_totalprice * 0.9 + (o.o_orderkey % 13) * 100.0).alias("expected"),
        F.when(o.o_orderkey % 5 == 0, F.lit(None)).otherwise(o.o_totalprice).alias("price_q"),
        o.o_orderstatus,
        o.o_totalprice,
    )


ORDERS_NULLS = """(SELECT o_orderkey, o_orderdate,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price,
  o_totalprice * 0.9 + (o_orderkey % 13) * 100.0 AS expected,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price_q,
  o_orderstatus, o_totalprice FROM orders) src"""


def customer_weights(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    w = (
        F.when(c.c_custkey % 10 == 0, F.lit(None).cast("double"))
        .when(c.c_custkey % 10 == 1, F.lit(0.0))
        .when(c.c_custkey % 10 == 2, F.lit(-1.5))
        .otherwise((c.c_custkey % 9 + 1).cast("double"))
    )
    actual = F.when(c.c_custkey % 17 == 0, F.lit(None).cast("double")).otherwise(c.c_acctbal)
    return c.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", w.alias("wt"), actual.alias("bal"))


CUSTOMER_WEIGHTS = """(SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal,
  CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 0.0 WHEN c_custkey % 10 = 2 THEN -1.5
       ELSE CAST(c_custkey % 9 + 1 AS DOUBLE) END AS wt,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer) src"""

ALPHA = "lower(x), x"
ORDERED = "x_sort ASC NULLS LAST, lower(x), x"

# --- chart: keys ---------------------------------------------------------------------


@register(
    "chart_category_weighted",
    O.chart_sql("lineitem", O.category_key("l_returnflag"), O.category_key("l_returnflag"), O.category_key("l_returnflag"),
                ["l_extendedprice"], "l_quantity", ALPHA,
                ["x", "position", rd("volume"), rd("num0") .replace(" AS num0", " AS resp0_num"), rd("resp0")],
                where="l_discount >= 0.02"),
)
def chart_category_weighted(spark, sf):
    res = chart(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", weight="l_quantity",
                filter="l_discount >= 0.02")
    return out(res.rows, ["x", "position", "volume", "resp0_num", "resp0"])


@register(
    "chart_category_missing",
    O.chart_sql(ORDERS_NULLS, O.category_key("priority"), O.category_key("priority"), O.category_key("priority"),
                ["price"], None, ALPHA, ["x", "position", rd("volume"), rd("resp0")]),
)
def chart_category_missing(spark, sf):
    res = chart(orders_nulls(spark, sf), "priority", "price")
    return out(res.rows, ["x", "position", "volume", "resp0"])


@register(
    "chart_two_responses_row_average",
    O.chart_sql(ORDERS_NULLS, O.category_key("o_orderstatus"), O.category_key("o_orderstatus"), O.category_key("o_orderstatus"),
                ["price", "expected"], None, ALPHA, ["x", "position", rd("volume"), rd("resp0"), rd("resp1")]),
)
def chart_two_responses_row_average(spark, sf):
    res = chart(orders_nulls(spark, sf), "o_orderstatus", "price", "expected")
    return out(res.rows, ["x", "position", "volume", "resp0", "resp1"])


@register(
    "chart_volume_only",
    O.chart_sql("events", O.category_key("event_type"), O.category_key("event_type"), O.category_key("event_type"),
                [], None, ALPHA, ["x", "position", rd("volume")]),
)
def chart_volume_only(spark, sf):
    res = chart(table(spark, sf, "events"), "event_type")
    return out(res.rows, ["x", "position", "volume"])


@register(
    "chart_raw_integer",
    O.chart_sql("part", "TRY_CAST(p_size AS DOUBLE)", O.integer_label("TRY_CAST(p_size AS DOUBLE)"), "TRY_CAST(p_size AS DOUBLE)",
                ["p_retailprice"], None, ORDERED, ["x", "position", rd("volume"), rd("resp0")]),
)
def chart_raw_integer(spark, sf):
    res = chart(table(spark, sf, "part"), "p_size", "p_retailprice")
    return out(res.rows, ["x", "position", "volume", "resp0"])


@register(
    "chart_raw_numeric",
    O.chart_sql("lineitem", "TRY_CAST(l_discount AS DOUBLE)", O.numeric_label("TRY_CAST(l_discount AS DOUBLE)"),
                "TRY_CAST(l_discount AS DOUBLE)", ["l_extendedprice"], "l_quantity", ORDERED,
                ["x", "position", rd("volume"), rd("resp0")]),
)
def chart_raw_numeric(spark, sf):
    res = chart(table(spark, sf, "lineitem"), "l_discount", "l_extendedprice", weight="l_quantity")
    return out(res.rows, ["x", "position", "volume", "resp0"])


_QB = "FLOOR(TRY_CAST(l_quantity AS DOUBLE) / 10.0) * 10.0"


@register(
    "chart_fixed_band",
    O.chart_sql("lineitem", _QB, O.numeric_label(_QB), _QB, ["l_extendedprice", "l_tax"], None, ORDERED,
                ["x", "position", rd("volume"), rd("resp0"), rd("resp1")]),
)
def chart_fixed_band(spark, sf):
    res = chart(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_tax", band=10)
    return out(res.rows, ["x", "position", "volume", "resp0", "resp1"])


_SB = "FLOOR(TRY_CAST(p_size AS DOUBLE) / 5.0) * 5.0"


@register(
    "chart_fixed_band_integer",
    O.chart_sql("part", _SB, O.integer_label(_SB), _SB, ["p_retailprice"], None, ORDERED,
                ["x", "position", rd("volume"), rd("resp0")]),
)
def chart_fixed_band_integer(spark, sf):
    res = chart(table(spark, sf, "part"), "p_size", "p_retailprice", band=5)
    return out(res.rows, ["x", "position", "volume", "resp0"])


def _quantile_source(src: str, x: str, tie: str, n: int, where: str = "") -> str:
    w = f" WHERE ({where})" if where else ""
    xd = f"TRY_CAST({x} AS DOUBLE)"
    return (
        f"(SELECT b.*, NTILE({n}) OVER (ORDER BY {xd}, {tie}) AS tile FROM (SELECT * FROM {src}{w}) b WHERE {xd} IS NOT NULL "
        f"UNION ALL SELECT b.*, NULL AS tile FROM (SELECT * FROM {src}{w}) b WHERE {xd} IS NULL) q"
    )


_QLABEL = "CASE WHEN tile IS NULL THEN 'Missing' ELSE 'Q' || CAST(tile AS VARCHAR) END"
_QSORT = "COALESCE(tile, 1000001)"


@register(
    "chart_quantile_band",
    O.chart_sql(_quantile_source("orders", "o_totalprice", "o_orderkey", 10), "tile", _QLABEL, _QSORT,
                ["o_totalprice"], None, ORDERED, ["x", "position", rd("volume"), rd("resp0")]),
)
def chart_quantile_band(spark, sf):
    res = chart(table(spark, sf, "orders"), "o_totalprice", "o_totalprice", quantiles=10, tie_by=["o_orderkey"])
    return out(res.rows, ["x", "position", "volume", "resp0"])


@register(
    "chart_quantile_ties",
    O.chart_sql(_quantile_source("lineitem", "l_quantity", "l_orderkey, l_linenumber, l_extendedprice", 7), "tile", _QLABEL, _QSORT,
                ["l_extendedprice"], None, ORDERED, ["x", "position", rd("volume"), rd("resp0")]),
)
def chart_quantile_ties(spark, sf):
    # l_quantity has only 50 distinct values: most tile edges fall inside a value,
    # so rows of straddling values are ranked individually by the tie keys.
    res = chart(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", quantiles=7,
                tie_by=["l_orderkey", "l_linenumber", "l_extendedprice"])
    return out(res.rows, ["x", "position", "volume", "resp0"])


@register(
    "chart_quantile_missing",
    O.chart_sql(_quantile_source(ORDERS_NULLS, "price_q", "o_orderkey", 4), "tile", _QLABEL, _QSORT,
                ["o_totalprice"], None, ORDERED, ["x", "position", rd("volume"), rd("resp0")]),
)
def chart_quantile_missing(spark, sf):
    res = chart(orders_nulls(spark, sf), "price_q", "o_totalprice", quantiles=4, tie_by=["o_orderkey"])
    return out(res.rows, ["x", "position", "volume", "resp0"])


def _bucket_sql(src: str, col: str, bucket: str, resp: str) -> str:
    key = f"CAST(DATE_TRUNC('{bucket}', {col}) AS TIMESTAMP)"
    label = f"CASE WHEN {key} IS NULL THEN '(missing)' ELSE CAST({key} AS VARCHAR) END"
    return O.chart_sql(src, key, label, key, [resp], None, ORDERED, ["x", "position", rd("volume"), rd("resp0")])


for _name, _src, _col, _bucket, _resp in [
    ("chart_hour", "events", "ts", "hour", "value"),
    ("chart_day", "events", "ts", "day", "value"),
    ("chart_week", "events", "ts", "week", "value"),
    ("chart_month", "lineitem", "l_shipdate", "month", "l_extendedprice"),
    ("chart_year", "lineitem", "l_shipdate", "year", "l_extendedprice"),
]:
    def _make(src=_src, col=_col, bucket=_bucket, resp=_resp):
        def q(spark, sf):
            res = chart(table(spark, sf, src), col, resp, bucket=bucket)
            return out(res.rows, ["x", "position", "volume", "resp0"])
        return q

    register(_name, _bucket_sql(_src, _col, _bucket, _resp))(_make())


# --- totals, weight quality, counts, filters --------------------------------------------


@register(
    "chart_totals",
    """WITH base AS (SELECT * FROM """ + ORDERS_NULLS + """),
w AS (SELECT CASE WHEN price IS NOT NULL AND expected IS NOT NULL THEN 1.0 END AS w, price, expected FROM base),
s AS (SELECT SUM(CASE WHEN w IS NOT NULL THEN price END) AS n0, SUM(CASE WHEN w IS NOT NULL THEN expected END) AS n1,
             COALESCE(SUM(w), 0) AS d FROM w)
SELECT 0 AS response, 'Actual' AS label, round(CAST(n0 / NULLIF(d, 0) AS DOUBLE), 6) AS value,
  round(CAST(n0 AS DOUBLE), 3) AS numerator, round(CAST(d AS DOUBLE), 3) AS denominator FROM s
UNION ALL
SELECT 1, 'Expected', round(CAST(n1 / NULLIF(d, 0) AS DOUBLE), 6), round(CAST(n1 AS DOUBLE), 3), round(CAST(d AS DOUBLE), 3) FROM s""",
)
def chart_totals(spark, sf):
    res = chart(orders_nulls(spark, sf), "o_orderstatus", "price", "expected")
    return out(res.totals, ["response", "label", "value", "numerator", "denominator"])


_QUALITY_SQL = """WITH base AS (SELECT * FROM """ + CUSTOMER_WEIGHTS + """),
q AS (SELECT
  COALESCE(SUM(CASE WHEN bal IS NOT NULL AND wt IS NOT NULL THEN wt END), 0) AS value,
  COUNT(*) AS filtered_row_count,
  CAST(SUM(CASE WHEN bal IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_response_rows,
  CAST(SUM(CASE WHEN wt IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_weight_rows,
  CAST(SUM(CASE WHEN wt = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_weight_rows,
  CAST(SUM(CASE WHEN wt < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_weight_rows
  FROM base)"""


def _quality_chart(spark, sf):
    return chart(customer_weights(spark, sf), "c_mktsegment", "bal", weight="wt")


@register("weight_quality", _QUALITY_SQL + "\nSELECT round(CAST(value AS DOUBLE), 6) AS value, filtered_row_count, missing_response_rows, "
          "missing_weight_rows, zero_weight_rows, negative_weight_rows FROM q")
def weight_quality(spark, sf):
    return out(_quality_chart(spark, sf).quality, ["value", "filtered_row_count", "missing_response_rows",
                                                   "missing_weight_rows", "zero_weight_rows", "negative_weight_rows"])


def _rows(n: str) -> str:
    return f"format('{{:,}}', {n}) || CASE WHEN {n} = 1 THEN ' row' ELSE ' rows' END"


def _verb(n: str) -> str:
    return f"CASE WHEN {n} = 1 THEN 'has' ELSE 'have' END"


@register(
    "weight_warnings",
    _QUALITY_SQL + f""",
wl AS (
  SELECT 0 AS position, 'missing_response' AS code, missing_response_rows AS count,
         {_rows('missing_response_rows')} || ' excluded from Weight because one or more selected response values were missing.' AS message FROM q
  UNION ALL SELECT 1, 'missing_weight', missing_weight_rows,
         {_rows('missing_weight_rows')} || ' excluded from Weight because wt was missing.' FROM q
  UNION ALL SELECT 2, 'zero_weight', zero_weight_rows,
         {_rows('zero_weight_rows')} || ' ' || {_verb('zero_weight_rows')} || ' zero wt.' FROM q
  UNION ALL SELECT 3, 'negative_weight', negative_weight_rows,
         {_rows('negative_weight_rows')} || ' ' || {_verb('negative_weight_rows')} || ' negative wt.' FROM q)
SELECT position, code, count, message FROM wl WHERE count > 0""",
)
def weight_warnings(spark, sf):
    return out(_quality_chart(spark, sf).warnings, ["position", "code", "count", "message"])


@register(
    "filtered_counts",
    "SELECT COUNT(*) AS row_count, CAST(SUM(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 150000 THEN 1 ELSE 0 END) AS BIGINT) "
    "AS filtered_row_count FROM orders",
)
def filtered_counts(spark, sf):
    from kpiframe.operators.filters import row_counts

    return row_counts(table(spark, sf, "orders"), "o_orderstatus = 'F' AND o_totalprice > 150000")


_SAVED = ["o_orderstatus = 'F'", "o_totalprice > 150000 OR o_orderpriority = '1-URGENT'"]

for _op in ("and", "or", "nand", "nor"):
    def _mk(op=_op):
        def q(spark, sf):
            from kpiframe.operators.filters import combine_filters

            res = chart(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice",
                        filter=combine_filters(_SAVED, op))
            return out(res.rows, ["x", "position", "volume", "resp0"])
        return q

    _joiner = " OR " if _op in ("or", "nor") else " AND "
    _expr = _joiner.join(f"({e})" for e in _SAVED)
    if _op in ("nand", "nor"):
        _expr = f"NOT ({_expr})"
    register(
        f"filter_{_op}",
        O.chart_sql("orders", O.category_key("o_orderpriority"), O.category_key("o_orderpriority"),
                    O.category_key("o_orderpriority"), ["o_totalprice"], None, ALPHA,
                    ["x", "position", rd("volume"), rd("resp0")], where=_expr),
    )(_mk())


@register(
    "filter_quoted_date_literal",
    O.chart_sql("orders", O.category_key("o_orderstatus"), O.category_key("o_orderstatus"), O.category_key("o_orderstatus"),
                ["o_totalprice"], None, ALPHA, ["x", "position", rd("volume"), rd("resp0")],
                where="\"o_orderdate\" >= TIMESTAMP '1996-01-01' AND \"o_orderpriority\" ILIKE '%urgent%'"),
)
def filter_quoted_date_literal(spark, sf):
    res = chart(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice",
                filter="\"o_orderdate\" >= TIMESTAMP '1996-01-01' AND \"o_orderpriority\" ILIKE '%urgent%'")
    return out(res.rows, ["x", "position", "volume", "resp0"])


# --- sigma ------------------------------------------------------------------------------

_BOUNDS = [
    "round(CASE WHEN sigma_se IS NOT NULL AND resp1 IS NOT NULL THEN resp1 - {k} * sigma_se END, 6) AS resp1_low",
    "round(CASE WHEN sigma_se IS NOT NULL AND resp1 IS NOT NULL THEN resp1 + {k} * sigma_se END, 6) AS resp1_high",
]
_SIG_COLS = ["x", "position", "is_tail", rd("volume"), rd("resp0"), rd("resp1"), rd("sigma_se"), "valid_folds"]


@register(
    "sigma_groups",
    O.chart_sql(ORDERS_NULLS, O.category_key("priority"), O.category_key("priority"), O.category_key("priority"),
                ["o_totalprice", "expected"], None, ALPHA,
                _SIG_COLS + [b.format(k="2.0") for b in _BOUNDS], fold_key="o_orderkey"),
)
def sigma_groups(spark, sf):
    res = chart(orders_nulls(spark, sf), "priority", "o_totalprice", "expected", sigma=2, fold_by=["o_orderkey"])
    return out(res.rows, ["x", "position", "is_tail", "volume", "resp0", "resp1", "sigma_se", "valid_folds",
                          "resp1_low", "resp1_high"])


_PB = "FLOOR(TRY_CAST(o_totalprice AS DOUBLE) / 50000.0) * 50000.0"


@register(
    "sigma_tails",
    O.chart_sql(ORDERS_NULLS, _PB, O.numeric_label(_PB), _PB, ["price", "expected"], None, ORDERED,
                _SIG_COLS + [b.format(k="1.0") for b in _BOUNDS], fold_key="o_orderkey",
                tails=("ordered", "700")),
)
def sigma_tails(spark, sf):
    res = chart(orders_nulls(spark, sf), "o_totalprice", "price", "expected", band=50000, low_weight="700",
                sigma=1, fold_by=["o_orderkey"])
    return out(res.rows, ["x", "position", "is_tail", "volume", "resp0", "resp1", "sigma_se", "valid_folds",
                          "resp1_low", "resp1_high"])


# --- tails / Other ----------------------------------------------------------------------

_TAIL_COLS = ["x", "position", "is_tail", rd("volume"), rd("resp0")]
_TAIL_OUT = ["x", "position", "is_tail", "volume", "resp0"]
_LQ = "TRY_CAST(l_quantity AS DOUBLE)"


@register(
    "tails_absolute",
    O.chart_sql("lineitem", _LQ, O.numeric_label(_LQ), _LQ, ["l_extendedprice"], None, ORDERED, _TAIL_COLS,
                tails=("ordered", "5000")),
)
def tails_absolute(spark, sf):
    res = chart(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", low_weight="5000")
    return out(res.rows, _TAIL_OUT)


_MONTH = "CAST(DATE_TRUNC('month', l_shipdate) AS TIMESTAMP)"


@register(
    "tails_percent",
    O.chart_sql("lineitem", _MONTH, f"CASE WHEN {_MONTH} IS NULL THEN '(missing)' ELSE CAST({_MONTH} AS VARCHAR) END",
                _MONTH, ["l_extendedprice"], "l_quantity", ORDERED, _TAIL_COLS,
                tails=("ordered", "(SELECT SUM(volume) FROM g) * 5 / 100")),
)
def tails_percent(spark, sf):
    res = chart(table(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice", weight="l_quantity", bucket="month",
                low_weight="5%")
    return out(res.rows, _TAIL_OUT)


_AB = "FLOOR(TRY_CAST(c_acctbal AS DOUBLE) / 1000.0) * 1000.0"


@register(
    "tails_with_negative_weight",
    O.chart_sql(CUSTOMER_WEIGHTS, _AB, O.numeric_label(_AB), _AB, ["bal"], "wt", ORDERED, _TAIL_COLS,
                tails=("ordered", "400")),
)
def tails_with_negative_weight(spark, sf):
    res = chart(customer_weights(spark, sf), "c_acctbal", "bal", weight="wt", band=1000, low_weight="400")
    return out(res.rows, _TAIL_OUT)


_BRAND = O.category_key("p_brand")


@register(
    "other_group",
    O.chart_sql("part", _BRAND, _BRAND, _BRAND, ["p_retailprice"], "p_size", ALPHA, _TAIL_COLS,
                tails=("other", "(SELECT SUM(volume) FROM g) * 3.5 / 100")),
)
def other_group(spark, sf):
    res = chart(table(spark, sf, "part"), "p_brand", "p_retailprice", weight="p_size", low_weight="3.5%")
    return out(res.rows, _TAIL_OUT)


@register(
    "tails_quantile_missing",
    O.chart_sql(_quantile_source(ORDERS_NULLS, "price_q", "o_orderkey", 10), "tile", _QLABEL, _QSORT,
                ["o_totalprice"], None, ORDERED, _TAIL_COLS, tails=("ordered", "2500"), quantile=True),
)
def tails_quantile_missing(spark, sf):
    res = chart(orders_nulls(spark, sf), "price_q", "o_totalprice", quantiles=10, tie_by=["o_orderkey"],
                low_weight="2500")
    return out(res.rows, _TAIL_OUT)


# --- sort modes, cap, paging ------------------------------------------------------------

_SORT_ORDERS = {
    "alpha": ALPHA,
    "volume": "is_tail DESC, volume DESC, lower(x), x",
    "actual": "resp0 DESC NULLS LAST, lower(x), x",
    "expected": "resp1 DESC NULLS LAST, lower(x), x",
}
for _mode, _order in _SORT_ORDERS.items():
    def _mk_sort(mode=_mode):
        def q(spark, sf):
            res = chart(table(spark, sf, "part"), "p_brand", "p_retailprice", "p_size", weight="p_size",
                        low_weight="3.5%", sort=mode)
            return out(res.rows, ["x", "position", "is_tail", "volume", "resp0", "resp1"])
        return q

    register(
        f"sort_{_mode}",
        O.chart_sql("part", _BRAND, _BRAND, _BRAND, ["p_retailprice", "p_size"], "p_size", _order,
                    ["x", "position", "is_tail", rd("volume"), rd("resp0"), rd("resp1")],
                    tails=("other", "(SELECT SUM(volume) FROM g) * 3.5 / 100")),
    )(_mk_sort())

_PK = "TRY_CAST(l_partkey AS DOUBLE)"


@register(
    "group_cap",
    O.chart_sql("lineitem", _PK, O.integer_label(_PK), _PK, ["l_extendedprice"], None, ORDERED,
                ["x", "position", rd("volume"), rd("resp0")], final_where="position <= 100"),
)
def group_cap(spark, sf):
    res = chart(table(spark, sf, "lineitem"), "l_partkey", "l_extendedprice", max_groups=100)
    return out(res.rows, ["x", "position", "volume", "resp0"])


@register(
    "table_page",
    "SELECT x, position, page, pages FROM (SELECT x, position, pages, LEAST(GREATEST(2, 1), pages) AS page FROM ("
    "SELECT x, position, CAST(GREATEST(1, CEIL(COUNT(*) OVER () / 1000.0)) AS BIGINT) AS pages FROM ("
    + O.chart_sql("lineitem", _PK, O.integer_label(_PK), _PK, ["l_extendedprice"], None, ORDERED,
                  ["x", "position"], final_where="position <= 2500")
    + ") capped) c) p WHERE position > (page - 1) * 1000 AND position <= page * 1000",
)
def table_page(spark, sf):
    from kpiframe.operators.ordering import table_page as page_of

    res = chart(table(spark, sf, "lineitem"), "l_partkey", "l_extendedprice", max_groups=2500)
    return page_of(res.rows, page=2, page_size=1000).select("x", "position", "page", "pages")


# --- transforms -------------------------------------------------------------------------

def _avg(i: int) -> str:
    return f"(SUM(COALESCE(num{i}, 0)) OVER () / NULLIF(SUM(COALESCE(volume, 0)) OVER (), 0))"


def _fin(e: str) -> str:
    return f"CASE WHEN isfinite({e}) THEN {e} END"


_TRANSFORM_SQL = {
    "log": lambda v, i: f"CASE WHEN {v} > 0 THEN ln({v}) END",
    "exp": lambda v, i: _fin(f"exp({v})"),
    "logit": lambda v, i: f"CASE WHEN {v} > 0 AND {v} < 1 THEN ln({v} / (1 - {v})) END",
    "zero": lambda v, i: f"{v} - {_avg(i)}",
    "one": lambda v, i: f"{v} / NULLIF({_avg(i)}, 0)",
}
_TRANSFORM_INPUT = {
    "log": ("l_discount", "l_tax"),
    "exp": ("l_discount", "l_tax"),
    "logit": ("l_discount", "l_tax"),
    "zero": ("l_extendedprice", "l_quantity"),
    "one": ("l_extendedprice", "l_quantity"),
}


def shifted_items(spark, sf):
    """lineitem with values around the edges of the transforms' domains: zero, negative, above one, huge."""
    return table(spark, sf, "lineitem").select(
        "l_suppkey", "l_extendedprice", "l_quantity",
        (F.col("l_discount") * 30 - F.col("l_suppkey") % 4).alias("l_discount"),
        (F.col("l_tax") + (F.col("l_suppkey") % 2) * 800).alias("l_tax"),
    )


SHIFTED_ITEMS = """(SELECT l_suppkey, l_extendedprice, l_quantity, l_discount * 30 - l_suppkey % 4 AS l_discount,
  l_tax + (l_suppkey % 2) * 800 AS l_tax FROM lineitem) src"""
for _t, (_a, _e) in _TRANSFORM_INPUT.items():
    def _mk_t(t=_t, a=_a, e=_e):
        def q(spark, sf):
            res = chart(shifted_items(spark, sf), "l_suppkey", a, e, transform=t)
            return out(res.rows, ["x", "position", "volume", "resp0", "resp1"])
        return q

    _LS = "TRY_CAST(l_suppkey AS DOUBLE)"
    register(
        f"transform_{_t}",
        O.chart_sql(SHIFTED_ITEMS, _LS, O.integer_label(_LS), _LS, [_a, _e], None, ORDERED,
                    ["x", "position", rd("volume"),
                     f"round({_TRANSFORM_SQL[_t]('resp0', 0)}, 6) AS resp0",
                     f"round({_TRANSFORM_SQL[_t]('resp1', 1)}, 6) AS resp1"]),
    )(_mk_t())


@register(
    "transform_invalid_count",
    "SELECT 4 AS position, 'transform_domain' AS code, CAST(SUM(bad) AS BIGINT) AS count, "
    "CAST(SUM(bad) AS VARCHAR) || ' response values could not be shown because they are outside the log transform domain.' AS message "
    "FROM (" + O.chart_sql(CUSTOMER_WEIGHTS, "TRY_CAST(c_nationkey AS DOUBLE)", O.integer_label("TRY_CAST(c_nationkey AS DOUBLE)"),
                           "TRY_CAST(c_nationkey AS DOUBLE)", ["shifted"], None, ORDERED,
                           ["CASE WHEN resp0 IS NOT NULL AND resp0 <= 0 THEN 1 ELSE 0 END AS bad"]).replace(
        "SELECT * FROM " + CUSTOMER_WEIGHTS, "SELECT *, c_acctbal - 4500 AS shifted FROM " + CUSTOMER_WEIGHTS)
    + ") b HAVING SUM(bad) > 0",
)
def transform_invalid_count(spark, sf):
    df = customer_weights(spark, sf).withColumn("shifted", F.col("c_acctbal") - 4500)
    res = chart(df, "c_nationkey", "shifted", transform="log")
    return res.warnings.where(F.col("code") == "transform_domain")


# --- geo ----------------------------------------------------------------------------------

def geo_input(spark: SparkSession, sf: str) -> DataFrame:
    c = customer_weights(spark, sf)
    n = table(spark, sf, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    sector = F.concat(F.col("n_name"), F.lit(" "), (F.col("c_custkey") % 4).cast("string"))
    return j.select(
        "c_custkey", "c_nationkey", "c_mktsegment", "wt", "bal",
        F.when(F.col("c_custkey") % 23 == 0, F.lit("  ")).otherwise(F.col("n_name")).alias("area"),
        sector.alias("sector"),
        F.concat(sector, F.lit("-"), (F.col("c_custkey") % 5).cast("string")).alias("unit"),
        F.when(F.col("c_custkey") % 19 == 0, F.lit(999.0))
        .otherwise(F.lit(50.0) + F.col("c_nationkey") / 2.0 + (F.col("c_custkey") % 7) / 97.0).alias("lat"),
        F.when(F.col("c_custkey") % 29 == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(-5.0) + F.col("c_acctbal") / 1999.0).alias("lon"),
    )


GEO_INPUT = """(SELECT c_custkey, c_nationkey, c_mktsegment, wt, bal,
  CASE WHEN c_custkey % 23 = 0 THEN '  ' ELSE n_name END AS area,
  n_name || ' ' || CAST(c_custkey % 4 AS VARCHAR) AS sector,
  n_name || ' ' || CAST(c_custkey % 4 AS VARCHAR) || '-' || CAST(c_custkey % 5 AS VARCHAR) AS unit,
  CASE WHEN c_custkey % 19 = 0 THEN 999.0 ELSE 50.0 + c_nationkey / 2.0 + (c_custkey % 7) / 97.0 END AS lat,
  CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE -5.0 + c_acctbal / 1999.0 END AS lon
  FROM """ + CUSTOMER_WEIGHTS + """ JOIN nation ON c_nationkey = n_nationkey) gsrc"""


def geo_sql(key: str, where: str = "", unit: bool = False) -> str:
    w = f" WHERE ({where})" if where else ""
    coords = ""
    if unit:
        coords = (", AVG(CASE WHEN TRY_CAST(lat AS DOUBLE) BETWEEN -90 AND 90 THEN TRY_CAST(lat AS DOUBLE) END) AS latitude"
                  ", AVG(CASE WHEN TRY_CAST(lon AS DOUBLE) BETWEEN -180 AND 180 THEN TRY_CAST(lon AS DOUBLE) END) AS longitude")
    return f"""s AS (
  SELECT k AS key, COUNT(*) AS row_count,
    SUM(CASE WHEN w IS NOT NULL THEN r END) AS numerator, COALESCE(SUM(w), 0) AS denominator{coords}
  FROM (SELECT *, NULLIF(TRIM(CAST({key} AS VARCHAR)), '') AS k,
          CASE WHEN TRY_CAST(bal AS DOUBLE) IS NOT NULL AND TRY_CAST(wt AS DOUBLE) IS NOT NULL THEN TRY_CAST(wt AS DOUBLE) END AS w,
          TRY_CAST(bal AS DOUBLE) AS r
        FROM {GEO_INPUT}{w}) x
  WHERE k IS NOT NULL GROUP BY k),
sv AS (SELECT *, denominator AS volume, CASE WHEN isfinite(numerator / NULLIF(denominator, 0)) THEN numerator / NULLIF(denominator, 0) END AS value FROM s)"""


_GEO_COLS = ["key", "row_count", rd("numerator"), rd("denominator"), rd("volume"), rd("value")]
_GEO_OUT = ["key", "row_count", "numerator", "denominator", "volume", "value"]


def _geo(spark, sf, level, **kw):
    from kpiframe.plans.geo import geo_summary

    return geo_summary(geo_input(spark, sf), level, "bal", weight="wt", key_col=level if level != "unit" else "unit",
                       lat_col="lat", lon_col="lon", **kw)


@register("geo_area", "WITH " + geo_sql("area") + f"\nSELECT {', '.join(_GEO_COLS)} FROM sv")
def geo_area(spark, sf):
    return out(_geo(spark, sf, "area").rows, _GEO_OUT)


@register("geo_sector", "WITH " + geo_sql("sector", "c_mktsegment <> 'AUTOMOBILE'") + f"\nSELECT {', '.join(_GEO_COLS)} FROM sv")
def geo_sector(spark, sf):
    return out(_geo(spark, sf, "sector", filter="c_mktsegment <> 'AUTOMOBILE'").rows, _GEO_OUT)


_UNIT_STATUS = """, us AS (SELECT *, CASE WHEN value IS NULL THEN 'missing_value'
  WHEN latitude IS NULL OR longitude IS NULL THEN 'missing_coordinate' ELSE 'plotted' END AS status FROM sv)"""
_UNIT_COLS = _GEO_COLS + [rd("latitude"), rd("longitude")]
_UNIT_OUT = _GEO_OUT + ["latitude", "longitude"]


@register("geo_unit", "WITH " + geo_sql("unit", unit=True) + _UNIT_STATUS + f"\nSELECT {', '.join(_UNIT_COLS)}, status FROM us")
def geo_unit(spark, sf):
    return out(_geo(spark, sf, "unit").summary, _UNIT_OUT + ["status"])


@register("geo_unit_plot_ready", "WITH " + geo_sql("unit", unit=True) + _UNIT_STATUS
          + f"\nSELECT {', '.join(_UNIT_COLS)} FROM us WHERE status = 'plotted'")
def geo_unit_plot_ready(spark, sf):
    return out(_geo(spark, sf, "unit").rows, _UNIT_OUT)


@register("geo_point_summary", "WITH " + geo_sql("unit", unit=True) + _UNIT_STATUS + """
SELECT COUNT(*) AS summary_count, COUNT(CASE WHEN status = 'plotted' THEN 1 END) AS plotted_count,
  COUNT(CASE WHEN status = 'missing_value' THEN 1 END) AS missing_value_count,
  COUNT(CASE WHEN status = 'missing_coordinate' THEN 1 END) AS missing_coordinate_count FROM us""")
def geo_point_summary(spark, sf):
    return _geo(spark, sf, "unit").point_summary


@register("geo_extent", "WITH " + geo_sql("unit", unit=True) + _UNIT_STATUS + """
SELECT round(MIN(latitude), 6) AS min_latitude, round(MAX(latitude), 6) AS max_latitude,
  round(MIN(longitude), 6) AS min_longitude, round(MAX(longitude), 6) AS max_longitude FROM us WHERE status = 'plotted'""")
def geo_extent(spark, sf):
    from kpiframe.operators.geo import extent

    return out(extent(_geo(spark, sf, "unit").rows), ["min_latitude", "max_latitude", "min_longitude", "max_longitude"])


@register("geo_totals", """WITH t AS (SELECT SUM(CASE WHEN w IS NOT NULL THEN r END) AS n, COALESCE(SUM(w), 0) AS d FROM (
  SELECT CASE WHEN bal IS NOT NULL AND wt IS NOT NULL THEN wt END AS w, bal AS r FROM """ + GEO_INPUT + """) x)
SELECT 0 AS response, 'bal' AS label, round(CAST(n / NULLIF(d, 0) AS DOUBLE), 6) AS value, round(CAST(n AS DOUBLE), 3) AS numerator,
  round(CAST(d AS DOUBLE), 3) AS denominator FROM t""")
def geo_totals(spark, sf):
    return out(_geo(spark, sf, "area").totals,
               ["response", "label", "value", "numerator", "denominator"])


# Boundary features: every nation, keyed by name; the summary lacks nations >= 20.
def _boundaries(spark, sf):
    n = table(spark, sf, "nation")
    geometry = F.concat(F.lit('{"type":"Point","coordinates":['), n.n_nationkey.cast("string"), F.lit(",0]}"))
    return n.select(F.col("n_name").alias("PostcodeArea"), geometry.alias("geometry"))


_THRESH = """vals AS (SELECT key, value, ROW_NUMBER() OVER (ORDER BY value, key) AS rk, COUNT(*) OVER () AS n FROM sv WHERE value IS NOT NULL),
th AS (SELECT r.range AS i, v.value AS threshold FROM range(1, {b}) r JOIN vals v
       ON v.rk = LEAST(v.n, CAST(CEIL(v.n * r.range / {b}.0) AS BIGINT)))"""


def _map(spark, sf, hotspots=0):
    from kpiframe.plans.geo import boundary_join as bj

    summary = _geo(spark, sf, "area", filter="c_nationkey < 20").rows
    return bj(summary, _boundaries(spark, sf), "PostcodeArea", hotspots=hotspots)


_MAP_BASE = "WITH " + geo_sql("area", "c_nationkey < 20") + ",\n" + _THRESH.format(b=100)


@register("geo_boundary_join", _MAP_BASE + """,
feats AS (SELECT n_name AS PostcodeArea FROM nation)
SELECT f.PostcodeArea, round(sv.value, 6) AS value, COALESCE(sv.value IS NOT NULL, FALSE) AS matched,
  CASE WHEN sv.value IS NOT NULL THEN (SELECT COUNT(*) FROM th WHERE th.threshold < sv.value) END AS bucket
FROM feats f LEFT JOIN sv ON f.PostcodeArea = sv.key""")
def geo_boundary_join(spark, sf):
    res = _map(spark, sf)
    return out(res.features.withColumn("bucket", F.col("bucket").cast("long")), ["PostcodeArea", "value", "matched", "bucket"])


@register("geo_match_stats", "WITH " + geo_sql("area", "c_nationkey < 20") + """,
feats AS (SELECT n_name AS PostcodeArea FROM nation),
j AS (SELECT f.PostcodeArea, sv.value FROM feats f LEFT JOIN sv ON f.PostcodeArea = sv.key)
SELECT COUNT(*) AS features, COUNT(value) AS matched, (SELECT COUNT(*) FROM sv) AS summary_rows,
  COUNT(value) = 0 AND (SELECT COUNT(*) FROM sv) > 0 AS no_match_warning,
  CASE WHEN COUNT(value) = 0 AND (SELECT COUNT(*) FROM sv) > 0 THEN 'No keys matched the GeoJSON PostcodeArea values.' END AS message FROM j""")
def geo_match_stats(spark, sf):
    return _map(spark, sf).stats


# Map scales over every unit: hundreds of keys, with ties (values rounded to tens).
_UNITS = "WITH " + geo_sql("unit") + """,
su AS (SELECT key, round(value / 10) * 10 AS value FROM sv)"""
_UNIT_THRESH = _THRESH.replace("FROM sv WHERE", "FROM su WHERE")


def _units(spark, sf):
    summary = _geo(spark, sf, "unit").summary
    return summary.select("key", F.expr(round_sql("(value / 10D)", 0) + " * 10D").alias("value"))


@register("geo_quantile_colour", _UNITS + ",\n" + _UNIT_THRESH.format(b=100) + """
SELECT key, round(value, 6) AS value, CASE WHEN value IS NOT NULL THEN (SELECT COUNT(*) FROM th WHERE th.threshold < su.value) END AS bucket FROM su""")
def geo_quantile_colour(spark, sf):
    from kpiframe.operators.geo import colour_buckets

    return out(colour_buckets(_units(spark, sf)).withColumn("bucket", F.col("bucket").cast("long")), ["key", "value", "bucket"])


@register("geo_legend_bins", _UNITS + ",\n" + _UNIT_THRESH.format(b=10) + """,
bins AS (SELECT range AS bin FROM range(0, 10)),
bnd AS (SELECT bin, (SELECT threshold FROM th WHERE i = bin) AS lower0, (SELECT threshold FROM th WHERE i = bin + 1) AS upper0 FROM bins),
cnt AS (SELECT CASE WHEN value IS NOT NULL THEN (SELECT COUNT(*) FROM th WHERE th.threshold < su.value) END AS bin, COUNT(*) AS keys FROM su GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, round(CASE WHEN b.bin > 0 THEN lower0 END, 6) AS lower,
  round(CASE WHEN b.bin < 9 THEN upper0 END, 6) AS upper, COALESCE(c.keys, 0) AS keys
FROM bnd b LEFT JOIN cnt c ON b.bin = c.bin
UNION ALL SELECT -1, NULL, NULL, keys FROM cnt WHERE bin IS NULL""")
def geo_legend_bins(spark, sf):
    from kpiframe.operators.geo import legend_bins

    return out(legend_bins(_units(spark, sf)), ["bin", "lower", "upper", "keys"])


@register("geo_hotspots", _UNITS + """
SELECT key, round(value, 6) AS value, ROW_NUMBER() OVER (ORDER BY value DESC, key DESC) AS rank
FROM su WHERE value IS NOT NULL ORDER BY value DESC, key DESC LIMIT 5""")
def geo_hotspots(spark, sf):
    from kpiframe.operators.geo import hotspots

    return out(hotspots(_units(spark, sf), 5), ["key", "value", "rank"])


@register("geo_coldspots", _UNITS + """
SELECT key, round(value, 6) AS value, ROW_NUMBER() OVER (ORDER BY value ASC, key ASC) AS rank
FROM su WHERE value IS NOT NULL ORDER BY value ASC, key ASC LIMIT 5""")
def geo_coldspots(spark, sf):
    from kpiframe.operators.geo import hotspots

    return out(hotspots(_units(spark, sf), -5), ["key", "value", "rank"])


# --- postcode search ----------------------------------------------------------------------

def _letters(k: str) -> tuple[str, str]:
    return f"chr(CAST(65 + {k} % 26 AS INTEGER))", f"chr(CAST(65 + ({k} // 26) % 26 AS INTEGER))"


def _postcode_text_sql(k: str) -> str:
    l1, l2 = _letters(k)
    d, e = f"CAST({k} % 97 AS VARCHAR)", f"CAST({k} % 10 AS VARCHAR)"
    return f"""CASE {k} % 8
  WHEN 0 THEN {l1} || {l2} || {d} || ' ' || {e} || 'AB'
  WHEN 1 THEN lower({l1} || {l2} || {d} || {e} || 'AB')
  WHEN 2 THEN {l1} || {l2} || {d}
  WHEN 3 THEN {l1} || {l2} || {d} || ' ' || {e}
  WHEN 4 THEN {l1} || {l2}
  WHEN 5 THEN {d} || {l1}
  WHEN 6 THEN '  ' || {l1} || {d} || {e} || '  '
  ELSE {l1} || {l2} || '-' || {d} || '/' || {e} || 'XY' END"""


def _pc_parts(col: str) -> tuple[Column, Column, Column, Column]:
    k = F.col(col)
    l1 = F.char(F.lit(65) + k % 26)
    l2 = F.char(F.lit(65) + (k / 26).cast("long") % 26)
    return l1, l2, (k % 97).cast("string"), (k % 10).cast("string")


def _pc_text_spark(col: str) -> Column:
    """Synthetic postcode texts in eight shapes (same rule as ``_postcode_text_sql``)."""
    l1, l2, d, e = _pc_parts(col)
    m = F.col(col) % 8
    return (
        F.when(m == 0, F.concat(l1, l2, d, F.lit(" "), e, F.lit("AB")))
        .when(m == 1, F.lower(F.concat(l1, l2, d, e, F.lit("AB"))))
        .when(m == 2, F.concat(l1, l2, d))
        .when(m == 3, F.concat(l1, l2, d, F.lit(" "), e))
        .when(m == 4, F.concat(l1, l2))
        .when(m == 5, F.concat(d, l1))
        .when(m == 6, F.concat(F.lit("  "), l1, d, e, F.lit("  ")))
        .otherwise(F.concat(l1, l2, F.lit("-"), d, F.lit("/"), e, F.lit("XY")))
    )


_PARSE_SQL = """pv AS (SELECT *, upper(regexp_replace(txt, '^\\s+|\\s+$', '', 'g')) AS v FROM t),
pc AS (SELECT *, regexp_replace(v, '[^A-Z0-9]', '', 'g') AS c,
  string_split_regex(trim(regexp_replace(v, '[^A-Z0-9 ]', ' ', 'g')), ' +') AS parts FROM pv),
pa AS (SELECT *, regexp_extract(c, '^[A-Z]{1,2}', 0) AS area, length(c) AS n FROM pc),
ps AS (SELECT *, CASE
    WHEN len(parts) >= 2 AND regexp_matches(parts[1], '[0-9]') AND regexp_matches(parts[2], '^[0-9]') THEN parts[1] || ' ' || substr(parts[2], 1, 1)
    WHEN n >= 5 AND regexp_matches(c, '[0-9][A-Z]{2}$') THEN substr(c, 1, n - 3) || ' ' || substr(c, n - 2, 1)
    WHEN regexp_matches(c, '[0-9]$') AND regexp_matches(substr(c, 1, n - 1), '[0-9]') THEN substr(c, 1, n - 1) || ' ' || substr(c, n, 1)
  END AS sector FROM pa),
parsed AS (SELECT *,
  CASE WHEN c = '' OR area = '' THEN NULL WHEN regexp_matches(c, '^[A-Z]{1,2}$') THEN 'area' WHEN sector IS NOT NULL THEN 'sector' ELSE 'area' END AS level,
  CASE WHEN c = '' OR area = '' THEN NULL WHEN regexp_matches(c, '^[A-Z]{1,2}$') THEN area ELSE COALESCE(sector, area) END AS pkey FROM ps)"""


@register("postcode_keys", "WITH t AS (SELECT s_suppkey, " + _postcode_text_sql("s_suppkey") + " AS txt FROM supplier),\n"
          + _PARSE_SQL + "\nSELECT s_suppkey, txt, level, pkey AS key FROM parsed")
def postcode_keys(spark, sf):
    from kpiframe.functions.postcode import parse_postcode

    s = table(spark, sf, "supplier").select("s_suppkey", _pc_text_spark("s_suppkey").alias("txt"))
    p = s.withColumn("p", parse_postcode(F.col("txt")))
    return p.select("s_suppkey", "txt", F.col("p.level").alias("level"), F.col("p.key").alias("key"))


def _customer_boundaries_sql() -> str:
    l1, l2 = _letters("c_custkey")
    return (f"SELECT 'sector' AS level, {l1} || {l2} || CAST(c_custkey % 97 AS VARCHAR) || ' ' || CAST(c_custkey % 10 AS VARCHAR) AS key FROM customer "
            f"UNION SELECT 'area', {l1} || {l2} FROM customer WHERE c_mktsegment = 'BUILDING'")


@register("postcode_lookup", "WITH t AS (SELECT s_suppkey, " + _postcode_text_sql("s_suppkey") + " AS txt FROM supplier),\n"
          + _PARSE_SQL + ",\nb AS (" + _customer_boundaries_sql() + ")\n"
          "SELECT s_suppkey, level AS search_level, pkey AS search_key, "
          "EXISTS (SELECT 1 FROM b WHERE b.level = parsed.level AND b.key = parsed.pkey) AS found FROM parsed")
def postcode_lookup(spark, sf):
    from kpiframe.functions.postcode import postcode_lookup as lookup

    s = table(spark, sf, "supplier").select("s_suppkey", _pc_text_spark("s_suppkey").alias("txt"))
    c = table(spark, sf, "customer")
    l1, l2, d, e = _pc_parts("c_custkey")
    sectors = c.select(F.lit("sector").alias("level"), F.concat(l1, l2, d, F.lit(" "), e).alias("key"))
    areas = c.where(F.col("c_mktsegment") == "BUILDING").select(F.lit("area").alias("level"), F.concat(l1, l2).alias("key"))
    b = sectors.unionByName(areas)
    return lookup(s, "txt", b).select("s_suppkey", "search_level", "search_key", "found")


# --- profile -------------------------------------------------------------------------------

_KIND_SQL = """CASE WHEN upper(data_type) LIKE '%INT%' THEN 'integer'
  WHEN upper(data_type) IN ('DOUBLE', 'FLOAT', 'REAL') OR upper(data_type) LIKE 'DECIMAL%' THEN 'numeric'
  WHEN upper(data_type) LIKE '%TIMESTAMP%' THEN 'datetime'
  WHEN upper(data_type) LIKE '%DATE%' OR upper(data_type) LIKE '%TIME%' THEN 'date'
  ELSE 'categorical' END"""


def _profile_of(spark, sf, name):
    from kpiframe.operators.profile import profile

    return profile(table(spark, sf, name))


@register("profile_kinds", "SELECT column_name AS name, CAST(ordinal_position AS INTEGER) AS position, " + _KIND_SQL
          + " AS kind, (SELECT COUNT(*) FROM lineitem) AS row_count FROM information_schema.columns WHERE table_name = 'lineitem'")
def profile_kinds(spark, sf):
    return _profile_of(spark, sf, "lineitem").select("name", "position", "kind", "row_count")


@register("profile_integer_range", " UNION ALL ".join(
    f"SELECT '{c}' AS name, CAST(MIN({c}) AS BIGINT) AS min_value, CAST(MAX({c}) AS BIGINT) AS max_value FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
def profile_integer_range(spark, sf):
    return _profile_of(spark, sf, "lineitem").where(F.col("kind") == "integer").select("name", "min_value", "max_value")


def _ladder_sql() -> str:
    return "(SELECT m * pow(10, e) AS rung FROM (VALUES (1), (2), (5)) mm(m), (SELECT range AS e FROM range(-8, 13)) ee)"


_SUGGEST = """SELECT name, CASE WHEN is_int AND hi - lo < 120 THEN 1.0 ELSE (
    SELECT CASE WHEN COUNT(*) <= 1 THEN MIN(rung) ELSE MAX(rung) FILTER (WHERE rung < (SELECT MAX(rung) FROM {ladder} l2 WHERE l2.rung <= sd)) END
    FROM {ladder} l WHERE l.rung <= sd) END AS band_suggestion
FROM ({stats}) st"""


@register("profile_band_suggestion", "SELECT name, CASE WHEN sd IS NULL OR sd <= 0 OR NOT isfinite(sd) THEN NULL ELSE band_suggestion END AS band_suggestion FROM ("
          + _SUGGEST.format(ladder=_ladder_sql(), stats=" UNION ALL ".join([
              "SELECT 'p_partkey' AS name, TRUE AS is_int, MIN(p_partkey) AS lo, MAX(p_partkey) AS hi, STDDEV_SAMP(p_partkey) AS sd FROM part",
              "SELECT 'p_size', TRUE, MIN(p_size), MAX(p_size), STDDEV_SAMP(p_size) FROM part",
              "SELECT 'p_retailprice', FALSE, NULL, NULL, STDDEV_SAMP(p_retailprice) FROM part",
          ])).replace("SELECT name, CASE WHEN is_int", "SELECT name, sd, CASE WHEN is_int") + ") x")
def profile_band_suggestion(spark, sf):
    return _profile_of(spark, sf, "part").where(F.col("kind").isin("integer", "numeric")).select("name", "band_suggestion")


# --- more key kinds: DATE columns, fractional bands on integers, booleans, joined inputs ---------

def orders_dates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", "o_totalprice",
        F.when(o.o_orderkey % 9 == 0, F.lit(None)).otherwise(o.o_orderdate.cast("date")).alias("odate"),
        (o.o_totalprice > 150000).alias("big"),
    )


ORDERS_DATES = """(SELECT o_orderkey, o_totalprice,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS odate,
  o_totalprice > 150000 AS big FROM orders) src"""


@register(
    "chart_date_raw",
    O.chart_sql(ORDERS_DATES, "odate", "CASE WHEN odate IS NULL THEN '(missing)' ELSE CAST(odate AS VARCHAR) END", "odate",
                ["o_totalprice"], None, ORDERED, ["x", "position", rd("volume"), rd("resp0")]),
)
def chart_date_raw(spark, sf):
    res = chart(orders_dates(spark, sf), "odate", "o_totalprice")
    return out(res.rows, ["x", "position", "volume", "resp0"])


_DM = "CAST(DATE_TRUNC('month', odate) AS TIMESTAMP)"


@register(
    "chart_date_month",
    O.chart_sql(ORDERS_DATES, _DM, f"CASE WHEN {_DM} IS NULL THEN '(missing)' ELSE CAST({_DM} AS VARCHAR) END", _DM,
                ["o_totalprice"], None, ORDERED, ["x", "position", rd("volume"), rd("resp0")]),
)
def chart_date_month(spark, sf):
    res = chart(orders_dates(spark, sf), "odate", "o_totalprice", bucket="month")
    return out(res.rows, ["x", "position", "volume", "resp0"])


_BOOL = O.category_key("big")


@register(
    "chart_boolean_category",
    O.chart_sql(ORDERS_DATES, _BOOL, _BOOL, _BOOL, ["o_totalprice"], None, ALPHA, ["x", "position", rd("volume"), rd("resp0")]),
)
def chart_boolean_category(spark, sf):
    res = chart(orders_dates(spark, sf), "big", "o_totalprice")
    return out(res.rows, ["x", "position", "volume", "resp0"])


_FB = "FLOOR(TRY_CAST(p_size AS DOUBLE) / 2.5) * 2.5"


@register(
    "chart_fractional_band_integer",
    O.chart_sql("part", _FB, O.integer_label(_FB), _FB, ["p_retailprice"], None, ORDERED,
                ["x", "position", rd("volume"), rd("resp0")]),
)
def chart_fractional_band_integer(spark, sf):
    # keys 2.5, 7.5, 12.5 ... label as BIGINT rounded half to even: "2", "8", "12", ...
    res = chart(table(spark, sf, "part"), "p_size", "p_retailprice", band=2.5)
    return out(res.rows, ["x", "position", "volume", "resp0"])


def documents_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left")


DOCS_LABELS = """(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) src"""
_LANG = O.category_key("lang")


@register(
    "chart_label_rates_logit",
    O.chart_sql(DOCS_LABELS, _LANG, _LANG, _LANG, ["quality", "toxic"], None, ALPHA,
                ["x", "position", rd("volume"),
                 "round(CASE WHEN resp0 > 0 AND resp0 < 1 THEN ln(resp0 / (1 - resp0)) END, 6) AS resp0",
                 "round(CASE WHEN resp1 > 0 AND resp1 < 1 THEN ln(resp1 / (1 - resp1)) END, 6) AS resp1"]),
)
def chart_label_rates_logit(spark, sf):
    # Documents without labels have missing responses and drop out of the weight.
    res = chart(documents_labels(spark, sf), "lang", "quality", "toxic", transform="logit")
    return out(res.rows, ["x", "position", "volume", "resp0", "resp1"])


@register(
    "chart_label_missing_quality",
    """SELECT CAST(COUNT(*) AS BIGINT) AS filtered_row_count,
  CAST(SUM(CASE WHEN quality IS NULL OR toxic IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_response_rows,
  round(CAST(COALESCE(SUM(CASE WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 1.0 END), 0) AS DOUBLE), 6) AS value
FROM """ + DOCS_LABELS,
)
def chart_label_missing_quality(spark, sf):
    res = chart(documents_labels(spark, sf), "source", "quality", "toxic")
    return out(res.quality, ["filtered_row_count", "missing_response_rows", "value"])


_NCH = "FLOOR(TRY_CAST(n_chars AS DOUBLE) / 5000.0) * 5000.0"


@register(
    "chart_text_length_band_tails",
    O.chart_sql(DOCS_LABELS, _NCH, O.integer_label(_NCH), _NCH, ["quality"], None, ORDERED,
                ["x", "position", "is_tail", rd("volume"), rd("resp0")],
                tails=("ordered", "(SELECT SUM(volume) FROM g) * 10 / 100")),
)
def chart_text_length_band_tails(spark, sf):
    res = chart(documents_labels(spark, sf), "n_chars", "quality", band=5000, low_weight="10%")
    return out(res.rows, ["x", "position", "is_tail", "volume", "resp0"])


@register(
    "chart_quantile_windows",
    O.chart_sql(_quantile_source("lineitem", "l_extendedprice", "l_orderkey, l_linenumber, l_discount, l_quantity", 20), "tile", _QLABEL, _QSORT,
                ["l_extendedprice", "l_discount"], "l_quantity", ORDERED,
                ["x", "position", rd("volume"), rd("resp0"), rd("resp1")]),
)
def chart_quantile_windows(spark, sf):
    # High-cardinality x: nearly every tile boundary is inside a narrow window of values.
    res = chart(table(spark, sf, "lineitem"), "l_extendedprice", "l_extendedprice", "l_discount", weight="l_quantity",
                quantiles=20, tie_by=["l_orderkey", "l_linenumber", "l_discount", "l_quantity"])
    return out(res.rows, ["x", "position", "volume", "resp0", "resp1"])


# --- completeness: every group, truncation, exact tails, NaN, many tiles, default ties -----------

_OK = "TRY_CAST(l_orderkey AS DOUBLE)"


@register(
    "chart_all_groups",
    O.chart_sql("lineitem", _OK, O.integer_label(_OK), _OK, ["l_extendedprice"], None, ORDERED,
                ["x", "position", rd("volume"), rd("resp0"), "FALSE AS truncated"]),
)
def chart_all_groups(spark, sf):
    res = chart(table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice", max_groups=0)
    return out(res.rows, ["x", "position", "volume", "resp0", "truncated"])


@register(
    "chart_truncated_flag",
    "SELECT max(position) AS shown, bool_and(truncated) AS truncated FROM ("
    + O.chart_sql("lineitem", _OK, O.integer_label(_OK), _OK, ["l_extendedprice"], None, ORDERED,
                  ["position", "COUNT(*) OVER () > 500 AS truncated"]) + ") t WHERE position <= 500",
)
def chart_truncated_flag(spark, sf):
    res = chart(table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice", max_groups=500)
    return res.rows.agg(F.max("position").alias("shown"), F.bool_and("truncated").alias("truncated"))


# Weights with fractions, one group of about all the weight, and a threshold that one running sum meets exactly.
_FRACTIONAL = """(SELECT p_size, p_retailprice,
  CASE WHEN p_size = 25 THEN 9007199254740992.0 ELSE 0.25 * (p_size % 8) END AS wt FROM part) src"""


def fractional_weights(spark, sf):
    p = table(spark, sf, "part")
    wt = F.when(p.p_size == 25, F.lit(9007199254740992.0)).otherwise(F.lit(0.25) * (p.p_size % 8))
    return p.select("p_size", "p_retailprice", wt.alias("wt"))


_PS = "TRY_CAST(p_size AS DOUBLE)"


@register(
    "tails_fractional_weight",
    O.chart_sql(_FRACTIONAL, _PS, O.integer_label(_PS), _PS, ["p_retailprice"], "wt", ORDERED, _TAIL_COLS,
                tails=("ordered", "(SELECT SUM(wt) FROM " + _FRACTIONAL + " WHERE p_size <= 9)")),
)
def tails_fractional_weight(spark, sf):
    df = fractional_weights(spark, sf)
    exact = df.where("p_size <= 9").agg(F.sum("wt")).first()[0]
    res = chart(df, "p_size", "p_retailprice", weight="wt", low_weight=str(exact))
    return out(res.rows, _TAIL_OUT)


_NAN_SRC = """(SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 'nan'::DOUBLE
  WHEN o_orderkey % 50 = 1 THEN 'infinity'::DOUBLE WHEN o_orderkey % 50 = 2 THEN '-infinity'::DOUBLE
  WHEN o_orderkey % 10 = 4 THEN -0.0 WHEN o_orderkey % 10 = 5 THEN 0.0 ELSE o_totalprice - 100000 END AS v FROM orders)"""


def odd_values(spark, sf):
    o = table(spark, sf, "orders")
    k = o.o_orderkey
    v = (
        F.when(k % 3 == 0, F.lit(float("nan"))).when(k % 50 == 1, F.lit(float("inf"))).when(k % 50 == 2, F.lit(float("-inf")))
        .when(k % 10 == 4, F.lit(-0.0)).when(k % 10 == 5, F.lit(0.0)).otherwise(o.o_totalprice - 100000)
    )
    return o.select("o_orderkey", "o_totalprice", v.alias("v"))


@register(
    "chart_quantile_nan",
    O.chart_sql(_quantile_source(_NAN_SRC, "v", "o_orderkey", 12), "tile", _QLABEL, _QSORT, ["o_totalprice"], None, ORDERED,
                ["x", "position", rd("volume"), rd("resp0")]),
)
def chart_quantile_nan(spark, sf):
    res = chart(odd_values(spark, sf), "v", "o_totalprice", quantiles=12, tie_by=["o_orderkey"])
    return out(res.rows, ["x", "position", "volume", "resp0"])


@register(
    "chart_quantile_1000",
    O.chart_sql(_quantile_source("lineitem", "l_extendedprice", "l_orderkey, l_linenumber, l_discount, l_quantity", 1000), "tile",
                _QLABEL, _QSORT, ["l_extendedprice"], "l_quantity", ORDERED, ["x", "position", rd("volume"), rd("num0").replace(" AS num0", " AS resp0_num")]),
)
def chart_quantile_1000(spark, sf):
    res = chart(table(spark, sf, "lineitem"), "l_extendedprice", "l_extendedprice", weight="l_quantity", quantiles=1000,
                tie_by=["l_orderkey", "l_linenumber", "l_discount", "l_quantity"])
    return out(res.rows, ["x", "position", "volume", "resp0_num"])


@register(
    "chart_quantile_default_ties",
    O.chart_sql(_quantile_source("lineitem", "l_linenumber", "l_extendedprice, l_quantity", 9), "tile", _QLABEL, _QSORT,
                ["l_extendedprice"], "l_quantity", ORDERED, ["x", "position", rd("volume"), rd("resp0")]),
)
def chart_quantile_default_ties(spark, sf):
    res = chart(table(spark, sf, "lineitem"), "l_linenumber", "l_extendedprice", weight="l_quantity", quantiles=9)
    return out(res.rows, ["x", "position", "volume", "resp0"])


_TINY = "(SELECT l_extendedprice / 1e9 * (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) AS tiny, l_quantity FROM lineitem) src"


@register(
    "chart_small_numeric_labels",
    O.chart_sql(_TINY, "TRY_CAST(tiny AS DOUBLE)", O.numeric_label("TRY_CAST(tiny AS DOUBLE)"), "TRY_CAST(tiny AS DOUBLE)",
                ["l_quantity"], None, ORDERED, ["x", "position", rd("volume"), rd("resp0")]),
)
def chart_small_numeric_labels(spark, sf):
    sign = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    df = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1e9 * sign).alias("tiny"), "l_quantity")
    return out(chart(df, "tiny", "l_quantity").rows, ["x", "position", "volume", "resp0"])


_NULL_FOLD = "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END"


@register(
    "sigma_null_fold_keys",
    O.chart_sql(ORDERS_NULLS, O.category_key("priority"), O.category_key("priority"), O.category_key("priority"),
                ["o_totalprice", "expected"], None, ALPHA, _SIG_COLS, fold_key=f"COALESCE(CAST({_NULL_FOLD} AS VARCHAR), chr(0))"),
)
def sigma_null_fold_keys(spark, sf):
    df = orders_nulls(spark, sf).withColumn("fk", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey")))
    res = chart(df, "priority", "o_totalprice", "expected", sigma=2, fold_by=["fk"])
    return out(res.rows, ["x", "position", "is_tail", "volume", "resp0", "resp1", "sigma_se", "valid_folds"])


# --- responses as JSON text, empty results -------------------------------------------------------


def _json_number(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR NOT isfinite({c}) THEN 'null' WHEN {c} = round({c}) AND abs({c}) < 9007199254740992 "
            f"THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END")


@register(
    "chart_rows_json",
    "SELECT position, '{\"x\":\"' || x || '\",\"volume\":' || " + _json_number("volume")
    + " || ',\"is_tail\":false,\"valid_folds\":null,\"resp0\":' || " + _json_number("resp0") + " || '}' AS json FROM ("
    + O.chart_sql("(SELECT * FROM part) src", _BRAND, _BRAND, _BRAND, ["p_size"], None, ALPHA, ["x", "position", "volume", "resp0"])
    + ") t",
)
def chart_rows_json(spark, sf):
    return chart(table(spark, sf, "part"), "p_brand", "p_size").rows_json()


# Quarters sum exactly in any order, so the texts agree to the last digit.
@register(
    "geo_rows_json",
    """WITH s AS (SELECT n_name AS k, COUNT(*) AS n, CAST(SUM(c_custkey % 8 * 0.25) AS DOUBLE) AS v, CAST(COUNT(*) AS DOUBLE) AS d
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT k AS key, '{"key":"' || k || '","row_count":' || n || ',"numerator":' || """ + _json_number("v")
    + """ || ',"denominator":' || """ + _json_number("d") + """ || ',"volume":' || """ + _json_number("d")
    + """ || ',"value":' || """ + _json_number("(v / d)") + """ || '}' AS json FROM s""",
)
def geo_rows_json(spark, sf):
    from kpiframe.plans.geo import geo_summary

    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    df = c.join(n, c.c_nationkey == n.n_nationkey).select("n_name", (F.col("c_custkey") % 8 * 0.25).alias("quarters"))
    return geo_summary(df, "area", "quarters", key_col="n_name").rows_json()


@register(
    "geo_empty_warning",
    "SELECT 5 AS position, 'empty' AS code, 0 AS count, 'No plot-ready unit points were found after filtering.' AS message "
    "FROM (SELECT COUNT(*) AS n FROM customer) WHERE n > 0",
)
def geo_empty_warning(spark, sf):
    from kpiframe.plans.geo import geo_summary

    # No row has a latitude that a map can show, and none lacks a value or a weight.
    df = geo_input(spark, sf).select("unit", F.lit(120.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(1.0).alias("one"))
    return geo_summary(df, "unit", "one", key_col="unit", lat_col="lat", lon_col="lon").warnings


# --- other given tables: events, conversations, pages (whole texts) --------------------------

_ET = O.category_key("event_type")


@register(
    "sigma_events",
    O.chart_sql("(SELECT *, value * 0.8 + (event_id % 5) AS baseline FROM events) src", _ET, _ET, _ET,
                ["value", "baseline"], None, ALPHA,
                _SIG_COLS + [b.format(k="2.0") for b in _BOUNDS], fold_key="event_id"),
)
def sigma_events(spark, sf):
    ev = table(spark, sf, "events").withColumn("baseline", F.col("value") * 0.8 + (F.col("event_id") % 5))
    res = chart(ev, "event_type", "value", "baseline", sigma=2, fold_by=["event_id"])
    return out(res.rows, ["x", "position", "is_tail", "volume", "resp0", "resp1", "sigma_se", "valid_folds",
                          "resp1_low", "resp1_high"])


_ROLE = O.category_key("role")


@register(
    "chart_conversation_text_length",
    O.chart_sql("(SELECT *, CAST(length(text) AS BIGINT) AS text_chars FROM conversations) src", _ROLE, _ROLE, _ROLE,
                ["text_chars", "turn"], None, "volume DESC, lower(x), x",
                ["x", "position", rd("volume"),
                 f"round({_TRANSFORM_SQL['one']('resp0', 0)}, 6) AS resp0",
                 f"round({_TRANSFORM_SQL['one']('resp1', 1)}, 6) AS resp1"]),
)
def chart_conversation_text_length(spark, sf):
    # Whole-text character counts per role, relative to the displayed average ("one").
    conv = table(spark, sf, "conversations").withColumn("text_chars", F.length("text").cast("long"))
    res = chart(conv, "role", "text_chars", "turn", sort="volume", transform="one")
    return out(res.rows, ["x", "position", "volume", "resp0", "resp1"])


@register(
    "chart_page_length_quantiles",
    O.chart_sql(_quantile_source("(SELECT *, CAST(length(html) AS BIGINT) AS html_chars FROM pages) p0", "html_chars", "page_id", 5),
                "tile", _QLABEL, _QSORT, ["html_chars"], None, ORDERED, ["x", "position", rd("volume"), rd("resp0")]),
)
def chart_page_length_quantiles(spark, sf):
    pages = table(spark, sf, "pages").withColumn("html_chars", F.length("html").cast("long"))
    res = chart(pages, "html_chars", "html_chars", quantiles=5, tie_by=["page_id"])
    return out(res.rows, ["x", "position", "volume", "resp0"])


# --- file order, pages -------------------------------------------------------------------

_ROW_ORDERS = "(SELECT *, row_number() OVER () AS rn, o_totalprice * 0.9 + (o_orderkey % 13) * 100.0 AS expected FROM orders) src"
_PRIORITY = O.category_key("o_orderpriority")


@register(
    "sigma_default_folds",
    O.chart_sql(_ROW_ORDERS, _PRIORITY, _PRIORITY, _PRIORITY, ["o_totalprice", "expected"], None, ALPHA,
                _SIG_COLS + [b.format(k="2.0") for b in _BOUNDS], where="o_totalprice > 50000", fold_key="rn"),
)
def sigma_default_folds(spark, sf):
    orders = table(spark, sf, "orders").withColumn("expected", F.col("o_totalprice") * 0.9 + (F.col("o_orderkey") % 13) * 100.0)
    res = chart(orders, "o_orderpriority", "o_totalprice", "expected", filter="o_totalprice > 50000", sigma=2)
    return out(res.rows, ["x", "position", "is_tail", "volume", "resp0", "resp1", "sigma_se", "valid_folds",
                          "resp1_low", "resp1_high"])


@register(
    "chart_first_seen",
    "SELECT CAST(CAST(l_partkey AS BIGINT) AS VARCHAR) AS x, CAST(MIN(rn) AS BIGINT) AS first_seen, CAST(COUNT(*) AS DOUBLE) AS volume "
    "FROM (SELECT l_partkey, l_discount, row_number() OVER () AS rn FROM lineitem) src WHERE l_discount >= 0.02 GROUP BY l_partkey",
)
def chart_first_seen(spark, sf):
    res = chart(table(spark, sf, "lineitem"), "l_partkey", "l_extendedprice", filter="l_discount >= 0.02", first_seen=True)
    return out(res.rows, ["x", "first_seen", "volume"])


@register(
    "chart_quantile_row_order",
    O.chart_sql(_quantile_source("(SELECT *, row_number() OVER () AS rn FROM lineitem) numbered", "l_linenumber", "rn", 9),
                "tile", _QLABEL, _QSORT, ["l_extendedprice"], "l_quantity", ORDERED, ["x", "position", rd("volume"), rd("resp0")]),
)
def chart_quantile_row_order(spark, sf):
    # Seven values in nine tiles: rows of one value fall into tiles by their place in the file.
    res = chart(table(spark, sf, "lineitem"), "l_linenumber", "l_extendedprice", weight="l_quantity", quantiles=9, tie_by=ROW_ORDER)
    return out(res.rows, ["x", "position", "volume", "resp0"])


@register(
    "table_page_from_files",
    "SELECT x, position, volume, page, pages FROM (SELECT *, LEAST(4, pages) AS page FROM ("
    "SELECT x, position, volume, CAST(GREATEST(1, CEIL(COUNT(*) OVER () / 100.0)) AS BIGINT) AS pages FROM ("
    + O.chart_sql("lineitem", _PK, O.integer_label(_PK), _PK, ["l_extendedprice"], None, ORDERED, ["x", "position", rd("volume")])
    + ") every_group) counted) p WHERE position > (page - 1) * 100 AND position <= page * 100",
)
def table_page_from_files(spark, sf):
    res = chart(table(spark, sf, "lineitem"), "l_partkey", "l_extendedprice")
    pages = PagedRows(res.rows.select("x", "position", "volume"), file_rows=1000)
    return out(pages.page(4, page_size=100), ["x", "position", "volume", "page", "pages"])
