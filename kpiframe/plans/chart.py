"""``chart``: weighted-average KPIs and their weight volume by one feature (TOP-1).

Plan, per request:

1. filter (pushed into the scan) and project only the columns in use;
2. row-level key + measure columns, all built-in expressions;
3. ONE hash aggregation of the big table to (group[, fold]) partial sums —
   map-side partial aggregation, so the shuffle carries at most
   groups × folds rows per task;
4. everything else (totals, weight quality, tails, sort, cap, transforms,
   sigma) runs on the checkpointed group rows.

Quantile mode aggregates by exact NTILE tiles without a global window
(:mod:`kpiframe.operators.tiles`).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Any, Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiframe.functions import kinds
from kpiframe.functions.labels import QUANTILE_MISSING_SORT
from kpiframe.functions.arguments import MOST_TILES, Argument
from kpiframe.functions.numbers import col_of, finite_or_null, quote, safe_ratio, try_double
from kpiframe.functions.transforms import transform_sql
from kpiframe.operators import measures as M
from kpiframe.operators.filters import apply_filter
from kpiframe.operators.grouping import assign_display
from kpiframe.operators.keys import quantile_key, x_key
from kpiframe.operators.ordering import cap_groups, sort_columns
from kpiframe.operators.positions import file_place, with_row_number
from kpiframe.operators.sigma import fold_column, fold_sigma
from kpiframe.operators.tiles import tiled_parts
from kpiframe.session import is_single, materialize
from kpiframe.sources.footers import footer_statistics
from kpiframe.sources.table import Table

#: The cap that requests in the original tool's shape get when they name none (fixed value).
REQUEST_MAX_GROUPS = 10_000
TRUNCATED_POSITION = 6
#: ``tie_by`` for the order of rows in the input's files.
ROW_ORDER = "row order"


@dataclass
class ChartResult:
    """Result DataFrames of one chart request, built on first access.

    ``groups``: one row per group before tails; ``rows``: display rows. ``totals``, ``quality`` and ``warnings`` re-sum
    the groups. All of them read one table of partial sums in the checkpoint folder, written by whichever is asked for
    first, so the input is scanned once in any order.
    """

    x: str
    x_kind: str
    group_kind: str
    responses: list[M.Response]
    weight: M.Weight
    max_groups: int
    #: The rows that the scan projects, for ``explain()``.
    scanned: DataFrame = field(repr=False)
    _parts_of: Callable[[], DataFrame] = field(repr=False)
    _group: Callable[[DataFrame], DataFrame] = field(repr=False)
    _present: Callable[[DataFrame, DataFrame], tuple] = field(repr=False)
    _source: DataFrame | Table = field(repr=False)
    _filter: str | None = field(default=None, repr=False)

    @cached_property
    def parts(self) -> DataFrame:
        """Partial sums per group (and fold): the one result of the scan."""
        return self._parts_of()

    @cached_property
    def groups(self) -> DataFrame:
        return self._group(self.parts)

    @cached_property
    def _shown(self) -> tuple[DataFrame, DataFrame | None]:
        return self._present(self.groups, self.parts)

    @property
    def rows(self) -> DataFrame:
        return self._shown[0]

    @property
    def _sums(self) -> DataFrame:
        return self.groups.withColumn("volume_sum", F.col("volume"))

    @cached_property
    def _row_count(self) -> int:
        if isinstance(self._source, Table):
            return self._source.row_count()
        footers = footer_statistics(self._source, [])
        return footers.rows if footers else self._source.count()

    def row_count(self) -> int:
        """Rows of the whole table (SCH-3): kept by a ``Table``, else from the footers, else a count that reads no column."""
        return self._row_count

    @cached_property
    def counts(self) -> DataFrame:
        """``row_count`` (whole table) and ``filtered_row_count`` (SCH-3, SCH-4)."""
        filtered = self.quality.select(F.coalesce("filtered_row_count", F.lit(0)).alias("filtered_row_count"))
        return filtered.withColumn("row_count", F.lit(self.row_count())).select("row_count", "filtered_row_count")

    @cached_property
    def totals(self) -> DataFrame:
        return M.totals(self._sums, self.responses)

    @cached_property
    def quality(self) -> DataFrame:
        return M.weight_quality(self._sums)

    @cached_property
    def warnings(self) -> DataFrame:
        """Weight quality, values outside a transform's domain, and a cap that dropped groups."""
        found = M.weight_warnings(self.quality, self.weight)
        rows, invalid = self._shown
        if invalid is not None:
            found = found.unionByName(invalid)
        if self.max_groups:
            message = f"Only the first {self.max_groups} groups are shown."
            cut = rows.where("truncated").limit(1).selectExpr(
                f"{TRUNCATED_POSITION} AS position", "'truncated' AS code", f"{self.max_groups}L AS count", f"'{message}' AS message"
            )
            found = found.unionByName(cut)
        return found

    def rows_json(self) -> DataFrame:
        """position and json: the display rows as JSON text."""
        from kpiframe.plans.payload import chart_rows_json

        return chart_rows_json(self)

    def payload(self) -> dict:
        """The original tool's response dict; needs a ``max_groups`` cap, because it collects the rows."""
        from kpiframe.plans.payload import chart_payload

        return chart_payload(self, self._filter or "")


def _responses(df: DataFrame, actual: Any, expected: Any, responses: Any) -> list[M.Response]:
    if responses is not None:
        return M.resolve_responses(df, responses)
    items = []
    if actual:
        items.append(("Actual", actual) if not isinstance(actual, (tuple, list, dict)) else actual)
    if expected:
        items.append(("Expected", expected) if not isinstance(expected, (tuple, list, dict)) else expected)
    return M.resolve_responses(df, items)


def _tile_count(quantiles: Any) -> int | None:
    """None/False/"" -> no quantile mode; True -> 10 tiles; else the count, an error beyond the most."""
    if quantiles is None or quantiles is False or quantiles == "":
        return None
    n = 10 if quantiles is True else Argument(quantiles).tiles()
    if n > MOST_TILES:
        raise ValueError(f"Choose at most {MOST_TILES} quantiles")
    return n


def chart(
    df: DataFrame | Table,
    x: str,
    actual: Any = None,
    expected: Any = None,
    *,
    responses: Any = None,
    weight: str | None = None,
    filter: str | None = None,
    band: Any = None,
    quantiles: Any = None,
    bucket: str | None = None,
    low_weight: Any = "0",
    sort: str = "alpha",
    sigma: float = 0,
    transform: str = "none",
    max_groups: int | None = None,
    tie_by: Sequence[str] | None = None,
    fold_by: Sequence[str] | None = None,
    first_seen: bool = False,
) -> ChartResult:
    """Chart rows for feature ``x``.

    ``actual`` / ``expected`` are numeric column names (or ``(label, column)``);
    ``weight`` a numeric column (None = average row value); ``band`` a fixed
    width; ``quantiles`` a tile count (numeric x); ``bucket`` one of
    hour/day/week/month/year (date x); ``low_weight`` a tail threshold
    (absolute or ``"p%"``); ``sigma`` the bound multiplier; ``max_groups`` a cap
    (None or 0: every group; rows carry ``truncated``); ``fold_by`` key columns for
    sigma folds (default: the row's number in file order); ``tie_by`` columns that order rows with equal x in quantile
    mode, or :data:`ROW_ORDER` for the order in the files (default: the response, weight and fold columns, so rows
    still tied are interchangeable in every output); ``first_seen`` adds the number of a group's first row in the files.
    """
    source = df
    df = df.df if isinstance(df, Table) else df
    if x not in df.columns:
        raise ValueError("Choose a valid x-axis feature")
    x_kind = kinds.column_kinds(df)[x]
    if isinstance(band, str) and band.strip().lower() == "auto":
        from kpiframe.operators.profile import suggest_band

        band = suggest_band(df, x)
    resp = _responses(df, actual, expected, responses)
    wt = M.resolve_weight(df, weight)
    base = apply_filter(df, filter)
    n_resp = len(resp)
    include_sigma = float(sigma or 0) > 0 and n_resp >= 2
    n_tiles = _tile_count(quantiles)
    tiled = bool(n_tiles) and kinds.is_numeric_kind(x_kind)
    in_row_order = tiled and isinstance(tie_by, str) and tie_by == ROW_ORDER
    row = None
    if first_seen or in_row_order or (include_sigma and not fold_by):
        numbered = with_row_number(base)
        if numbered is not None:
            base, row = numbered, F.col("__row")
        elif first_seen or in_row_order:
            raise ValueError("Row order needs an input that is read from Parquet files")
    used = [c for c in dict.fromkeys([*(r.column for r in resp), wt.column, *(fold_by or [])]) if c]
    fold = {}
    if include_sigma:
        fold = {"__fold": fold_column(fold_by, row=row, others=[col_of(c) for c in dict.fromkeys([x, *used])])}
    measures = {**fold, **M.row_measures(resp, wt)}
    partial, rollup = M.partial_aggs(n_resp), M.rollup_aggs(n_resp)
    if first_seen:
        measures["__row"] = row
        partial, rollup = [*partial, F.min("__row").alias("first_seen")], [*rollup, F.min("first_seen").alias("first_seen")]

    if tiled:
        ties = used if not tie_by else ["__row"] if in_row_order else list(tie_by)
        if include_sigma and not fold_by and row is not None and not tie_by:
            ties = [*ties, "__row"]  # rows of other folds aren't interchangeable
        # Tie columns under names of their own, beside x and the measures: nothing else is read.
        named = {f"__tie{i}": col_of(c) for i, c in enumerate(ties)}
        rows = base.select(try_double(x).alias("__qx"), *[c.alias(n) for n, c in {**named, **measures}.items()])
        key = quantile_key(F.col("__tile"))

        def summed() -> DataFrame:
            tiles = tiled_parts(rows, n_tiles, list(named), list(fold), list(measures), partial, rollup)
            return tiles.select(key.key.alias("x_key"), key.label.alias("x_label"), *[c for c in tiles.columns if c != "__tile"])

    else:
        key = x_key(base, x, band, bucket)
        # The sort key is a function of the group key, so it is derived after the
        # aggregation: a min() over a string sort key would force a sort-based
        # aggregate of the whole table instead of a hash aggregate.
        keyed = base.select(
            key.key.alias("x_key"), key.label.alias("x_label"), *[c.alias(name) for name, c in measures.items()]
        )
        summed = lambda: materialize(keyed.groupBy("x_key", "x_label", *fold).agg(*partial))
    group_kind = key.kind

    def group(parts: DataFrame) -> DataFrame:
        grouped = parts
        if include_sigma:
            grouped = parts.groupBy("x_key", "x_label").agg(*rollup)
            grouped = grouped if is_single(parts) else materialize(grouped)
        return groups_from_parts(grouped, group_kind, n_resp)

    def present(g: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        return present_groups(
            g, group_kind, n_resp, parts=parts if include_sigma else None, low_weight=low_weight, sort=sort,
            max_groups=max_groups, transform=transform, sigma=float(sigma or 0) if include_sigma else 0.0,
        )

    return ChartResult(
        x=x,
        x_kind=x_kind,
        group_kind=group_kind,
        responses=resp,
        weight=wt,
        max_groups=int(max_groups or 0),
        scanned=rows if tiled else keyed,
        _parts_of=summed,
        _group=group,
        _present=present,
        _source=source,
        _filter=filter,
    )


def groups_from_parts(grouped: DataFrame, group_kind: str, n_resp: int) -> DataFrame:
    """Group rows (volume, KPI parts and ratios, sort key) from (group) partial sums."""
    sort_of_key = F.coalesce(F.col("x_key"), F.lit(QUANTILE_MISSING_SORT)) if group_kind == kinds.QUANTILE else F.col("x_key")
    return M.finish(grouped, n_resp).withColumns(
        {"volume": F.coalesce(finite_or_null("volume"), F.lit(0.0)), "x_sort": sort_of_key}
    )


def present_groups(
    groups: DataFrame,
    group_kind: str,
    n_resp: int,
    *,
    parts: DataFrame | None = None,
    low_weight: Any = "0",
    sort: str = "alpha",
    max_groups: int | None = None,
    transform: str = "none",
    sigma: float = 0.0,
) -> tuple[DataFrame, DataFrame | None]:
    """Display rows from group rows: tails/Other, sigma, sort, cap, transforms.

    ``parts`` are the (group, fold) partial sums, required when ``sigma`` > 0.
    Returns the rows and the transform-domain warning (or None).
    """
    display, has_tails = assign_display(groups, group_kind, low_weight)
    display = display.withColumn("__id", F.when(F.col("is_tail"), F.lit(None)).otherwise(F.col("x_key")))
    merged = _merge(display, n_resp, group_kind) if has_tails else _unmerged(display, n_resp)
    if sigma > 0 and parts is not None and n_resp >= 2:
        # Rows of one task are joined there; a broadcast would be a job of its own.
        here = (lambda df: df.coalesce(1).hint("shuffle_hash")) if is_single(parts) and is_single(display) else (lambda df: df)
        members = here(display.select("x_key", "x_label", F.col("x").alias("__x"), F.col("is_tail").alias("__t"),
                                      F.col("__id").alias("__i")))
        fold_parts = parts.join(
            members, (parts["x_key"].eqNullSafe(members["x_key"])) & (parts["x_label"] == members["x_label"])
        ).select(F.col("__x").alias("x"), F.col("__t").alias("is_tail"), F.col("__i").alias("__id"),
                 "__fold", "volume_sum", "resp0_num", "resp1_num")
        sig = fold_sigma(fold_parts, ["x", "is_tail", "__id"]).select(
            F.col("x").alias("__sx"), F.col("is_tail").alias("__st"), F.col("__id").alias("__si"),
            "sigma_se", "valid_folds")
        # Spark takes a joined table for larger than one task's share; one row per display row of one pinned partition isn't.
        merged = merged.join(
            F.broadcast(sig) if is_single(merged) else sig,
            (F.col("x") == F.col("__sx")) & (F.col("is_tail") == F.col("__st")) & F.col("__id").eqNullSafe(F.col("__si")),
            "left",
        ).drop("__sx", "__st", "__si")
    else:
        sigma = 0.0
        merged = merged.withColumns({"sigma_se": F.lit(None).cast("double"), "valid_folds": F.lit(None).cast("long")})
    capped = cap_groups(merged, sort_columns(group_kind, sort), max_groups)
    rows, invalid = _transform(capped, n_resp, transform, sigma)
    return rows.drop("__id"), invalid


def _finite(q: str) -> str:
    return f"CASE WHEN abs({q}) < double('inf') THEN {q} END"


def _unmerged(display: DataFrame, n_resp: int) -> DataFrame:
    """Display rows when nothing was merged: the groups themselves."""
    exprs = ["x", "is_tail", "__id", "x_sort", "volume", *[c for c in display.columns if c == "first_seen"]]
    for i in range(n_resp):
        num, den = f"resp{i}_num", f"resp{i}_den"
        exprs += [f"{_finite(num)} AS {num}", f"{_finite(den)} AS {den}",
                  f"{_finite(f'CASE WHEN {den} <> 0 THEN {num} / {den} END')} AS resp{i}"]
    return display.selectExpr(*exprs)


def _merge(display: DataFrame, n_resp: int, group_kind: str) -> DataFrame:
    """Collapse display rows: tails re-sum their members (null parts count as 0).

    Categorical rows never sort by ``x_sort``; their (string) sort key is
    re-derived from the label so the aggregate stays hash-based.
    """
    tail = F.col("is_tail")
    ordered = group_kind != kinds.CATEGORICAL
    aggs = [F.min("x_sort").alias("x_sort")] if ordered else []
    aggs.append(F.sum("volume").alias("volume"))
    aggs += [F.min(c).alias(c) for c in display.columns if c == "first_seen"]
    for i in range(n_resp):
        aggs.append(
            F.when(F.first(tail), F.coalesce(F.sum(f"resp{i}_num"), F.lit(0.0)))
            .otherwise(F.max(f"resp{i}_num"))
            .alias(f"resp{i}_num")
        )
        aggs.append(F.sum(f"resp{i}_den").alias(f"resp{i}_den"))
    out = display.groupBy("x", "is_tail", "__id").agg(*aggs)
    if not ordered:
        out = out.withColumn("x_sort", F.col("x"))
    for i in range(n_resp):
        out = out.withColumn(f"resp{i}", finite_or_null(safe_ratio(F.col(f"resp{i}_num"), F.col(f"resp{i}_den"))))
        out = out.withColumn(f"resp{i}_num", finite_or_null(f"resp{i}_num")).withColumn(
            f"resp{i}_den", finite_or_null(f"resp{i}_den")
        )
    return out


def _transform(rows: DataFrame, n_resp: int, transform: str, sigma: float) -> tuple[DataFrame, DataFrame | None]:
    """Display values (TRF-1..4) over the shown rows; returns rows and the invalid-value warning.

    Averages for the centred transforms are two sums over the shown rows (after a cap): one row.
    """
    if n_resp == 0:
        return rows, None
    name = str(transform or "none")
    if name == "none" and not (sigma > 0 and n_resp >= 2):
        return rows, None
    averages = [f"CAST(NULL AS DOUBLE) AS __avg{i}" for i in range(n_resp)]
    if name in ("zero", "one"):
        sums = [f"sum(coalesce(resp{i}_num, 0D)) AS n{i}" for i in range(n_resp)]
        sums += [f"sum(coalesce(resp{i}_den, 0D)) AS d{i}" for i in range(n_resp)]
        if is_single(rows):
            over = [s.replace(" AS ", " OVER () AS __") for s in sums]
            rows = rows.selectExpr("*", *over)
            averages = [f"CASE WHEN __d{i} <> 0 THEN __n{i} / __d{i} END AS __avg{i}" for i in range(n_resp)]
        else:
            found = rows.selectExpr(*sums).first()
            averages = [
                f"{(found[f'n{i}'] / found[f'd{i}'])!r}D AS __avg{i}" if found[f"d{i}"] else averages[i]
                for i in range(n_resp)
            ]
    staged = rows.selectExpr("*", *averages)
    shown = {f"resp{i}": transform_sql(f"resp{i}", name, f"__avg{i}") for i in range(n_resp)}
    if sigma > 0 and n_resp >= 2:
        ok = "sigma_se IS NOT NULL AND resp1 IS NOT NULL"
        for bound, op in (("resp1_low", "-"), ("resp1_high", "+")):
            value = transform_sql(f"(resp1 {op} {float(sigma)!r}D * sigma_se)", name, "__avg1")
            shown[bound] = f"CASE WHEN {ok} THEN {value} END"
    inner = [f"__{c}{i}" for c in ("avg", "n", "d") for i in range(n_resp)]
    others = [quote(c) for c in staged.columns if c not in shown and c not in inner]
    display = staged.selectExpr(*others, *[f"{sql} AS {col}" for col, sql in shown.items()])
    if name == "none":
        return display, None
    invalid = " + ".join(
        f"CASE WHEN resp{i} IS NOT NULL AND ({shown[f'resp{i}']}) IS NULL THEN 1 ELSE 0 END" for i in range(n_resp)
    )
    counted = staged.selectExpr(f"CAST(sum({invalid}) AS BIGINT) AS count")
    warning = counted.where("count > 0").selectExpr(
        "4 AS position",
        "'transform_domain' AS code",
        "count",
        f"concat(CAST(count AS STRING), ' response values could not be shown because they are outside the {name} transform domain.') AS message",
    )
    return display, warning


def chart_from_request(df: DataFrame, request: dict) -> ChartResult:
    """Run a chart from a request dict with the original tool's keys.

    Requests keep two responses, 1000 tiles and 10,000 groups at most, as that tool does.

    Keys: x, responses (list of {label, numerator}), denominator/weight,
    filter, bandWidth, quantileMode, dateBucket, lowGroup, sort, sigma,
    transform, maxGroups; plus our tieBy / foldBy key lists.  Ties and folds follow the order of the input's files, as
    in that tool, where it has one.
    """
    quantile_mode = Argument(request.get("quantileMode")).switched_on()
    numeric = [item for item in request.get("responses") or [] if M.resolve_responses(df, [item])]
    ties = request.get("tieBy") or (ROW_ORDER if quantile_mode and file_place(df) else None)
    return chart(
        df,
        str(request.get("x") or ""),
        responses=numeric[: M.MOST_RESPONSES],
        weight=request.get("denominator", request.get("weight")),
        filter=request.get("filter"),
        band=None if quantile_mode else request.get("bandWidth"),
        quantiles=Argument(request.get("bandWidth")).tiles(MOST_TILES) if quantile_mode else None,
        bucket=request.get("dateBucket"),
        low_weight=str(request.get("lowGroup") or "0"),
        sort=str(request.get("sort") or "alpha"),
        sigma=float(request.get("sigma") or 0),
        transform=str(request.get("transform") or "none"),
        max_groups=int(request.get("maxGroups") or REQUEST_MAX_GROUPS),
        tie_by=ties,
        fold_by=request.get("foldBy"),
    )
