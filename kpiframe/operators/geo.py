"""Geographic KPI summaries and map scales (AGG-14..17, KEY-13/14, JOIN-3/4, GEO-2..5, GEO-10/11).

A null KPI is "no data" here (the browser tool turned it into 0).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiframe.functions.numbers import col_of, count_at_most, finite_or_null, safe_ratio, try_double
from kpiframe.operators import measures as M
from kpiframe.operators.ranking import running_sum
from kpiframe.session import is_single

COLOUR_BUCKETS = 100
LEGEND_BUCKETS = 10


def geo_key(column: str) -> Column:
    """Trimmed text (spaces only), empty -> null (KEY-13)."""
    return F.nullif(F.trim(col_of(column).cast("string")), F.lit(""))


def clean_coordinate(column: str, limit: float) -> Column:
    """Value within [-limit, limit], else null; the row is kept (KEY-14)."""
    c = try_double(column)
    return F.when(c.between(-limit, limit), c)


def key_parts(
    df: DataFrame,
    key_col: str,
    response: M.Response,
    weight: M.Weight,
    lat_col: str | None = None,
    lon_col: str | None = None,
) -> DataFrame:
    """One aggregation of the table by geo key, the null key included.

    Carries the measure partials (so weight quality and totals are re-sums
    of this table) and, for points, the coordinate means over all rows of
    the key.  Map-side partial aggregation keeps the shuffle at
    (partitions x keys) rows however hot a key is.
    """
    cols = M.row_measures([response], weight)
    select = [geo_key(key_col).alias("key")] + [c.alias(n) for n, c in cols.items()]
    aggs = M.partial_aggs(1)
    if lat_col and lon_col:
        select += [clean_coordinate(lat_col, 90).alias("__lat"), clean_coordinate(lon_col, 180).alias("__lon")]
        aggs += [F.avg("__lat").alias("latitude"), F.avg("__lon").alias("longitude")]
    return df.select(*select).groupBy("key").agg(*aggs)


def summary_from_parts(parts: DataFrame, points: bool = False) -> DataFrame:
    """key, row_count, numerator, denominator, volume, value [, latitude, longitude] for non-null keys (AGG-14/15)."""
    den = F.coalesce(F.col("volume_sum"), F.lit(0.0))
    cols = [
        F.col("key"),
        F.col("rows").alias("row_count"),
        F.col("resp0_num").alias("numerator"),
        den.alias("denominator"),
        den.alias("volume"),
        finite_or_null(safe_ratio(F.col("resp0_num"), den)).alias("value"),
    ]
    if points:
        cols += [F.col("latitude"), F.col("longitude")]
    return parts.where(F.col("key").isNotNull()).select(*cols)


def point_status(units: DataFrame) -> DataFrame:
    """``status``: missing_value (checked first), missing_coordinate or plotted (AGG-16)."""
    return units.withColumn(
        "status",
        F.when(F.col("value").isNull(), F.lit("missing_value"))
        .when(F.col("latitude").isNull() | F.col("longitude").isNull(), F.lit("missing_coordinate"))
        .otherwise(F.lit("plotted")),
    )


def point_summary(units_with_status: DataFrame) -> DataFrame:
    """summary / plotted / missing_value / missing_coordinate counts."""
    s = F.col("status")
    return units_with_status.agg(
        F.count(F.lit(1)).alias("summary_count"),
        F.count(F.when(s == "plotted", 1)).alias("plotted_count"),
        F.count(F.when(s == "missing_value", 1)).alias("missing_value_count"),
        F.count(F.when(s == "missing_coordinate", 1)).alias("missing_coordinate_count"),
    )


def extent(points: DataFrame) -> DataFrame:
    """Bounding box of plotted points (GEO-10)."""
    return points.agg(
        F.min("latitude").alias("min_latitude"),
        F.max("latitude").alias("max_latitude"),
        F.min("longitude").alias("min_longitude"),
        F.max("longitude").alias("max_longitude"),
    )


def boundary_join(summary: DataFrame, boundaries: DataFrame, key: str = "key") -> DataFrame:
    """Every boundary feature with its summary row, if any (JOIN-3).

    ``matched`` is true when the feature's row has a finite value.  A summary that lies in one pinned partition is
    broadcast, so the features aren't shuffled; for a larger one (millions of units) the strategy is left to AQE.
    """
    feats = boundaries.withColumn("__bkey", col_of(key).cast("string"))
    s = summary.select(F.col("key").cast("string").alias("__skey"), *[F.col(c) for c in summary.columns if c != "key"])
    s = F.broadcast(s) if is_single(s) else s
    joined = feats.join(s, feats["__bkey"] == s["__skey"], "left").drop("__skey")
    return joined.withColumn("matched", F.coalesce(finite_or_null(F.col("value")).isNotNull(), F.lit(False))).drop("__bkey")


def match_stats(joined: DataFrame, summary: DataFrame, level_label: str = "keys", key_property: str = "key") -> DataFrame:
    """features, matched, summary_rows, no_match_warning and its message (JOIN-4)."""
    matched = F.col("matched")
    warn = (matched == 0) & (F.col("summary_rows") > 0)
    return (
        joined.agg(F.count(F.lit(1)).alias("features"), F.count(F.when(matched, 1)).alias("matched"))
        .withColumn("summary_rows", summary.agg(F.count(F.lit(1))).scalar())
        .withColumn("no_match_warning", warn)
        .withColumn("message", F.when(warn, F.lit(f"No {level_label} matched the GeoJSON {key_property} values.")))
    )


@dataclass
class Scale:
    """Summary rows with ``__rank`` among the finite values (ascending, then key; null for the others) and ``__n`` of them."""

    rows: DataFrame
    _bounds: dict[int, list[float]] = field(default_factory=dict, repr=False)

    def bounds(self, buckets: int) -> list[float]:
        """Thresholds of an equal-count scale: entry i-1 is the value at rank ceil(n * i / buckets) (GEO-2)."""
        if buckets not in self._bounds:
            rank, n = F.col("__rank"), F.col("__n")
            # The last i whose rank this can be; it is one if the rank before is too small for it.
            i = F.least(F.floor(rank * buckets / n), F.lit(buckets - 1))
            wanted = (i >= 1) & (i * n > (rank - 1) * buckets)
            # Fewer rows than buckets, whatever the table's size.
            found = self.rows.where(rank.isNotNull() & wanted).select("__rank", "__n", "value").collect()
            value = {r["__rank"]: float(r["value"]) for r in found}
            total = found[0]["__n"] if found else 0
            self._bounds[buckets] = [value[-(-total * i // buckets)] for i in range(1, buckets)] if total else []
        return self._bounds[buckets]


def value_scale(summary: DataFrame) -> Scale:
    """Number the finite values of a summary once, for thresholds, colours, legend and extremes."""
    finite = finite_or_null(F.col("value"))
    order = [finite.isNull().asc(), finite.asc(), F.col("key").asc()]
    ranked = running_sum(summary, order, finite.isNotNull().cast("long"), total_col="__n")
    return Scale(ranked.withColumn("__rank", F.when(finite.isNotNull(), F.col("__pos"))).drop("__pos", "__cum"))


def _as_scale(summary: DataFrame | Scale) -> Scale:
    return summary if isinstance(summary, Scale) else value_scale(summary)


def quantile_thresholds(summary: DataFrame | Scale, buckets: int = COLOUR_BUCKETS) -> DataFrame:
    """Rows ``(i, threshold)`` for i = 1..buckets-1 (GEO-2); no values -> no rows."""
    scale = _as_scale(summary)
    pairs = list(enumerate(scale.bounds(buckets), start=1))
    return scale.rows.sparkSession.createDataFrame(pairs, "i int, threshold double")


def _bucket_of(v: Column, thresholds: list[float]) -> Column:
    """Number of thresholds strictly below ``v`` — a balanced CASE search, codegen-friendly."""
    return F.when(v.isNotNull(), count_at_most(v, thresholds, strict=True))


def colour_buckets(summary: DataFrame | Scale, buckets: int = COLOUR_BUCKETS) -> DataFrame:
    """``bucket`` = number of thresholds strictly below the value (0..buckets-1); null value -> null (GEO-3)."""
    scale = _as_scale(summary)
    bucket = _bucket_of(finite_or_null(F.col("value")), scale.bounds(buckets)).cast("int")
    return scale.rows.drop("__rank", "__n").withColumn("bucket", bucket)


def legend_bins(summary: DataFrame | Scale, buckets: int = LEGEND_BUCKETS) -> DataFrame:
    """Legend rows (GEO-4): bin 0..buckets-1 with lower/upper bounds and the keys per bin, plus "No data"."""
    scale = _as_scale(summary)
    bounds = scale.bounds(buckets)
    inner = [None, *bounds, None] if bounds else [None] * (buckets + 1)
    bins = [(b, inner[b], inner[b + 1]) for b in range(buckets)]
    counted = (
        scale.rows.select(_bucket_of(finite_or_null(F.col("value")), bounds).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("keys"))
    )
    legend = scale.rows.sparkSession.createDataFrame([*bins, (-1, None, None)], "bin int, lower double, upper double")
    # Bin -1 counts keys without a value; it only shows if there are any.
    found = counted.select(F.coalesce("bin", F.lit(-1)).alias("bin"), "keys")
    return (
        legend.join(found, "bin", "left")
        .where((F.col("bin") >= 0) | F.col("keys").isNotNull())
        .select("bin", "lower", "upper", F.coalesce("keys", F.lit(0)).alias("keys"))
    )


def among_extremes(count: int) -> Column:
    """Whether a row of a scale is among the ``count`` highest (count > 0) or lowest (count < 0) finite values."""
    rank = F.col("__rank")
    return rank > F.col("__n") - count if count > 0 else rank <= -count


def hotspots(summary: DataFrame | Scale, count: int) -> DataFrame:
    """The ``count`` highest (count > 0) or lowest (count < 0) finite values with ``rank`` (GEO-5).

    Ties follow the key: descending for highest, ascending for lowest; 0 -> no rows.
    """
    scale = _as_scale(summary)
    rank = F.col("__n") + 1 - F.col("__rank") if count > 0 else F.col("__rank")
    chosen = scale.rows.where(among_extremes(count) & F.col("key").isNotNull() & F.lit(count != 0))
    return chosen.withColumn("rank", rank.cast("long")).drop("__rank", "__n")
