"""Exact equal-count tiles (``NTILE(n) OVER (ORDER BY x, ties…)``) at scale (KEY-3, WIN-2).

A global NTILE window runs in one task. Instead, one way for every input:

1. one pass counts the rows and sketches the values around the n-1 tile boundaries (``percentile_approx``): each
   boundary gets a window of values that should hold its rank;
2. one pass gives every row a bucket (inside a window or in a gap between two) and counts rows per bucket, along with
   whatever else the caller aggregates. The exact counts show whether every boundary lies in its window (else the windows
   are widened and counted again) and which buckets lie whole in one tile;
3. only rows of buckets that hold a boundary are ranked, by ``(x, ties…)`` (:func:`running_sum`). Charts
   (:func:`tiled_parts`) keep those rows from the second pass, equal ones as one, so they read the table twice.

NaN is the largest value, as in SQL's order: it is a bucket of its own behind the others. Zero and minus zero are
equal. Null x has no tile. Tile of rank r for N rows and n tiles (q, m = divmod(N, n)): the first m tiles hold q+1
rows, the rest q rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiframe.functions.numbers import array_of, col_of, count_at_most
from kpiframe.operators.ranking import running_sum
from kpiframe.session import is_single, materialize

INFINITY = float("inf")


def tile_of_rank(rank: Column, total: int, n: int) -> Column:
    """Tile number (1-based) of 1-based ``rank`` among ``total`` rows in ``n`` tiles."""
    q, m = divmod(total, n)
    big = m * (q + 1)
    first = F.ceil(rank / F.lit(q + 1))
    if q == 0:
        return first.cast("long")
    rest = F.lit(m) + F.ceil((rank - F.lit(big)) / F.lit(q))
    return F.when(rank <= F.lit(big), first).otherwise(rest).cast("long")


def _tile(rank: int, total: int, n: int) -> int:
    q, m = divmod(total, n)
    return -(-rank // (q + 1)) if rank <= m * (q + 1) else m + -(-(rank - m * (q + 1)) // q)


def _last_ranks(total: int, n: int) -> list[int]:
    """Rank of the last row of every tile but the last."""
    q, m = divmod(total, n)
    return [t * q + min(t, m) for t in range(1, min(n, total))]


@dataclass
class TilePlan:
    """Where rows go: ``bucket`` (a Column over x), the tile of whole buckets, and rank offsets of the others."""

    bucket: Column
    total: int
    n: int
    whole: dict[int, int]  # bucket -> tile
    before: dict[int, tuple[int, int]]  # bucket that holds a boundary -> rows in all buckets before it, and in it

    def lookup(self, values: dict[int, int]) -> Column:
        entries = array_of([values.get(b, 0) for b in range(max(values, default=0) + 1)], "bigint")
        return F.when(F.col("__bucket").isNotNull(), F.element_at(entries, F.col("__bucket") + 1))

    def skipped(self) -> dict[int, int]:
        """Buckets with a boundary are ranked together, bucket after bucket; what lies in between is added to their ranks."""
        out, held = {}, 0
        for b, (before, rows) in sorted(self.before.items()):
            out[b] = before - held
            held += rows
        return out

    def is_whole(self) -> Column:
        return ~self.holds_boundary()

    def holds_boundary(self) -> Column:
        return F.expr(f"__bucket IN ({','.join(map(str, self.before))})") if self.before else F.lit(False)


def _windows(values: Sequence[float]) -> tuple[list[float], list[float]]:
    """Disjoint ascending windows from (low, high) pairs that may overlap."""
    lows: list[float] = []
    highs: list[float] = []
    for low, high in sorted(zip(values[::2], values[1::2])):
        if lows and low <= highs[-1]:
            highs[-1] = max(highs[-1], high)
        else:
            lows.append(low)
            highs.append(high)
    return lows, highs


def plan_tiles(df: DataFrame, x: Column, n: int, count_buckets: Callable[[Column], dict[int, int]]) -> TilePlan | None:
    """The plan for ``n`` tiles of ``x``; None when no row has an x.

    ``count_buckets`` gets the bucket column and returns the exact rows of each bucket (one pass over the table).
    Buckets: 2k is the gap before window k, 2k+1 window k, the last one NaN.
    """
    accuracy = max(10_000, 100 * n)
    margin = 4.0 / accuracy
    guesses = [min(1.0, max(0.0, t / n + side)) for t in range(1, n) for side in (-margin, margin)]
    value = F.when(~F.isnan("__qx"), F.col("__qx"))
    aggs = [F.count("__qx").alias("total"), F.count(value).alias("numbers")]
    if guesses:
        aggs.append(F.percentile_approx(value, array_of(guesses, "double"), accuracy).alias("values"))
    stats = df.select(x.alias("__qx")).agg(*aggs).first()
    total, numbers = int(stats["total"]), int(stats["numbers"])
    if not total:
        return None
    ends = _last_ranks(total, n)
    values = list(stats["values"] or []) if guesses and numbers else []
    if numbers < total and numbers:
        # The sketch's fractions are of the numbers only; the boundaries' are of all rows.
        values = []
    while True:
        inside = [r for r in ends if r <= numbers]
        if not values and inside:
            shares = [min(1.0, max(0.0, r / numbers + side)) for r in inside for side in (-margin - 1 / numbers, margin + 1 / numbers)]
            values = list(df.select(value_of(x).alias("v")).agg(F.percentile_approx("v", array_of(shares, "double"), accuracy).alias("p")).first()["p"])
        lows, highs = _windows(values) if margin < 0.5 else ([-INFINITY], [INFINITY])
        nan_bucket = 2 * len(lows) + 1
        # One sorted list of edges: a window starts at its low and has ended at the next double after its high.
        edges = [e for low, high in zip(lows, highs) for e in (low, math.nextafter(high, INFINITY) if high < INFINITY else math.nan)]
        place = count_at_most(x, edges).cast("int")
        bucket = F.when(x.isNull(), F.lit(None).cast("int")).when(F.isnan(x), F.lit(nan_bucket)).otherwise(place)
        counts = count_buckets(bucket)
        whole: dict[int, int] = {}
        before: dict[int, tuple[int, int]] = {}
        seen, missed = 0, False
        for b in range(nan_bucket + 1):
            rows = counts.get(b, 0)
            if rows:
                first, last = _tile(seen + 1, total, n), _tile(seen + rows, total, n)
                if first == last:
                    whole[b] = first
                else:
                    before[b] = (seen, rows)
                    missed |= b % 2 == 0 and b != nan_bucket  # a boundary in a gap: its window was too narrow
            seen += rows
        if not missed:
            return TilePlan(bucket, total, n, whole, before)
        margin, values = margin * 16, []


def value_of(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def ranked_tiles(df: DataFrame, plan: TilePlan, ties: Sequence[str], tile_col: str) -> DataFrame:
    """``tile_col`` for rows (with ``__bucket`` and ``__qx``) of the buckets that hold a boundary."""
    hot = df.where(plan.holds_boundary())
    order = [F.col("__bucket").asc(), F.col("__qx").asc()] + [col_of(t).asc_nulls_last() for t in ties]
    ranked = running_sum(hot, order)
    rank = F.col("__pos") + plan.lookup(plan.skipped())
    return ranked.withColumn(tile_col, tile_of_rank(rank, plan.total, plan.n)).drop("__pos", "__cum")


def assign_tiles(df: DataFrame, x: Column, n: int, ties: Sequence[str], *, tile_col: str = "__tile") -> DataFrame:
    """``df`` plus ``tile_col``: NTILE(n) over non-null ``x`` ordered by ``(x, ties…)``; null x -> null."""

    def count_buckets(bucket: Column) -> dict[int, int]:
        rows = df.select(bucket.alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
        return {r["b"]: r["n"] for r in rows if r["b"] is not None}

    plan = plan_tiles(df, x, n, count_buckets)
    if plan is None:
        return df.withColumn(tile_col, F.lit(None).cast("long"))
    base = df.withColumn("__qx", x).withColumn("__bucket", plan.bucket)
    out = base.where(F.col("__bucket").isNull() | plan.is_whole()).withColumn(tile_col, plan.lookup(plan.whole))
    if plan.before:
        out = out.unionByName(ranked_tiles(base, plan, ties, tile_col))
    return out.drop("__qx", "__bucket")


#: So many different window rows (x, ties, measures) at most are ranked in one task; more are range-partitioned.
RANKED_TOGETHER = 200_000


def _scaled(name: str, kind: T.DataType) -> Column:
    """A partial sum over ``rows`` interchangeable rows, for ``__taken`` of them."""
    if isinstance(kind, T.IntegralType):
        return F.expr(f"{name} DIV rows * __taken").cast(kind).alias(name)
    return F.expr(f"CASE WHEN __taken = rows THEN {name} ELSE {name} / rows * __taken END").alias(name)


def _shared_out(ranked: DataFrame, plan: TilePlan, kept: Sequence[str]) -> DataFrame:
    """Ranked window rows (``rows`` alike, the last at rank ``__last``) dealt to the tiles their ranks fall into."""
    first = F.col("__last") - F.col("rows") + 1
    spread = ranked.withColumn(
        "__tile",
        F.explode(F.sequence(tile_of_rank(first, plan.total, plan.n), tile_of_rank(F.col("__last"), plan.total, plan.n))),
    )
    q, m = divmod(plan.total, plan.n)
    end = lambda t: t * F.lit(q) + F.least(t, F.lit(m))
    tile = F.col("__tile")
    taken = F.least(F.col("__last"), end(tile)) - F.greatest(first, end(tile - 1) + 1) + 1
    spread = spread.withColumn("__taken", taken)
    types = {f.name: f.dataType for f in spread.schema.fields}
    return spread.select("__tile", *[c if c not in _sums_of(types) else _scaled(c, types[c]) for c in kept])


def _sums_of(types: dict) -> list[str]:
    return [c for c in types if c == "rows" or c.endswith(("_sum", "_num", "_rows"))]


def tiled_parts(
    rows: DataFrame,
    n: int,
    ties: Sequence[str],
    grain: Sequence[str],
    measures: Sequence[str],
    partial: Sequence[Column],
    rollup: Sequence[Column],
) -> DataFrame:
    """Partial sums per (``__tile``, grain) of ``rows`` (with ``__qx``), ``__tile`` null for null x; pinned.

    The table is read twice: once for the count and the sketch, once for the buckets. The second pass keeps one row per
    bucket and grain for gaps; inside windows it keeps x, the ties and the measures as well, so equal rows become one with
    a count, and ranking reads only those. ``rollup`` re-sums ``partial`` (which has a count named ``rows``) at a coarser
    grain.
    """
    held: dict[str, DataFrame] = {}
    counted: dict[int, int] = {}
    # Rows alike in all of these are interchangeable in every sum.
    told = list(dict.fromkeys(["__qx", *ties, *(m for m in measures if m not in grain)]))
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def count_buckets(bucket: Column) -> dict[int, int]:
        staged = rows.withColumn("__bucket", bucket)
        inside = F.pmod("__bucket", F.lit(2)) == 1
        keys = [F.when(inside, F.col(c)).cast(kinds[c]).alias(f"__in{i}") for i, c in enumerate(told)]
        detail = staged.groupBy("__bucket", *grain, *keys).agg(*partial)
        held["parts"] = materialize(detail)
        found = held["parts"].groupBy("__bucket").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("different")).collect()
        counted.clear()
        counted.update({r["__bucket"]: r["different"] for r in found if r["__bucket"] is not None})
        return {r["__bucket"]: r["n"] for r in found if r["__bucket"] is not None}

    plan = plan_tiles(rows, F.col("__qx"), n, count_buckets)
    if plan is None:
        return materialize(rows.withColumn("__tile", F.lit(None).cast("long")).groupBy("__tile", *grain).agg(*partial))
    parts = held["parts"]
    kept = [*grain, *[c for c in parts.columns if c not in ("__bucket", *grain) and not c.startswith("__in")]]
    whole = parts.where(F.col("__bucket").isNull() | plan.is_whole()).select(plan.lookup(plan.whole).alias("__tile"), *kept)
    if plan.before:
        hot = parts.where(plan.holds_boundary())
        if sum(counted[b] for b in plan.before) <= RANKED_TOGETHER:
            hot = hot.coalesce(1)
        order = [F.col("__bucket").asc(), F.col("__in0").asc()]
        order += [F.col(f"__in{i}").asc_nulls_last() for i in range(1, len(told))]
        order += [F.col(c).asc_nulls_last() for c in grain]
        ranked = running_sum(hot, order, F.col("rows"))
        ranked = ranked.withColumn("__last", F.col("__cum") + plan.lookup(plan.skipped()))
        shared = _shared_out(ranked, plan, kept)
        both = is_single(whole) and is_single(shared)
        whole = whole.unionByName(shared)
        whole = whole.coalesce(1) if both else whole
    tiled = whole.groupBy("__tile", *grain).agg(*rollup)
    # Sums over pinned rows of one task are cheap to make again; others are pinned.
    return tiled if is_single(tiled) else materialize(tiled)
