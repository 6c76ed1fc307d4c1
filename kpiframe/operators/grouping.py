"""Low-weight grouping of chart groups into tails or "Other" (PST-1..5, WIN-3).

Works on aggregated group rows. Ordered kinds: groups in the order of their sort key (nulls last). The low tail is the
longest prefix whose running weight stays within the threshold; the high tail, among the rest, the longest
suffix whose weight summed from the end does. A tail of one group is left alone. Categorical kinds: groups within the
threshold become "Other" when there is more than one. The quantile "Missing" group is never merged or counted.
A tail ends at the first running sum above the threshold, also when a negative weight would bring it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiframe.functions import kinds
from kpiframe.functions.arguments import Argument, Threshold
from kpiframe.operators.ranking import running_sum
from kpiframe.session import is_single, materialize

LOW_TAIL = "Low tail"
HIGH_TAIL = "High tail"
OTHER = "Other"
LEAST_GROUPS = 3


def _shown(groups: DataFrame, merged: Column | None = None, name: str | Column = OTHER) -> DataFrame:
    """``x`` (display label) and ``is_tail``: groups where ``merged`` holds show ``name``."""
    if merged is None:
        return groups.withColumn("x", F.col("x_label")).withColumn("is_tail", F.lit(False))
    label = F.lit(name) if isinstance(name, str) else name
    return groups.withColumn("is_tail", merged).withColumn("x", F.when(merged, label).otherwise(F.col("x_label")))


def assign_display(groups: DataFrame, kind: str, threshold: object) -> tuple[DataFrame, bool]:
    """Group rows plus ``x`` and ``is_tail``; second value: whether anything merged.

    ``groups`` needs ``x_key, x_label, x_sort, volume``. With a threshold the returned rows read pinned rows,
    so callers may read them again. Only scalars reach the driver.
    """
    limit = Argument(threshold).threshold()
    if not limit.active:
        return _shown(groups), False
    if kind in kinds.ORDERED_KINDS:
        return _tails(groups, limit, F.col("x_key").isNull() if kind == kinds.QUANTILE else F.lit(False))
    return _others(groups if is_single(groups) else materialize(groups), limit)


def _amount(groups: DataFrame, limit: Threshold) -> Column:
    """The threshold as weight; a share is one of all groups' weight."""
    if not limit.share:
        return F.lit(limit.amount)
    if is_single(groups):
        total = F.sum("volume").over(Window.partitionBy())
    else:
        total = groups.agg(F.sum("volume").alias("__total")).scalar()
    return F.lit(limit.share) * F.coalesce(total, F.lit(0.0)) / F.lit(100.0)


def _others(groups: DataFrame, limit: Threshold) -> tuple[DataFrame, bool]:
    # One job: the threshold, the number of groups, and how many are within it.
    staged = groups.select("volume", _amount(groups, limit).alias("__amount"))
    found = staged.agg(
        F.max("__amount").alias("amount"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("volume") <= F.col("__amount"), 1)).alias("rare"),
    ).first()
    amount = found["amount"] or 0.0
    if amount <= 0 or found["n"] < LEAST_GROUPS or found["rare"] < 2:
        return _shown(groups), False
    return _shown(groups, F.col("volume") <= F.lit(amount)), True


def _tails(groups: DataFrame, limit: Threshold, missing: Column) -> tuple[DataFrame, bool]:
    # The Missing group sorts last and weighs nothing here, so it changes no other group's sums or place.
    order = [missing.asc(), F.col("x_sort").asc_nulls_last(), F.col("x_label").asc()]
    ranked = running_sum(groups, order, F.when(missing, F.lit(0.0)).otherwise(F.col("volume")), suffix_col="__suffix")
    # One job: how often each running sum is above the threshold.
    amount = F.col("__amount")
    staged = ranked.withColumn("__amount", _amount(ranked, limit)).where(~missing)
    ends = staged.agg(
        F.max("__amount").alias("amount"),
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("__cum") > amount, F.col("__pos"))).alias("low_stop"),
        F.max(F.when(F.col("__suffix") > amount, F.col("__pos"))).alias("high_stop"),
    ).first()
    plain = ranked.drop("__pos", "__cum", "__suffix")
    n = int(ends["n"])
    if n < LEAST_GROUPS or (ends["amount"] or 0.0) <= 0:
        return _shown(plain), False
    # Positions below low_from are the low tail; positions from high_from on the high tail.
    low_from = int(ends["low_stop"]) if ends["low_stop"] is not None else n + 1
    high_from = max(low_from, int(ends["high_stop"] or 0) + 1)
    low = F.lit(low_from > 2) & (F.col("__pos") < low_from)
    high = F.lit(n - high_from > 0) & (F.col("__pos") >= high_from)
    merged = ~missing & (low | high)
    shown = _shown(ranked, merged, F.when(low, F.lit(LOW_TAIL)).otherwise(F.lit(HIGH_TAIL)))
    return shown.drop("__pos", "__cum", "__suffix"), low_from > 2 or n - high_from > 0
