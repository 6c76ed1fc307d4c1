"""Fold-based standard errors of actual − expected (AGG-18..21).

Rows fall into 20 folds.  Per display row and fold the KPI parts are
summed; a fold counts when both KPIs exist there.  The standard error is
``stddev_samp(resp0 − resp1) / sqrt(folds)`` over the valid folds.  A merged
row (tail / Other) re-sums the folds that were valid in its member groups,
so everything runs at (group, fold) grain — at most 20 rows per group —
after the single aggregation of the big table.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiframe.functions.numbers import col_of

FOLDS = 20


def fold_column(
    fold_by: Sequence[str] | None = None, folds: int = FOLDS, *, row: Column | None = None, others: Sequence[Column] = ()
) -> Column:
    """Fold number 0..folds-1: the first 8 hex digits of ``md5(key text)`` modulo ``folds`` (the same number any SQL
    engine with md5 computes).

    The key is that of the ``fold_by`` columns, or else ``row``, the row's number in file order. Rows that have no
    place in files fall into folds by the hash of ``others``, the values that are used: either way the split size
    changes nothing.
    """
    if fold_by:
        # A null part has a text of its own, so null keys fall into folds like any other.
        parts = [F.coalesce(col_of(c).cast("string"), F.lit("\x00")) for c in fold_by]
        key = parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)
    elif row is not None:
        key = row.cast("string")
    else:
        return F.pmod(F.xxhash64(*others), F.lit(folds)).cast("int")
    hashed = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return (hashed % F.lit(folds)).cast("int")


def fold_sigma(fold_parts: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """``id_cols`` + ``sigma_se``, ``valid_folds`` from (member, fold) partial sums.

    ``fold_parts`` has one row per (member group, fold) with ``volume_sum``,
    ``resp0_num``, ``resp1_num`` and the display identity ``id_cols``.
    """
    den = F.coalesce(F.col("volume_sum"), F.lit(0.0))
    member_valid = (den != 0) & F.col("resp0_num").isNotNull() & F.col("resp1_num").isNotNull()
    per_fold = (
        fold_parts.where(member_valid)
        .groupBy(*id_cols, "__fold")
        .agg(F.sum("resp0_num").alias("n0"), F.sum("resp1_num").alias("n1"), F.sum(den).alias("d"))
        .where(F.col("d") != 0)
        .withColumn("__diff", F.col("n0") / F.col("d") - F.col("n1") / F.col("d"))
    )
    return per_fold.groupBy(*id_cols).agg(
        (F.stddev_samp("__diff") / F.sqrt(F.count(F.lit(1)))).alias("sigma_se"),
        F.count(F.lit(1)).alias("valid_folds"),
    )
