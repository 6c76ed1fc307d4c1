"""Exact global running sums and row positions without a single-task window.

Rows are range-partitioned on the order columns, and written to the checkpoint folder with their partition number: that
pins the partitions, so a second action sees the same split. Totals per partition, one row each, give every partition what
lies before and behind it; a window inside the partition adds the rest. A run of equal order keys is split by a hash of
the rows' content, never by a random number: a map task that runs again after an executor was lost sends the same rows
to the same places, in whatever order it sees them. Rows that a plan already holds in one task (small pinned tables) need
none of that: nothing lies before or behind them.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiframe.functions.numbers import col_of
from kpiframe.session import is_single, materialize


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def content_hash(df: DataFrame) -> Column:
    """A 64-bit hash of everything in a row that can be hashed: the same wherever and whenever the row is read."""
    return F.xxhash64(*[col_of(f.name) for f in df.schema.fields if _hashable(f.dataType)])


def range_split(df: DataFrame, order_by: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned by ``order_by`` and, within equal keys, by ``__salt``, a hash of the row."""
    keys = [*order_by, F.col("__salt").asc()]
    salted = df.withColumn("__salt", content_hash(df))
    return salted.repartitionByRange(partitions, *keys) if partitions else salted.repartitionByRange(*keys)


def running_sum(
    df: DataFrame,
    order_by: Sequence[Column],
    value: Column | None = None,
    *,
    pos_col: str = "__pos",
    cum_col: str = "__cum",
    suffix_col: str | None = None,
    count_col: str | None = None,
    total_col: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``pos_col`` (1-based position) and ``cum_col`` (inclusive running sum of ``value``, default 1).

    ``suffix_col`` adds the running sum from the end (summed from there, not a difference), ``count_col`` the number
    of rows, ``total_col`` the sum of ``value``. ``order_by`` must be a total order for the result to be unique. The result
    reads the pinned rows.
    """
    valued = df.withColumn("__val", F.lit(1) if value is None else value)
    order = list(order_by)
    single = not partitions and is_single(df)
    if single:
        placed = valued
    else:
        order.append(F.col("__salt").asc())
        pinned = materialize(range_split(valued, order_by, partitions).withColumn("__part", F.spark_partition_id()))
        single = is_single(pinned)
        placed = pinned if single else pinned.join(F.broadcast(_offsets(pinned)), "__part")  # one row per partition
    # Inside the only partition every row is at hand, so no shuffle by partition number is needed.
    by_part = Window.partitionBy() if single else Window.partitionBy("__part")
    local = by_part.orderBy(*order)
    # From the end: a window in falling order of the position, added up one row at a time as well.
    falling = by_part.orderBy(F.col(pos_col).desc())
    so_far = (Window.unboundedPreceding, Window.currentRow)
    nothing = F.lit(0)
    before = lambda name: nothing if single else F.col(name)
    placed = placed.withColumns(
        {
            pos_col: (before("__n_before") + F.row_number().over(local)).cast("long"),
            cum_col: before("__v_before") + F.sum("__val").over(local.rowsBetween(*so_far)),
        }
    )
    if suffix_col:
        placed = placed.withColumn(suffix_col, before("__v_behind") + F.sum("__val").over(falling.rowsBetween(*so_far)))
    every = Window.partitionBy()
    if count_col:
        placed = placed.withColumn(count_col, F.count(F.lit(1)).over(every) if single else F.col("__n_all"))
    if total_col:
        placed = placed.withColumn(total_col, F.sum("__val").over(every) if single else F.col("__v_all"))
    return placed.drop("__part", "__n_before", "__v_before", "__v_behind", "__n_all", "__v_all", "__val", "__salt")


def _offsets(pinned: DataFrame) -> DataFrame:
    """Rows and sums that lie before and behind each partition, and the number of all rows."""
    sums = pinned.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.sum("__val").alias("__v"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.orderBy(F.col("__part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        "__part",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n_before"),
        F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__v_before"),
        F.coalesce(F.sum("__v").over(behind), F.lit(0)).alias("__v_behind"),
        F.sum("__n").over(Window.partitionBy()).alias("__n_all"),
        F.sum("__v").over(Window.partitionBy()).alias("__v_all"),
    )
