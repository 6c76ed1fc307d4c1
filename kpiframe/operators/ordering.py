"""Row order, group cap and table paging for chart rows (SRT-1..4, LIM-1, LIM-3)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiframe.functions import kinds
from kpiframe.operators.ranking import running_sum
from kpiframe.session import ensure_checkpoint_dir, is_single

PAGE_SIZE = 1_000
SORTS = ("alpha", "volume", "actual", "response", "expected")


def sort_columns(kind: str, sort: str = "alpha") -> list[Column]:
    """Sort order of display rows.

    Ordered kinds always sort by the sort key (nulls last).  Categorical:
    ``alpha`` (case-insensitive label), ``volume`` (tails first, then weight
    descending), ``actual``/``response`` and ``expected`` (KPI descending,
    nulls last); the label breaks ties.
    """
    label = [F.lower(F.col("x")).asc(), F.col("x").asc()]
    if kind != kinds.CATEGORICAL:
        return [F.col("x_sort").asc_nulls_last(), *label]
    mode = str(sort or "alpha")
    if mode == "volume":
        return [F.col("is_tail").desc(), F.col("volume").desc(), *label]
    if mode in {"actual", "response"}:
        return [F.col("resp0").desc_nulls_last(), *label]
    if mode == "expected":
        return [F.col("resp1").desc_nulls_last(), *label]
    return label


def cap_groups(rows: DataFrame, order: list[Column], max_groups: int | None = None) -> DataFrame:
    """Rows with their 1-based ``position`` in ``order`` and ``truncated`` (whether a cap dropped rows).

    None or 0 keeps all rows. With a cap, a distributed top-k leaves one row more than asked for, which tells
    whether there are more.
    """
    cap = int(max_groups or 0)
    top = rows if not cap or is_single(rows) else rows.orderBy(*order).limit(cap + 1)
    ranked = running_sum(top, order, count_col="__n").withColumnRenamed("__pos", "position").drop("__cum")
    if cap > 0:
        ranked = ranked.withColumn("truncated", F.col("__n") > cap).where(F.col("position") <= cap)
    else:
        ranked = ranked.withColumn("truncated", F.lit(False))
    return ranked.drop("__n")


def table_page(rows: DataFrame, page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """One page of positioned rows; the page is clamped to 1..pages.

    Adds ``page`` and ``pages``.  ``rows`` must carry ``position`` (1..n);
    the row count is one scalar, so the page filter is a plain predicate.
    """
    size = max(1, int(page_size))
    n = int(rows.agg(F.max("position").alias("n")).first()["n"] or 0)
    pages = max(1, -(-n // size))
    current = min(max(int(page), 1), pages)
    lo, hi = (current - 1) * size, current * size
    return rows.where((F.col("position") > F.lit(lo)) & (F.col("position") <= F.lit(hi))).withColumns(
        {"pages": F.lit(pages).cast("long"), "page": F.lit(current).cast("long")}
    )


#: Rows of one file of a :class:`PagedRows`: 100 pages of the usual size.
FILE_ROWS = 100_000


class PagedRows:
    """Positioned rows (1..n, LIM-3) in files by position, so that one page opens the one or two files that hold it.

    The rows are written once: partitioned by the number of their file, sorted by position inside, with the file number as
    a folder. A page is a read of the folders that it needs.
    """

    def __init__(self, rows: DataFrame, path: str | None = None, file_rows: int = FILE_ROWS):
        self._spark = rows.sparkSession
        self.path = path or f"{ensure_checkpoint_dir(self._spark)}/pages-{uuid.uuid4().hex}"
        self.file_rows = file_rows
        number = F.floor((F.col("position") - 1) / F.lit(file_rows)).cast("long")
        dealt = rows.withColumn("file", number).repartition("file").sortWithinPartitions("file", "position")
        dealt.write.partitionBy("file").parquet(self.path)
        self.schema = rows.schema
        self.rows = int(self.read().agg(F.max("position").alias("n")).first()["n"] or 0)

    def read(self) -> DataFrame:
        return self._spark.read.schema(T.StructType([*self.schema.fields, T.StructField("file", T.LongType())])).parquet(self.path)

    def page(self, number: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
        """Rows of a page (clamped to 1..pages) with ``page`` and ``pages``."""
        size = max(1, int(page_size))
        pages = max(1, -(-self.rows // size))
        current = min(max(int(number), 1), pages)
        lo, hi = (current - 1) * size, current * size
        wanted = self.read().where(F.col("file").between(lo // self.file_rows, (hi - 1) // self.file_rows))
        wanted = wanted.where((F.col("position") > lo) & (F.col("position") <= hi)).drop("file")
        return wanted.withColumns({"pages": F.lit(pages).cast("long"), "page": F.lit(current).cast("long")})
