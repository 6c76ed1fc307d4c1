"""Row numbers in file order (WIN-1), without a window over rows.

A Parquet row knows its file and its index there. The rows of each file, one number a file from the footers, give every
file the number of rows before it (files in path order), so a row's number is a sum of two numbers: the same however the
input is split into tasks. Numbers count all rows of the input, also where a filter drops some.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offsets of up to so many files (a path and a number each) are broadcast; more are joined as Spark sees fit.
BROADCAST_FILES = 100_000


def file_place(df: DataFrame) -> tuple[Column, Column] | None:
    """(file, index of the row in it) of a DataFrame that reads Parquet files; None for others."""
    try:
        meta = df.metadataColumn("_metadata")
        place = meta["file_path"], meta["row_index"]
        df.select(*place).schema  # analysed now
        return place
    except AnalysisException:
        return None


def rows_before(df: DataFrame) -> DataFrame | None:
    """file and before (rows of all files before it); None if there is one file at most."""
    files = df.inputFiles()
    if len(files) <= 1:
        return None
    # No column is read: the footers have the counts.
    read = df.sparkSession.read.parquet(*files)
    file, _ = file_place(read)
    counts = read.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    before = counts.select("file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return F.broadcast(before) if len(files) <= BROADCAST_FILES else before


def with_row_number(df: DataFrame, name: str = "__row") -> DataFrame | None:
    """``df`` and the 1-based number of each row in file order; None if its rows have no place in files."""
    place = file_place(df)
    if place is None:
        return None
    file, index = place
    before = rows_before(df)
    if before is None:
        return df.withColumn(name, index + 1)
    placed = df.select("*", file.alias("__file"), (index + 1).alias(name))
    joined = placed.join(before, F.col("__file") == F.col("file"))
    return joined.withColumn(name, F.col(name) + F.col("before")).drop("__file", "file", "before")
