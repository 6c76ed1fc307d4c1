"""Saved filters: a ``name,expression`` CSV on any file system that Spark reads (SRC-4, ARG-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Where filters are looked for without a path, the header, and the errors callers see.
DEFAULT_PLACES = ("filter_spec.csv", "specs/filter_spec.csv")
HEADER = ["name", "expression"]
HEADER_ERROR = "filter_spec.csv must have exactly these columns: name,expression"
MISSING_ERROR = "Filter specification file does not exist: "


def _exists(spark: SparkSession, place: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def saved_filters_place(spark: SparkSession, path: str | None = None, folder: str | None = None) -> str | None:
    """The filter file: ``path`` (an error if it isn't there), else the first default place below ``folder`` that has one."""
    if path:
        if not _exists(spark, path):
            raise FileNotFoundError(MISSING_ERROR + path)
        return path
    places = [f"{folder.rstrip('/')}/{p}" if folder else p for p in DEFAULT_PLACES]
    return next((p for p in places if _exists(spark, p)), None)


def load_saved_filters(spark: SparkSession, path: str | None = None, enabled: bool = True,
                       cwd: str | None = None) -> DataFrame:
    """DataFrame ``(name, expression)`` of the rows that have both, without white space around them.

    A missing explicit file is an error, a missing default file means no saved filters.  The header must be
    exactly ``name,expression`` (a UTF-8 byte-order mark before it is ignored).
    """
    place = saved_filters_place(spark, path, cwd) if enabled else None
    if place is None:
        return spark.createDataFrame([], "name string, expression string")
    raw = spark.read.options(header=True, multiLine=True, escape='"').csv(place)
    if [c.lstrip("\ufeff") for c in raw.columns] != HEADER:
        raise ValueError(HEADER_ERROR)
    # White space of any kind, not only blanks.
    bare = [F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "").alias(c) for c in HEADER]
    return raw.toDF(*HEADER).select(*bare).where((F.col("name") != "") & (F.col("expression") != ""))
