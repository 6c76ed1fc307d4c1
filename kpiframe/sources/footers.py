"""Row count and integer ranges from Parquet footers (SCH-3, SCH-6): Spark's aggregate push-down, no row group is read."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiframe.functions.numbers import col_of

#: Types whose ranges footers hold exactly.
RANGED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class FooterStatistics:
    rows: int
    ranges: dict[str, tuple[int | None, int | None]]


def plain_files(df: DataFrame) -> list[str] | None:
    """The input paths of a DataFrame that is nothing but a read of Parquet files, without a filter; else None."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return None
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().toString() != "Parquet":
        return None
    paths = relation.location().rootPaths()
    return [paths.apply(i).toString() for i in range(paths.size())]


def pushed_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` in which counts and ranges go into the Parquet scan; ``spark`` keeps its settings."""
    beside = spark.newSession()
    beside.conf.set("spark.sql.sources.useV1SourceList", "")
    beside.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return beside


def footer_query(df: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """rows and lo/hi of each column as a query that reads footers only; None if ``df`` isn't a plain read."""
    paths = plain_files(df)
    if paths is None:
        return None
    read = pushed_session(df.sparkSession).read.schema(df.schema).parquet(*paths)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs += [F.min(col_of(c)).alias(f"lo{i}"), F.max(col_of(c)).alias(f"hi{i}")]
    return read.agg(*aggs)


def is_pushed(query: DataFrame) -> bool:
    return "PushedAggregation: [COUNT(*)" in query._jdf.queryExecution().executedPlan().toString()


def footer_statistics(df: DataFrame, columns: Sequence[str]) -> FooterStatistics | None:
    """Row count of ``df`` and ranges of integer ``columns``; None where the footers can't tell.

    That is a DataFrame with a filter or of other sources, a column of another type or one that partitions folders,
    and files without statistics (or with a row group in which a column is all null).
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if any(not isinstance(kinds[c], RANGED) for c in columns):
        return None
    query = footer_query(df, columns)
    if query is None or not is_pushed(query):
        return None
    try:
        found = query.first()
    except (Py4JJavaError, PySparkException):
        return None  # a file without statistics
    return FooterStatistics(found["rows"], {c: (found[f"lo{i}"], found[f"hi{i}"]) for i, c in enumerate(columns)})
