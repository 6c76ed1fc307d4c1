"""Per-file statistics of a Parquet table, kept between profiles (SCH-3, SCH-5, SCH-6, TOP-5).

For every file and numeric column: rows, count, mean, sum of squared deviations, least and largest value, keyed by the file's
path, length and modification time. They are merged as the parallel variance formula does, so the profile of a table is an
aggregate over one row per file and column. A file that hasn't changed is never read again; new and changed files are.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiframe.functions import kinds
from kpiframe.functions.numbers import col_of, try_double
from kpiframe.operators.positions import file_place
from kpiframe.session import ensure_checkpoint_dir

#: Up to so many changed files are named to the reader; beyond, the whole table is read and the others left out.
NAMED_FILES = 10_000

_SCHEMA = (
    "file string, length long, modified timestamp, rows long, "
    "columns array<struct<name:string,n:long,mean:double,m2:double,low:long,high:long>>"
)


class FileStatistics:
    """Statistics of the Parquet files below ``path`` in the folder ``store`` (default: one in the shared folder)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, store: str | None = None):
        self.spark, self.path, self.schema = spark, path, schema
        name = "statistics-" + hashlib.md5(path.encode()).hexdigest()
        self.store = (store or f"{ensure_checkpoint_dir(spark)}/{name}").rstrip("/")
        #: Files that the last refresh read.
        self.read = 0

    def files(self) -> DataFrame:
        """file, length, modified and path of every file, from the listing: no content is read."""
        listed = self.spark.read.format("binaryFile").load(self.path)
        meta = listed.metadataColumn("_metadata")
        return listed.select(
            meta["file_path"].alias("file"), meta["file_size"].alias("length"), meta["file_modification_time"].alias("modified"), "path"
        )

    def _held(self) -> DataFrame:
        try:
            return self.spark.read.schema(_SCHEMA).parquet(f"{self.store}/*")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], _SCHEMA)

    def refresh(self) -> DataFrame:
        """The statistics of all present files; only files without any are read."""
        key = ["file", "length", "modified"]
        listed = self.files()
        new = listed.join(self._held().select(*key).distinct(), key, "left_anti")
        names = [r["path"] for r in new.select("path").limit(NAMED_FILES + 1).collect()]
        some = len(names) <= NAMED_FILES
        self.read = len(names) if some else new.count()
        if names:
            reader = self.spark.read.schema(self.schema)
            if "*" not in self.path and not any(n.rstrip("/").endswith(self.path.rstrip("/")) for n in names):
                reader = reader.option("basePath", self.path)  # folders named after values stay columns
            table = reader.parquet(*(names if some else [self.path]))
            found = self._of(table).join(new, "file")  # drops files that aren't new
            target = f"{self.store}/{uuid.uuid4().hex}"
            found.select(*key, "rows", "columns").coalesce(1 if some else 32).write.parquet(target)
        return self._held().dropDuplicates(key).join(listed.select(*key), key)

    @staticmethod
    def _of(table: DataFrame) -> DataFrame:
        file, _ = file_place(table)
        aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
        columns = []
        for i, (name, kind) in enumerate(kinds.column_kinds(table).items()):
            if not kinds.is_numeric_kind(kind):
                continue
            value = try_double(name)
            low, high = (F.min(col_of(name)), F.max(col_of(name))) if kind == kinds.INTEGER else (F.lit(None), F.lit(None))
            aggs += [
                F.count(value).alias(f"n{i}"), F.avg(value).alias(f"mean{i}"),
                (F.var_pop(value) * F.count(value)).alias(f"m2{i}"), low.cast("long").alias(f"lo{i}"), high.cast("long").alias(f"hi{i}"),
            ]
            parts = zip((f"n{i}", f"mean{i}", f"m2{i}", f"lo{i}", f"hi{i}"), ("n", "mean", "m2", "low", "high"))
            columns.append(F.struct(F.lit(name).alias("name"), *[F.col(c).alias(part) for c, part in parts]))
        listed = F.array(*columns) if columns else F.array().cast("array<struct<name:string,n:long,mean:double,m2:double,low:long,high:long>>")
        return table.groupBy(file.alias("file")).agg(*aggs).select("file", "rows", listed.alias("columns"))

    def merged(self) -> tuple[int, dict[str, tuple]]:
        """Row count, and (low, high, standard deviation) of every numeric column of the present files."""
        files = self.refresh()
        each = files.select(F.explode("columns").alias("c")).select("c.*").filter("n > 0")
        total = F.sum("n")
        centre = F.sum(F.col("n") * F.col("mean")) / total
        # Deviations from the mean of all files: a second, equally small aggregate.
        means = each.groupBy("name").agg(centre.alias("centre"))
        spread = (
            each.join(F.broadcast(means), "name")  # one row per column
            .groupBy("name")
            .agg(
                total.alias("n"),
                F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("centre")) ** 2).alias("m2"),
                F.min("low").alias("low"),
                F.max("high").alias("high"),
            )
        )
        found = spread.collect()  # one row per column
        rows = files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()["rows"]
        deviation = lambda r: (r["m2"] / (r["n"] - 1)) ** 0.5 if r["n"] > 1 else None
        return rows, {r["name"]: (r["low"], r["high"], deviation(r)) for r in found}
