"""Table handle: one CSV or Parquet input (SRC-1, SRC-2, SRC-7, ARG-1, TOP-5)."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiframe.functions import kinds
from kpiframe.functions.numbers import col_of
from kpiframe.operators.profile import profile, table_statistics
from kpiframe.sources.statistics import FileStatistics

SUPPORTED = (".csv", ".parquet")


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem = name.split("*", 1)[0] if "*" in name else name
    return Path(stem if "." in stem else name).suffix.lower()


#: Types of a CSV column from the narrowest on: which texts (without blanks around them) it takes, besides empty ones.
_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^(?i:[+-]?inf(inity)?|nan)$"
_DAY = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
CSV_TYPES = {
    "boolean": r"^(?i:true|false)$",
    "int": r"^[+-]?[0-9]+$",
    "bigint": r"^[+-]?[0-9]+$",
    "double": _NUMBER,
    "date": rf"^{_DAY}$",
    "timestamp": rf"^{_DAY}([ T][0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]{{1,9}})?)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?)?$",
}


def _as_type(column: Column, kind: str) -> Column:
    return F.trim(column).try_cast(kind)


def csv_types(rows: DataFrame) -> dict[str, str]:
    """Type of every column of ``rows`` (texts): the first of ``CSV_TYPES`` that takes all its values, else string.

    One aggregate for all columns: per column and type, whether a value is outside it, which merges from any partial
    result.
    """
    aggs = []
    for i, name in enumerate(rows.columns):
        c = col_of(name)
        aggs.append(F.count(c).alias(f"n{i}"))
        for kind, form in CSV_TYPES.items():
            fits = F.trim(c).rlike(form) & _as_type(c, kind).isNotNull()
            aggs.append(F.count(F.when(c.isNotNull() & ~fits, 1)).alias(f"{kind}{i}"))
    found = rows.agg(*aggs).first()
    out = {}
    for i, name in enumerate(rows.columns):
        fits = [kind for kind in CSV_TYPES if found[f"n{i}"] and not found[f"{kind}{i}"]]
        out[name] = fits[0] if fits else "string"
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header row; empty field = null; malformed rows dropped.

    Without an explicit schema the types come from one pass over all rows of the right width (:func:`csv_types`), so a
    malformed row changes no column's type. CSV column pruning is switched off so that a row malformed in an unread
    column is still dropped, keeping counts identical whichever columns a query touches.
    """
    reader = spark.read.options(header=True, mode="DROPMALFORMED", columnPruning=False)
    if schema is not None:
        return reader.schema(schema).csv(path)
    # The names of all columns are those of the header, texts without a schema: no data is read for them.
    names = reader.option("inferSchema", False).csv(path).columns
    texts = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).csv(path)
    types = csv_types(texts)
    return texts.select(*[(col_of(c) if k == "string" else _as_type(col_of(c), k)).alias(c) for c, k in types.items()])


def _folder_suffix(spark: SparkSession, path: str) -> str:
    """Suffix of the files in a folder whose own name says nothing; an empty text for anything else."""
    if "*" in path:
        return ""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place) or not system.getFileStatus(place).isDirectory():
        return ""
    files = system.listFiles(place, True)
    while files.hasNext():  # up to the first data file
        name = files.next().getPath().getName()
        if name[:1] not in "_." and _suffix(name) in SUPPORTED:
            return _suffix(name)
    return ""


def input_suffix(spark: SparkSession, path: str) -> str:
    suffix = _suffix(path)
    return suffix if suffix in SUPPORTED else _folder_suffix(spark, path) or suffix


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Format dispatch on the lower-cased suffix (files, folders or globs)."""
    suffix = input_suffix(spark, path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".csv":
        return read_csv(spark, path, schema)
    raise ValueError("Only .csv and .parquet files are supported")


@dataclass
class Table:
    """An input treated as fixed until :meth:`refresh` (TOP-5)."""

    spark: SparkSession
    path: str
    schema_hint: T.StructType | str | None = None
    statistics_store: str | None = None
    _df: DataFrame | None = field(default=None, repr=False)
    _statistics: tuple | None = field(default=None, repr=False)
    #: Files that the last :meth:`profile` had to read.
    files_read: int = field(default=0, repr=False)

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            self._df = read_table(self.spark, self.path, self.schema_hint)
        return self._df

    def refresh(self) -> DataFrame:
        """Forget cached file listings and re-read the input; statistics of unchanged files stay."""
        self.spark.catalog.refreshByPath(self.path)
        self._df = self._statistics = None
        return self.df

    def statistics(self) -> tuple[int, dict[str, tuple]]:
        """Row count, and (low, high, standard deviation) of the numeric columns, kept until :meth:`refresh`.

        Of Parquet files they are kept per file in ``statistics_store`` (default: a folder in the shared folder), so
        later tables on the same files read only what is new or has changed.
        """
        if self._statistics is None:
            column_kinds = kinds.column_kinds(self.df)
            if input_suffix(self.spark, self.path) == ".parquet":
                kept = FileStatistics(self.spark, self.path, self.df.schema, self.statistics_store)
                rows, found = kept.merged()
                self.files_read = kept.read
                numeric = [c for c, k in column_kinds.items() if kinds.is_numeric_kind(k)]
                self._statistics = rows, {c: found.get(c, (None, None, None)) for c in numeric}
            else:
                self._statistics = table_statistics(self.df, column_kinds)
        return self._statistics

    def row_count(self) -> int:
        """Rows of the input, counted once (SCH-3)."""
        return self.statistics()[0]

    def profile(self) -> DataFrame:
        """The profile (TOP-3) from the kept statistics."""
        return profile(self.df, self.statistics())

    def file_metadata(self) -> DataFrame:
        """One row per input file: path and byte size (SRC-7).

        Read from the file listing (``binaryFile`` with only path and length
        selected, so no file content and no table row is read).
        """
        files = self.spark.read.format("binaryFile").load(self.path).select(
            F.col("path").alias("file_path"), F.col("length").alias("file_size")
        )
        suffix = input_suffix(self.spark, self.path)
        return files.where(F.lower(F.col("file_path")).endswith(suffix)) if suffix in SUPPORTED else files

    def describe(self) -> dict:
        """Schema response like the original tool's: path, file size, row count, columns (SCH-1).

        Collects only the per-column profile (one row per column) and one
        row of file totals.
        """
        size = self.total_size().first()
        columns = self.profile().orderBy("position").collect()
        return {
            "path": self.path,
            "file_size": int(size["file_size"] or 0),
            "row_count": self.row_count(),
            "columns": [
                {"name": c["name"], "type": c["type"], "kind": c["kind"], "band_suggestion": c["band_suggestion"]}
                for c in columns
            ],
        }

    def total_size(self) -> DataFrame:
        return self.file_metadata().agg(
            F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("file_size")
        )


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> Table:
    """Open a table; missing local paths raise ``FileNotFoundError`` (ARG-1)."""
    if "://" not in path and "*" not in path and not Path(path).exists() and _suffix(path) in SUPPORTED:
        raise FileNotFoundError(f"Dataset does not exist: {path}")
    if input_suffix(spark, path) not in SUPPORTED:
        raise ValueError("Only .csv and .parquet files are supported")
    return Table(spark, path, schema)
