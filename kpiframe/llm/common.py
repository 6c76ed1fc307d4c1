"""Helpers shared by the corpus operators: shared-folder tables, label folds, row limits of Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from kpiframe.session import ensure_checkpoint_dir

#: Everything the contracts call white space in texts: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]"
WORD_OF_SIZE = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None, fewer: int = 1) -> DataFrame:
    """Write ``df`` as a zstd Parquet table in the shared folder and return a DataFrame that reads it.

    The table cuts the lineage and stays readable when executors are lost. ``fewer``: a narrow table is written by one
    task for so many shuffle partitions, so that it isn't cut into tiny files.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, label)
    if fewer > 1:
        df = df.coalesce(max(1, shuffle_partitions(spark) // fewer))
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id's text leaves 2 modulo 4 (a null id may be learned from)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def hash_below(share: float) -> int:
    """The 64-bit hash below which about ``share`` of evenly spread hashes lie."""
    return 2**63 - 1 if share >= 1 else int(share * 2**64) - 2**63


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def place_of(docs: DataFrame) -> Column:
    """File and row where a row of ``docs`` is stored (an extra column named like the metadata doesn't hide it)."""
    meta = docs.metadataColumn("_metadata")
    return F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def stored(docs: DataFrame) -> DataFrame:
    """``docs``, or a written copy if it isn't read from files: then every row has a place."""
    try:
        docs.select(place_of(docs))
        return docs
    except AnalysisException:
        return written(docs, "content")


def located(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``place``, the file and row where the row is stored."""
    docs = stored(docs)
    return docs.select(*columns, place_of(docs).alias("place"))


def fresh(columns, name: str) -> str:
    """``name``, or one like it that no column has (names don't tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidied(run):
    """A task's function over batches that leaves its worker small: workers stay for the next stages, and what their
    allocators hold back counts against the executor."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def collect_garbage(spark: SparkSession) -> None:
    """Have the executors' JVMs collect and return free heap before the next stage.

    A JVM keeps the heap that a stage's garbage made it claim, and the Python workers of the next stage need room beside
    it. One short task per core asks for it; an executor that gets none only keeps what it has.
    """
    tasks = max(1, spark.sparkContext.defaultParallelism)
    call = F.reflect(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, tasks, 1, tasks).select(call.alias("done")).write.format("noop").mode("overwrite").save()


def give_back() -> None:
    """Return free memory of this Python worker to the system."""
    from kpiframe.llm import pieces

    pieces.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: it trims by itself or not at all


#: Up to so many dropped rows (a file name and a number each) are broadcast; beyond, the same join shuffles.
DROPPED_BROADCAST = 200_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` (stored) whose place isn't in ``dropped`` (place)."""
    columns = docs.columns
    place, gone_place = fresh(columns, "__place"), fresh(columns, "__gone")
    placed = docs.select("*", place_of(docs).alias(place))
    gone = written(dropped.select(F.col("place").alias(gone_place)), "dropped", fewer=8)
    if gone.count() <= DROPPED_BROADCAST:
        gone = F.broadcast(gone)
    return placed.join(gone, F.col(place) == F.col(gone_place), "left_anti").select(*columns)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few fixed rows as a DataFrame of literals."""
    fields = [part.split() for part in schema.split(", ")]
    structs = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, fine)


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; an error where sums of products could leave 64 bits."""
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    most = F.sqrt(F.lit(2.0**62) / F.greatest(F.size(vector), F.lit(1))) - 1
    fits = F.coalesce(largest * scale < most, F.lit(True))
    message = F.lit("vector components are too large for exact 64-bit inner products")
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return F.when(fits, whole).otherwise(F.raise_error(message).cast("array<bigint>"))


#: Bytes of rows that a Python worker gets at once; texts are long, and both sides hold a few such batches.
ARROW_BYTES = "4m"


def prepare(spark: SparkSession) -> None:
    """Prepare a session for the corpus queries: small Arrow batches, and workers that can import this library
    (from where the driver did, if it lies there for them too)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
