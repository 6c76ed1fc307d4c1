"""Exact deduplication by a stateful streaming aggregation (DataFrame functions only).

Texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``.

1. *Arrivals.* One pass over the texts writes a narrow table into the shared folder: digest of the
   normalised text, document id, code points, and the content locator (file and row of the stored text).
2. *State.* A streaming aggregation keyed by digest reads the arrivals. Its state lives in RocksDB with its
   change files in the shared folder, has no watermark and never expires. It keeps the number of rows and the
   row that stays (most code points, then smallest id, then smallest locator). Run again with the same
   ``state_dir``, it goes on from the state: documents that arrive later meet the digests of earlier runs. What an
   earlier run returned isn't taken back: if a longer copy arrives later, it stays as well, with the new group's size, and
   ``keep_id`` of its run names it; callers that keep earlier results drop the former keeper of that digest.
3. *Hits.* Where a digest came more than once, the full normalised bytes are compared: the smallest and the
   largest text of the digest are equal exactly if all are. Both are combined map-side, so a huge group of
   copies costs one row per task. Should a digest join different texts, those rows are grouped by the text
   (across runs that is an error: the digest is too short).
4. The state is read with Spark's state reader and joined back to the arrivals on the digest (AQE splits a hot one).

Defined results: null text counts as empty; repeated identical rows form one group of which exactly one row
stays; a null ``doc_id`` sorts after every id; very long texts are hashed and compared whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiframe.llm.common import BLANKS, located, shared_path, shuffle_partitions, written

DIGEST_BITS = 256

#: Up to so many hits (8 bytes each) their hashes are broadcast to keep other texts out of the shuffle of the
#: byte comparison; beyond, the same join shuffles the texts.
HITS_BROADCAST = 1_000_000

#: One state store for so many shuffle partitions.
STATE_SHARE = 4

#: Settings of the streaming session only: disk-backed state with bounded memory.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores: no space reserved ahead for their logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS + "+", "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, DIGEST_BITS)


def _stays() -> Column:
    """Sorts the row that stays first: most code points, smallest id (null last), smallest locator."""
    return F.struct(
        (-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("place")
    )


def _state(spark: SparkSession, arrivals: str, schema, state_dir: str, files_per_trigger: int) -> DataFrame:
    """Run the keyed state over the arrivals that it hasn't seen and read it back: digest, n, first."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    # The state's rows are narrow, and each partition is a store with memory of its own.
    session.conf.set("spark.sql.shuffle.partitions", str(max(1, shuffle_partitions(spark) // STATE_SHARE)))
    for key, value in STATE_SETTINGS.items():
        session.conf.set(key, value)
    stream = (
        session.readStream.schema(schema.add("run", "string"))
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(arrivals)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(_stays()).alias("first"))
    )
    query = (
        stream.writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", state_dir)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return (
        session.read.format("statestore")
        .load(state_dir)
        .select(F.col("key.digest"), F.col("value.*"))
        .toDF("digest", "n", "first")
    )


def exact_dedup(
    docs: DataFrame,
    *,
    digest: Callable[[Column], Column] = sha256,
    state_dir: str | None = None,
    files_per_trigger: int = 1000,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the locator ``place``.

    ``digest`` may be any function of the normalised text: equal digests are only hits, the bytes decide.
    ``state_dir`` keeps the state for later runs (default: a new folder in the shared folder).
    """
    spark = docs.sparkSession
    content = located(docs, "doc_id", "text")
    norm = normalised(F.col("text"))
    state_dir = state_dir or shared_path(spark, "dedup-state")
    # Beside the state, a folder for each run: the stream goes on where it stopped, whatever came before.
    table = f"{state_dir.rstrip('/')}-arrivals"
    arrivals = written(
        content.select(
            "doc_id",
            "place",
            F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"),
            digest(norm).alias("digest"),
            sha256(norm).alias("text_sha256"),
        ),
        "dedup-arrivals",
        f"{table}/run={uuid.uuid4().hex}",
    )
    if arrivals.isEmpty():
        return arrivals.select(
            "doc_id",
            F.col("doc_id").alias("keep_id"),
            F.lit(0).cast("long").alias("group_size"),
            F.lit(True).alias("kept"),
            "text_sha256",
            "place",
        )
    found = _state(spark, table, arrivals.schema, state_dir, files_per_trigger)
    groups_at = shared_path(spark, "dedup-groups")
    schema = written(found.select("digest", F.col("n").alias("group_size"), "first"), "dedup-groups", groups_at).schema
    state = spark.read.schema(schema).parquet(groups_at)
    rows = arrivals.join(state, "digest", "left")

    # Full bytes on hits: one smallest and one largest text per task and digest that came more than once.
    hits = written(
        arrivals.join(state.filter("group_size > 1").select("digest"), "digest", "left_semi").select(
            "place", "digest", F.xxhash64("place").alias("spot")
        ),
        "dedup-hits",
        fewer=4,
    )
    texts = content.select("place", norm.alias("norm"))
    if hits.count() <= HITS_BROADCAST:
        texts = texts.join(F.broadcast(hits.select("spot")), F.xxhash64("place") == F.col("spot"), "left_semi")
    compared = hits.select("place", "digest").join(texts, "place").select("digest", "norm")
    # Rows that stay from earlier runs are read where their locators say.
    earlier = written(
        hits.select("digest").distinct().join(state, "digest").select("digest", F.col("first.place").alias("place"))
        .join(hits.select("place"), "place", "left_anti"),
        "dedup-earlier",
        fewer=8,
    )
    files = [r[0] for r in earlier.select("place.file").distinct().collect()]  # file names, not rows
    if files:
        old = located(spark.read.parquet(*files), "text").select("place", norm.alias("norm"))
        compared = compared.unionByName(earlier.join(old, "place").select("digest", "norm"))
    mixed = written(
        compared.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
        .filter("low <> high").select("digest"),
        "dedup-mixed",
        fewer=8,
    )
    if files and not mixed.isEmpty():
        raise ValueError("the digest joins different texts of different runs: it needs more bits")
    if mixed.isEmpty():
        whole = rows
        apart = None
    else:
        whole = rows.join(mixed, "digest", "left_anti")
        among = arrivals.join(mixed, "digest", "left_semi").join(texts, "place")
        groups = among.groupBy("digest", "norm").agg(
            F.count(F.lit(1)).alias("group_size"), F.min(_stays()).alias("first")
        )
        apart = among.join(groups, ["digest", "norm"]).select(*rows.columns)
    out = whole if apart is None else whole.select(*rows.columns).unionByName(apart)
    return out.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("first.place") == F.col("place")).alias("kept"),
        "text_sha256",
        "place",
    )
