"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every kpiframe job relies on.  UTC keeps timestamp_ntz buckets and
# their labels stable; AQE coalesces the small post-aggregation shuffles and
# splits skewed partitions of the big ones.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # per-request group tables are checkpointed; remove their files once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app_name: str = "kpiframe") -> SparkSession:
    """Build (or reuse) a session with kpiframe's defaults.

    On a cluster, pass nothing: master, memory and partition counts come from
    spark-submit.  Locally (tests, bench) give ``master="local[8]"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it only where it is unset.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    always used.  Only a local-mode session without one (tests, bench) gets a
    private scratch folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a shared folder (HDFS/S3/...) that every executor can read"
        )
    folder = tempfile.mkdtemp(prefix="kpiframe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def is_single(df) -> bool:
    """Whether ``df`` is known, from its plan alone, to come out of one task (no job runs)."""
    return df._jdf.queryExecution().sparkPlan().outputPartitioning().toString() == "SinglePartition"


def materialize(df):
    """Write ``df`` to the checkpoint folder and return a DataFrame reading it.

    Used for the small aggregated tables (groups, group x fold parts,
    distinct-value counts) that several later steps read: the lineage back
    to the big scan is cut, a lost executor costs a re-read of the
    checkpoint files rather than a re-aggregation of the table, and no
    entry is left in the session's cache manager.

    A table that adaptive execution put into one partition stays in one (:func:`is_single`), so what follows
    needs no shuffle.
    """
    ensure_checkpoint_dir(df.sparkSession)
    pinned = df.checkpoint(eager=True)
    return pinned.coalesce(1) if pinned._jdf.rdd().getNumPartitions() <= 1 else pinned
