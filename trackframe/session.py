"""Spark session settings shared by jobs, tests and the benchmark.

The settings that matter at cluster scale:

* AQE on, with partition coalescing and skew-join splitting, so the shuffle
  partition count can be sized for the largest input and shrink at run time.
* ``spark.sql.requireAllClusterKeysForCoPartition=false``: every tracking
  operator keys on a superset of the play key (game_id, play_id).  Once a frame
  is hash-partitioned by the play key, windows and aggregates on the player
  key, the frame key and joins on the player key reuse that partitioning
  instead of shuffling again (see ``sources.tracking.cluster_by_play``).
* The checkpoint folder is read from ``spark.checkpoint.dir`` when the cluster
  names one; only a session without it (tests, local runs) gets a scratch one.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings above to an existing session."""
    for key, value in CLUSTER_CONF.items():
        if key in ("spark.ui.enabled", "spark.ui.showConsoleProgress"):
            continue
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Where none is named, a local session (one machine) gets a scratch one, and a
    cluster's is put into its warehouse, which driver and executors share."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if spark.sparkContext.master.startswith("local"):
        scratch = tempfile.mkdtemp(prefix="trackframe-ckpt-")
    else:
        scratch = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_trackframe_checkpoints"
    spark.conf.set("spark.checkpoint.dir", scratch)
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g", app: str = "trackframe") -> SparkSession:
    """A local session for tests and the benchmark (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.ansi.enabled", os.environ.get("TRACKFRAME_ANSI", "true"))
    )
    for key, value in CLUSTER_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def cut_lineage(df, partition_by: list[str] | None = None):
    """Materialise ``df`` as a reliable checkpoint in the session's checkpoint
    folder (shared storage on a cluster) and return the re-read frame.

    Used where one intermediate feeds many branches of a plan, so it is
    computed once and survives the loss of the executors that made it.  The
    re-read frame has no known partitioning; ``partition_by`` hashes it once
    more so every later join and aggregate on those keys stays local.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not partition_by:
        return df.checkpoint(eager=True)
    # The checkpoint records the hash partitioning of its plan only when that
    # plan is not adaptive (an adaptive plan reports an unknown partitioning),
    # so this one action runs with AQE off; readers then join and aggregate
    # on the keys without another shuffle.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(n, *partition_by).checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)
