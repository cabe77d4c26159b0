"""Session helpers.

Cluster settings (shuffle partitions, executor memory, checkpoint folder)
belong to whoever launches the job. ``get_session`` only fills in defaults
that are unset, which is what tests and the local bench need.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults for a local run. On a cluster these come from spark-submit and
# ``builder.config`` does not override an existing session's settings.
LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # iterative jobs write a reliable checkpoint per step: remove the files of
    # steps that are no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # session-window state of the debounce stream lives off-heap in RocksDB,
    # so long quiet periods over many projects do not fill the executor heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "fleetlens") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("FLEETLENS_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of this session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, S3, ...)
    and is used as is; without it a cluster's session is refused, since a
    folder of the driver is not visible to the executors. Only a local
    session (tests, bench) gets a fresh folder under the system temp
    directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="fleetlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def written(df, name: str):
    """Write ``df`` as Parquet below the shared checkpoint folder and return
    the re-read table: as durable as ``materialize``, and its size is known to
    the planner and its columns stay prunable."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df):
    """Write ``df`` to the reliable checkpoint folder and return the
    re-read DataFrame. Used where one intermediate result feeds several
    branches of a plan (Catalyst rewrites each branch differently, so the
    shuffle of a shared sub-plan is not reused) and to cut lineage in
    iterative jobs. Reliable checkpoints survive the loss of an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
