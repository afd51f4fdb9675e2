"""Session helpers.

The library never creates its own cluster settings beyond what a local test
needs: a session that already exists (cluster, notebook) is used as is.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings for a local test session.  On a cluster these come from the
# cluster's own configuration, and ``get_session`` returns the active session.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def get_session(master: str | None = None, app_name: str = "tabforge") -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("TABFORGE_MASTER", "local[8]"))
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster).  Only when it is
    unset on a local master (tests) is a fresh scratch folder made and
    registered; on a cluster an unset folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            # a machine-local folder would not survive the loss of an executor
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, object store) on a cluster")
        d = tempfile.mkdtemp(prefix="tabforge-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Prepare the input of a multi-pass operator.

    A narrow input (fewer partitions than the cluster's parallelism, e.g. one
    large file with a single row group) is spread round-robin once and
    persisted (memory and disk), so the following passes run in parallel and
    read it once.  A wide input is returned as it is: no shuffle, and each
    pass reads only the Parquet columns it needs.  Call ``release`` when done.
    """
    from pyspark import StorageLevel
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par).persist(StorageLevel.MEMORY_AND_DISK)
    return df


def release(df: DataFrame) -> None:
    if df.is_cached:
        df.unpersist()
