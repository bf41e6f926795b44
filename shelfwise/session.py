"""Spark session and shared-storage helpers.

Every report is a pure function of DataFrames and an explicit ``as_of`` date, so the
session only pins what changes results (time zone, ANSI) and what changes plans (AQE).
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that affect results or plans. Sizes are defaults for the local test box;
# on a cluster the submitter's values win (``getOrCreate`` keeps an existing session).
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Streaming state (windows, de-duplication keys) off the JVM heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "shelfwise") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``; without one this is an error.

    No machine-local folder stands in for it: other executors could not read what is written there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder (never reused)."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared folder (never ``localCheckpoint``)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


# A write's shuffle files go as it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Writes in here drop their shuffle files as they end."""
    kept = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if kept is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, kept)


def rested(df, name: str):
    """``df`` written once as Parquet to the shared folder and read back: a compressed checkpoint.

    It leaves no shuffle files behind, and many small parts are read as few partitions."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with shuffles_cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
