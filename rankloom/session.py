"""Session helpers: builder for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "rankloom") -> SparkSession:
    """A session configured the way the jobs expect (UTC, AQE, Arrow)."""
    cores = master[6:-1] if master and master.startswith("local[") else ""
    parts = shuffle_partitions or (int(cores) if cores.isdigit() else None)
    builder = SparkSession.builder
    if master:  # else spark-submit's
        builder = builder.master(master)
    if parts:  # else the cluster's
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    builder = (
        builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RANKLOOM_DRIVER_MEMORY", "16g"))
        # one BLAS thread per Python worker: tasks already use every core
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .config("spark.executorEnv.MKL_NUM_THREADS", "1")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only when the cluster named none.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used as is;
    a private temporary folder is only chosen when nothing is configured (tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
    if not conf_dir:  # one machine: tests and trials
        conf_dir = tempfile.mkdtemp(prefix="rankloom-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


#: rows up to which a table may be sent to the driver and every executor
BROADCAST_ROWS = 1 << 19


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table that a job wrote; one of many rows is joined by shuffle only.

    Spark takes the size of the compressed files for that of the rows, so that flags and
    sorted ids of millions of rows (some MB) would pass through the driver as hundreds of MB.
    """
    table = spark.read.parquet(path)
    return table if table.count() <= BROADCAST_ROWS else table.hint("merge")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder for tables written by a job."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "rankloom", *parts])
