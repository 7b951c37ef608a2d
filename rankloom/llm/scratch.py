"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from rankloom.session import scratch_path


class Scratch:
    """Tables of one job: written as Parquet, reread without lineage, dropped when used up."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = scratch_path(spark, "llm", f"{job}-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            at = hadoop.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of frames that nothing refers to any more."""
        # the last job's frames are only let go while later calls run, so one collection isn't enough
        for _ in range(3):
            gc.collect()
            self.spark._jvm.System.gc()
            self.spark.range(1).collect()
            time.sleep(0.3)
