"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, prefix: str = "souklens") -> str:
    """A new path below the folder of spark.checkpoint.dir. Only a local master, whose executors are the driver, may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes what is at path, if anything, through Hadoop's file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The intermediate tables of one run, as Parquet: a lost executor costs no more than the step that reads them.

    done() deletes tables whose readers have been written themselves; what a returned DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession, prefix: str = "scratch"):
        self.spark, self.folder, self.paths = spark, shared_folder(spark, prefix), {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def done(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, self.paths[id(t)][0])
