"""Cutting lineage with tables in the folder that all executors share."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a folder in the warehouse.

    Both are shared on a cluster, and the choice does not depend on the master.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir")
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_caseweave"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/caseweave-{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, whatever store it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as a table and return the table: later stages start from the files,
    so a lost executor costs a re-read and plans do not grow from round to round."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def drop(table: DataFrame) -> None:
    """Delete what ``cut`` wrote; only when nothing reads it any more."""
    remove(table.sparkSession, table.cut_path)


class Rounds:
    """State of an iteration: each round is a table, and a table goes once its successor is written."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.path = spark, label, None

    def cut(self, df: DataFrame) -> DataFrame:
        old, self.path = self.path, scratch_path(self.spark, self.label)
        df.write.parquet(self.path)
        if old is not None:
            remove(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(self.path)

    def close(self) -> None:
        """Drop the last round too; only when nothing reads it any more."""
        if self.path is not None:
            remove(self.spark, self.path)
            self.path = None
