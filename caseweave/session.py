"""Session defaults for local runs; a cluster passes its own configuration."""
from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a step's shuffle files go when it ends; steps that are read again are tables (plans.lineage)
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", app: str = "caseweave", **conf) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {**DEFAULTS, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on; safe to call on any session."""
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
                "spark.sql.adaptive.skewJoin.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"):
        spark.conf.set(key, DEFAULTS[key])
    return spark
