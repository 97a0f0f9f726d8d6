"""Tables that are replaced as a whole without a moment at which readers find none.

Every save writes a folder of its own, ``v=00000001``, ``v=00000002``, …, and marks it
complete as its last step. Readers take the newest complete version and keep reading it
whatever is saved meanwhile; a save that fails leaves no mark and changes nothing for them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.lineage import remove

MARK = "_COMPLETE"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _child(spark: SparkSession, path: str, *names: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *names]))


def _folders(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def _folder(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/v={version:08d}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first."""
    fs, _ = _fs(spark, path)
    return [v for v in _folders(spark, path) if fs.exists(_child(spark, _folder(path, v), MARK))]


def save(df: DataFrame, path: str, keep: int = 3) -> int:
    """Write ``df`` as the next version; of the complete ones the newest ``keep`` stay, and folders that failed go.

    One writer at a time: a rescan is a single job.
    """
    spark = df.sparkSession
    version = max(_folders(spark, path), default=0) + 1
    df.write.parquet(_folder(path, version))
    fs, _ = _fs(spark, path)
    fs.create(_child(spark, _folder(path, version), MARK), True).close()
    stay = set(versions(spark, path)[-max(1, keep):])
    for old in _folders(spark, path):
        if old < version and old not in stay:
            remove(spark, _folder(path, old))
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest complete version, or the one asked for."""
    there = versions(spark, path)
    if not there or (version is not None and version not in there):
        raise FileNotFoundError(f"no complete version {'' if version is None else version} under {path}")
    return spark.read.parquet(_folder(path, there[-1] if version is None else version))
