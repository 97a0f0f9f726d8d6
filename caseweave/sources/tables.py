"""Table sources and sinks: explicit schemas, lenient dates, CSV and JSON exchange."""
from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.temporal import lenient_date, lenient_timestamp


def read_tables(spark: SparkSession, folder: str, schemas: Mapping[str, T.StructType | str | None],
                fmt: str = "parquet") -> dict[str, DataFrame]:
    """One DataFrame per table; names starting with '_' are skipped."""
    out = {}
    for name, schema in schemas.items():
        if name.startswith("_"):
            continue
        reader = spark.read.schema(schema) if schema is not None else spark.read
        out[name] = reader.format(fmt).load(f"{folder.rstrip('/')}/{name}.{fmt}")
    return out


def register(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        if not name.startswith("_"):
            df.createOrReplaceTempView(name)


def coerce_temporal(df: DataFrame, dates: Iterable[str] = (), timestamps: Iterable[str] = ()) -> DataFrame:
    """Text columns to dates and timestamps; unreadable values become NULL."""
    return df.withColumns({**{c: lenient_date(c) for c in dates},
                           **{c: lenient_timestamp(c) for c in timestamps}})


def read_csv(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """CSV with a header, every column as text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    # multiLine keeps quoted line breaks; escape='"' reads doubled quotes.
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which is what CSV can hold."""
    nested = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def vectors_from_json(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.from_json(column, "array<double>"))


def export_csv(tables: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        if not name.startswith("_"):
            (_flat(df).write.mode("overwrite").option("header", True).option("escape", '"')
             .csv(f"{folder.rstrip('/')}/{name}.csv"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def load_into_catalog(spark: SparkSession, folder: str, columns: Mapping[str, Iterable[str]],
                      truncate: bool = False, only: Iterable[str] | None = None) -> list[str]:
    """Load exported CSV tables into catalog tables; missing files are skipped.

    Returns the names that were loaded.
    """
    wanted = set(only) if only is not None else set(columns)
    loaded = []
    for name, cols in columns.items():
        path = f"{folder.rstrip('/')}/{name}.csv"
        if name not in wanted or not _exists(spark, path):
            continue
        read_csv(spark, path, cols).write.mode("overwrite" if truncate else "append").saveAsTable(name)
        loaded.append(name)
    return loaded


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_case_vectors(features: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Persist vectors and features per case; facts are partitioned by a coarse column."""
    writer = features.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def status(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """One row per table: does it exist, and how many rows does it hold."""
    parts = []
    for name in names:
        if spark.catalog.tableExists(name):
            parts.append(spark.table(name).agg(F.count(F.lit(1)).alias("row_count"))
                         .select(F.lit(name).alias("table_name"), F.lit(True).alias("present"), "row_count"))
        else:
            parts.append(spark.range(1).select(F.lit(name).alias("table_name"), F.lit(False).alias("present"),
                                               F.lit(0).cast("long").alias("row_count")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
