"""Streaming jobs. Each takes a streaming DataFrame and returns a query or a writer, so the
same code runs on files, Kafka or a rate source, and with any trigger."""
from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.lineage import remove

WINDOW, SLIDE, DELAY = "14 days", "1 day", "2 days"


def read_files(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet", fmt: str = "parquet",
               files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder whose names match ``glob``."""
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def window_counts(events: DataFrame, ts: str, by: Sequence[str], window: str = WINDOW, slide: str = SLIDE, delay: str = DELAY) -> DataFrame:
    """Rows per key and sliding window. On a stream the watermark bounds the state to the
    windows still open; on a table the same plan is its batch twin."""
    source = events.withWatermark(ts, delay) if events.isStreaming else events
    return source.groupBy(F.window(ts, window, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partition_by: str | None = None) -> StreamingQuery:
    """Process what is there, exactly once per checkpoint, and stop."""
    writer = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return writer.trigger(availableNow=True).start(path)


def deduplicated_audit(audit: DataFrame, key: str = "audit_id", ts: str = "ts", delay: str = DELAY) -> DataFrame:
    """Audit rows once per id; ids are remembered only for the length of the watermark."""
    return audit.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key]).withColumn("day", F.to_date(ts))


class DayCounts:
    """Rows per group and day of all batches so far, kept as tables: the memory of a sweep.

    A batch writes its own counts to a folder named by its id, so a batch that is repeated
    replaces them and counts once. Every ``fold_every`` batches all counts up to there are
    folded into one table, from which later batches go on; the folders stay small and few.
    """

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str], ts: str, fold_every: int = 50):
        self.spark, self.path, self.by, self.ts, self.fold_every = spark, path.rstrip("/"), list(by), ts, fold_every

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _summed(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.by, "day").agg(F.sum("n").alias("n"))

    def add(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Remember ``batch`` and return (by…, day, n) of every batch up to it."""
        new = batch.groupBy(*self.by, F.to_date(self.ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
        new.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        folded = batch_id - batch_id % self.fold_every  # batches before this one lie in one table
        parts = [self._read(f"batch={i}") for i in range(folded, batch_id + 1)]
        if folded:
            parts.append(self._read(f"upto={folded}"))
        out = self._summed(functools.reduce(DataFrame.unionByName, parts))
        if (batch_id + 1) % self.fold_every == 0:
            out.write.mode("overwrite").parquet(f"{self.path}/upto={batch_id + 1}")
            for i in range(max(0, folded - self.fold_every), folded):  # only the last batch is ever repeated
                remove(self.spark, f"{self.path}/batch={i}")
            return self._read(f"upto={batch_id + 1}")
        return out


def remembering_sweep(stream: DataFrame, ts: str, by: Sequence[str], detector: Callable[[DataFrame, int], DataFrame], store: str,
                      path: str, checkpoint: str, fold_every: int = 50) -> StreamingQuery:
    """Run a detector over the day counts of everything seen so far, after every slice of new rows.

    ``detector`` gets (by…, day, n) and the batch id. Its leads go to one folder per batch;
    see latest_leads. Counts and leads of a batch that is retried replace its own.
    """
    counts = DayCounts(stream.sparkSession, store, by, ts, fold_every)

    def handle(batch: DataFrame, batch_id: int) -> None:
        detector(counts.add(batch, batch_id), batch_id).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_leads(spark: SparkSession, path: str) -> DataFrame:
    """The leads of the last slice that was swept."""
    leads = spark.read.parquet(path)
    return leads.where(F.col("batch_id") == leads.agg(F.max("batch_id").alias("last")).scalar()).drop("batch_id")


def sweep(stream: DataFrame, detector: Callable[[DataFrame, int], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run a batch detector over each slice of new rows alone; leads go to one folder per batch,
    so a batch that is retried replaces its own output. For detectors that need what came
    before see remembering_sweep."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        detector(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
