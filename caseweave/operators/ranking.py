"""Ordering, top-k, serial numbers and row caps."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.lineage import cut


def _order(by: Sequence[Column | str]) -> list:
    return [F.col(c) if isinstance(c, str) else c for c in by]


def top_k_per_group(df: DataFrame, group: Sequence[str], by: Sequence[Column | str], k: int,
                    rank: str | None = None) -> DataFrame:
    """The first k rows of each group. Spark keeps k rows per group and map task before
    the shuffle (WindowGroupLimit), so a hot group does not travel whole."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*_order(by))))
    out = out.where(F.col(name) <= k)
    return out if rank else out.drop(name)


def serial_within(df: DataFrame, group: Sequence[str], by: Sequence[Column | str], name: str = "serial",
                  bucket: Column | None = None) -> DataFrame:
    """Gapless 1..n per group in the given order.

    ``bucket`` is a column that never decreases along the order (an id divided by a
    constant, the month of a date). With it each group is numbered bucket by bucket in
    separate tasks and shifted by the row counts of the earlier buckets, so a group that
    holds a large part of the table is not sorted in one task.
    """
    order = _order(by)
    if bucket is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    parts = df.withColumn("_bucket", bucket)
    local = parts.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)))
    counts = parts.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*group, "_bucket", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    on = F.col("l._bucket").eqNullSafe(F.col("r._bucket"))
    for g in group:
        on = on & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    return local.alias("l").join(shift.alias("r"), on).select(
        *[F.col(f"l.{c}") for c in df.columns], (F.col("l._n") + F.col("r._before")).cast("long").alias(name))


def numbered(df: DataFrame, by: Sequence[Column | str], pattern: str, name: str = "id",
             rank: str = "rank", bucket: Column | None = None) -> DataFrame:
    """Ids like SH-01 by rank. Short results (leads) need no bucket; for long ones pass a
    column that never decreases along the order, see serial_within."""
    return serial_within(df, [], by, rank, bucket).withColumn(name, F.format_string(pattern, F.col(rank)))


def capped(df: DataFrame, cap: int) -> tuple[DataFrame, bool]:
    """At most ``cap`` rows, and whether there were more. The plan runs once: its first cap + 1 rows are written."""
    probe = cut(df.limit(cap + 1).withColumn("_nth", F.monotonically_increasing_id()), "capped")
    return probe.where(F.col("_nth") < cap).drop("_nth"), probe.count() > cap


def with_truncated(df: DataFrame, cap: int, name: str = "truncated") -> DataFrame:
    """At most ``cap`` rows, each with a column that tells whether there were more; Spark counts the rows up to cap + 1."""
    probe = cut(df.limit(cap + 1).withColumn("_nth", F.monotonically_increasing_id()), "capped")
    more = probe.agg((F.count(F.lit(1)) > cap).alias("_more"))
    return probe.where(F.col("_nth") < cap).drop("_nth").withColumn(name, more.scalar())


def two_phase_top(df: DataFrame, coarse: Sequence[Column | str], prefilter: int | None, score: Column,
                  k: int, tie: Sequence[str], name: str = "score") -> DataFrame:
    """Keep ``prefilter`` rows by a cheap order (None keeps all), score them, keep the k best."""
    short = df if prefilter is None else df.orderBy(*_order(coarse)).limit(prefilter)
    return short.withColumn(name, score).orderBy(F.desc(name), *tie).limit(k)
