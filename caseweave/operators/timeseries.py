"""Dense weekly series, the history gate, seasonal-naive errors."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.temporal import week_start

MIN_WEEKS = 80
MIN_TOTAL = 30


def weekly(df: DataFrame, ts: str, by: Sequence[str] = (), name: str = "n") -> DataFrame:
    """Counts per Monday week from the first to the last week of each series, gaps are 0.

    Every week emits itself and the empty weeks up to the next one, so the dense series
    needs no calendar and no second join.
    """
    counts = df.groupBy(*by, week_start(ts).alias("week")).agg(F.count(F.lit(1)).alias(name))
    nxt = F.lead("week").over(Window.partitionBy(*by).orderBy("week"))
    last = F.greatest(F.col("week"), F.date_sub(F.coalesce(nxt, F.date_add("week", 7)), 7))
    filled = counts.withColumn("_last", last)
    return filled.select(*by, "week", name, F.explode(F.sequence("week", "_last", F.expr("INTERVAL 7 DAYS"))).alias("_w")).select(
        *by, F.col("_w").alias("week"), F.when(F.col("_w") == F.col("week"), F.col(name)).otherwise(F.lit(0)).alias(name))


def history_gate(series: DataFrame, by: Sequence[str], name: str = "n", min_weeks: int = MIN_WEEKS,
                 min_total: int = MIN_TOTAL) -> DataFrame:
    """(weeks, total, status) per series; thin histories are marked, not dropped."""
    return series.groupBy(*by).agg(F.count(F.lit(1)).alias("weeks"), F.sum(name).alias("total")).withColumn(
        "status", F.when((F.col("weeks") < min_weeks) | (F.col("total") < min_total), "insufficient history").otherwise("ok"))


def last_n(series: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The last n weeks of every series."""
    return (series.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("week"))))
            .where(F.col("_r") <= n).drop("_r"))


def seasonal_naive(series: DataFrame, by: Sequence[str], name: str = "n", lag: int = 52, holdout: int = 8) -> DataFrame:
    """Mean absolute error of 'same week one season earlier' over the last weeks.

    NULL where the series is not longer than holdout + lag.
    """
    order = Window.partitionBy(*by).orderBy("week")
    rows = (series.withColumn("_pred", F.lag(name, lag).over(order))
            .withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("week")))))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("weeks"),
        F.avg(F.when(F.col("_r") <= holdout, F.abs(F.col(name) - F.col("_pred")))).alias("_mae"))
    return out.select(*by, "weeks", F.when(F.col("weeks") > holdout + lag, F.col("_mae")).alias("baseline_mae"))
