"""Lead detectors: sudden rises, growing series, repeat patterns near home."""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from ..plans.lineage import cut
from .ranking import numbered
from .spatial import within_km


def _date(d: dt.date) -> Column:
    return F.lit(d.isoformat()).cast("date")


def spike_counts(df: DataFrame, ts: str, by: Sequence[str], as_of: dt.date, window_days: int,
                 history_by: Sequence[str] | None = None, weight: str | None = None) -> DataFrame:
    """recent and history counts per group in one pass; history may use fewer columns.

    ``weight`` names a column that says how many events a row stands for.
    """
    cutoff = _date(as_of - dt.timedelta(days=window_days))
    late = F.col(ts).cast("date") > cutoff
    n = F.lit(1) if weight is None else F.col(weight)
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    counts = df.groupBy(*by).agg(total(late).alias("recent"), total(~late).alias("history"))
    if history_by is not None and list(history_by) != list(by):
        counts = counts.withColumn("history", F.sum("history").over(Window.partitionBy(*history_by)))
    return counts


def spikes(df: DataFrame, ts: str, by: Sequence[str], as_of: dt.date, start: dt.date, window_days: int = 14,
           min_recent: int = 6, z_min: float = 3.0, top: int | None = 8,
           history_by: Sequence[str] | None = None, weight: str | None = None) -> DataFrame:
    """Groups whose weekly rate in the last days lies far above their own history."""
    weeks = max(((as_of - dt.timedelta(days=window_days)) - start).days / 7.0, 1.0)
    counts = spike_counts(df, ts, by, as_of, window_days, history_by, weight).where(F.col("recent") >= min_recent)
    base = F.col("history") / F.lit(weeks)
    rate = F.col("recent") / F.lit(window_days / 7.0)
    z = (rate - base) / F.greatest(F.sqrt(base), F.lit(0.5))
    out = (counts.withColumn("z", z).where(F.col("z") >= z_min)
           .withColumn("ratio", rate / F.greatest(base, F.lit(0.3)))
           .withColumn("confidence", F.round(F.least(F.lit(0.95), 0.6 + F.col("z") / 30), 2)))
    return out if top is None else out.orderBy(F.desc("z"), *by).limit(top)


def spike_rows(df: DataFrame, leads: DataFrame, key: str, ts: str, by: Sequence[str], as_of: dt.date,
               window_days: int = 14) -> DataFrame:
    """The recent rows behind each spike, as a child table (group columns, key)."""
    recent = df.where(F.col(ts).cast("date") > _date(as_of - dt.timedelta(days=window_days)))
    return recent.join(leads.select(*by), list(by), "left_semi").select(*by, key)


def growth(members: DataFrame, cases: DataFrame, as_of: dt.date, series: str = "series_id", case: str = "case_id",
           ts: str = "registered", window_days: int = 14, min_new: int = 2) -> DataFrame:
    """Series that took in at least ``min_new`` members in the last days."""
    recent = cases.where(F.col(ts) > _date(as_of - dt.timedelta(days=window_days))).select(case)
    return members.join(recent, case).groupBy(series).agg(F.count(F.lit(1)).alias("new_cases")).where(
        F.col("new_cases") >= min_new)


def repeat_candidates(history: DataFrame, arrested: DataFrame, homes: DataFrame, as_of: dt.date,
                      person: str = "person_key", kind: str = "crime_sub_head", ts: str = "registered",
                      min_priors: int = 3, quiet_days: int = 60, min_kind: int = 2) -> DataFrame:
    """(person, kind) of arrested persons with a known home, enough priors and no recent case.

    One aggregation by (person, kind); the person totals are sums over those few rows.
    """
    per_kind = history.groupBy(person, kind).agg(F.count(F.lit(1)).alias("priors"), F.max(ts).alias("last_seen"))
    w = Window.partitionBy(person)
    totals = per_kind.withColumn("_all", F.sum("priors").over(w)).withColumn("_last", F.max("last_seen").over(w))
    kept = totals.where((F.col("_all") >= min_priors) & (F.col("priors") >= min_kind)
                        & (F.col("_last") <= _date(as_of - dt.timedelta(days=quiet_days))))
    return (kept.join(arrested.select(person), person, "left_semi").join(homes, person)
            .select(person, kind, "home_cell"))


def repeat_pattern(candidates: DataFrame, fresh: DataFrame, person: str = "person_key", kind: str = "crime_sub_head",
                   lat: str = "latitude", lon: str = "longitude", km: float = 3.0, min_near: int = 4) -> DataFrame:
    """Persons with enough fresh unsolved cases of their kinds near their home.

    Homes that share a cell share its centre, and cases at one place share coordinates. So
    the radius join runs between distinct (cell, kind) and distinct (place, kind) with
    counts, and neither a popular cell nor a popular place multiplies rows. Both inputs
    are written first: the candidates are read twice, and the optimizer sees plain columns.
    """
    candidates = cut(candidates, "candidates")
    places = cut(fresh.groupBy(kind, lat, lon).agg(F.count(F.lit(1)).alias("_n")), "places")
    cells = candidates.select("home_cell", kind).distinct().withColumn("_c", geo.hex_centre("home_cell"))
    cells = cells.select("home_cell", F.col(kind).alias("_kind"), F.col("_c.lat").alias("_clat"), F.col("_c.lon").alias("_clon"))
    near = within_km(places, cells, km, lat, lon, "_clat", "_clon", also=((kind, "_kind"),))
    per_cell = near.groupBy("home_cell", F.col("_kind").alias(kind)).agg(F.sum("_n").alias("_near"))
    return (candidates.join(per_cell, ["home_cell", kind]).groupBy(person).agg(F.sum("_near").alias("near"))
            .where(F.col("near") >= min_near)
            .withColumn("confidence", F.round(F.least(F.lit(0.9), 0.6 + 0.1 * F.col("near")), 2)))


def fresh_unsolved(cases: DataFrame, as_of: dt.date, open_status: str, ts: str = "registered", days: int = 45) -> DataFrame:
    """Open cases of the last days without any accused."""
    return cases.where((F.col("case_status") == open_status) & (F.col("accused_count") == 0)
                       & (F.col(ts) > _date(as_of - dt.timedelta(days=days))))


LEAD_COLUMNS = ("type", "subject", "metric", "value", "confidence")


def as_leads(df: DataFrame, kind: str, order: int, subject: Column, metric: str, value: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), F.lit(order).alias("_order"), subject.alias("subject"),
                     F.lit(metric).alias("metric"), value.cast("double").alias("value"),
                     F.col("confidence").cast("double").alias("confidence"))


def combine(leads: Sequence[DataFrame], as_of: dt.date) -> DataFrame:
    """One numbered list of leads, stamped with the reference date."""
    out = leads[0]
    for nxt in leads[1:]:
        out = out.unionByName(nxt, allowMissingColumns=True)
    ranked = numbered(out, ["_order", F.desc("value"), "subject"], "L-%d", "lead_id",
                      bucket=F.struct("_order", (-F.floor(F.col("value"))).alias("b")))
    return ranked.select("lead_id", *LEAD_COLUMNS, _date(as_of).alias("created_at"))


