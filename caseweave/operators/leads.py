"""Whole leads: what was found, where, how sure, what to do, and the records behind it.

A detector's leads are two tables: ``leads`` has one row per lead, ``evidence`` one row per
(lead, record). Evidence stays a child table, so a lead may rest on any number of records.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fx, geo
from ..functions.rounding import python_round
from ..plans.lineage import cut
from .detect import _date
from .ranking import numbered
from .spatial import within_km


@dataclass(frozen=True)
class Leads:
    """leads(type, subject, ...) and evidence(type, subject, case); ``subject`` names the finding within its type."""
    leads: DataFrame
    evidence: DataFrame


COLUMNS = ("type", "subject", "title", "metric", "value", "window", "confidence", "suggested_action", "district")


def _lead(df: DataFrame, kind: str, subject: Column, value: Column, window: str, confidence: Column, district: Column,
          title: Column, action: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), subject.alias("subject"), title.alias("title"), F.lit(fx.LEAD_METRICS[kind]).alias("metric"),
                     value.cast("double").alias("value"), F.lit(window).alias("window"), confidence.cast("double").alias("confidence"),
                     action.alias("suggested_action"), district.alias("district"))


def spike_leads(spikes: DataFrame, cases: DataFrame, as_of: dt.date, station: str = "police_station", district: str = "district",
                kind: str = "crime_sub_head", case: str = "case_id", ts: str = "registered", window_days: int = 14) -> Leads:
    """Leads of ``detect.spikes`` by station, district and kind.

    The records are the recent cases of the station and kind, whatever their district, as
    the history that the spike was measured against is.
    """
    spikes = cut(spikes, "spikes")  # short, and read for the leads and for the evidence
    subject = lambda *cols: F.concat_ws(" / ", *cols)
    leads = _lead(spikes, "spike", subject(station, district, kind), python_round("z", 1), fx.LEAD_WINDOW % window_days, F.col("confidence"),
                  F.col(district), F.format_string(fx.LEAD_SPIKE_TITLE, F.col(kind), python_round("ratio", 1), F.col(station)),
                  F.format_string(fx.LEAD_SPIKE_ACTION, F.col(station)))
    recent = cases.where(F.col(ts).cast("date") > _date(as_of - dt.timedelta(days=window_days))).select(station, kind, case)
    rows = recent.join(spikes.select(station, district, kind), [station, kind])
    return Leads(leads, rows.select(F.lit("spike").alias("type"), subject(station, district, kind).alias("subject"), case))


def repeat_rows(candidates: DataFrame, fresh: DataFrame, person: str = "person_key", kind: str = "crime_sub_head", case: str = "case_id",
                lat: str = "latitude", lon: str = "longitude", km: float = 3.0) -> DataFrame:
    """(person, case): the fresh cases of a candidate's kinds near their home.

    Homes that share a cell share its centre and cases share places, so the radius join
    runs between distinct cells and distinct places; records are attached after it.
    """
    cells = candidates.select("home_cell", kind).distinct().withColumn("_c", geo.hex_centre("home_cell"))
    cells = cells.select("home_cell", F.col(kind).alias("_kind"), F.col("_c.lat").alias("_clat"), F.col("_c.lon").alias("_clon"))
    near = within_km(fresh.select(kind, lat, lon).distinct(), cells, km, lat, lon, "_clat", "_clon", also=((kind, "_kind"),))
    near = near.select("home_cell", F.col("_kind").alias(kind), lat, lon)
    return candidates.join(near, ["home_cell", kind]).join(fresh.select(case, kind, lat, lon), [kind, lat, lon]).select(person, case)


def repeat_leads(candidates: DataFrame, fresh: DataFrame, persons: DataFrame, person: str = "person_key", name: str = "full_name",
                 district: str = "district", case: str = "case_id", km: float = 3.0, min_near: int = 4, days: int = 45) -> Leads:
    """Arrested persons, now quiet, with enough fresh unsolved cases of their kinds near home.

    ``persons`` is (person, name, district); a person without a row or a name is called by
    the key. ``fresh`` should hold the last ``days``.
    """
    found = cut(repeat_rows(cut(candidates, "candidates"), cut(fresh, "fresh"), person, case=case, km=km), "repeat-rows")
    counts = found.groupBy(person).agg(F.count(F.lit(1)).alias("near")).where(F.col("near") >= min_near)
    counts = cut(counts.join(persons.select(person, name, district), person, "left"), "repeat-leads")
    called = F.coalesce(F.col(name), F.col(person).cast("string"))
    leads = _lead(counts, "repeat_offender", F.col(person).cast("string"), F.col("near"), fx.LEAD_WINDOW % days,
                  F.round(F.least(F.lit(0.9), 0.6 + 0.1 * F.col("near")), 2), F.col(district),
                  F.format_string(fx.LEAD_REPEAT_TITLE, called), F.format_string(fx.LEAD_REPEAT_ACTION, called, F.col("near")))
    rows = found.join(counts.select(person), person, "left_semi")
    return Leads(leads, rows.select(F.lit("repeat_offender").alias("type"), F.col(person).cast("string").alias("subject"), case))


def growth_leads(series: DataFrame, members: DataFrame, cases: DataFrame, as_of: dt.date, key: str = "series_id", kind: str = "crime_sub_head",
                 districts: str = "districts", case: str = "case_id", ts: str = "registered", window_days: int = 14, min_new: int = 2) -> Leads:
    """Series that took in at least ``min_new`` members in the last days.

    ``series`` is (key, kind, districts array, confidence); the first district is the lead's. All members are the evidence.
    """
    recent = cases.where(F.col(ts) > _date(as_of - dt.timedelta(days=window_days))).select(case)
    new = members.join(recent, case, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("new")).where(F.col("new") >= min_new)
    grown = cut(series.select(key, kind, districts, "confidence").join(new, key), "grown")
    leads = _lead(grown, "series_growth", F.col(key), F.col("new"), fx.LEAD_WINDOW % window_days, F.col("confidence"),
                  F.coalesce(F.get(districts, F.lit(0)), F.lit("")), F.format_string(fx.LEAD_GROWTH_TITLE, key, "new"),
                  F.format_string(fx.LEAD_GROWTH_ACTION, key, kind))
    rows = members.join(grown.select(key), key, "left_semi")
    return Leads(leads, rows.select(F.lit("series_growth").alias("type"), F.col(key).alias("subject"), case))


def combine(found: Sequence[Leads], as_of: dt.date, case: str = "case_id") -> Leads:
    """Numbered leads in the order of the detectors given, the strongest of each first, and (lead_id, case).

    Ids are given bucket by bucket, so a detector with very many leads is not sorted in one task.
    """
    leads = evidence = None
    for at, one in enumerate(found):
        rows = one.leads.select(F.lit(at).alias("_order"), *COLUMNS)
        leads = rows if leads is None else leads.unionByName(rows)
        evidence = one.evidence if evidence is None else evidence.unionByName(one.evidence)
    ranked = cut(numbered(leads, ["_order", F.desc("value"), "subject"], "L-%d", "lead_id",
                          bucket=F.struct("_order", (-F.floor(F.col("value"))).alias("b"))), "leads")
    return Leads(ranked.select("lead_id", *COLUMNS, _date(as_of).alias("created_at")),
                 evidence.join(ranked.select("lead_id", "type", "subject"), ["type", "subject"]).select("lead_id", case))
