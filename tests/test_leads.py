from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from caseweave.functions import geo
from caseweave.operators import detect, leads as ld, score

END = dt.date(2026, 7, 20)
CASES = "case_id int, registered date, police_station string, district string, crime_sub_head string"


def _spike(spark):
    """Two cases a month for two years at one station, ten in the last days; another station stays calm."""
    rows = [(i, dt.date(2024, 8, 1) + dt.timedelta(days=15 * i), "East", "City", "theft") for i in range(46)]
    rows += [(100 + i, END - dt.timedelta(days=i), "East", "City", "theft") for i in range(10)]
    rows += [(200, END, "East", "Other", "theft"), (201, END, "East", "City", "fraud"), (300, END, "West", "City", "theft")]
    cases = spark.createDataFrame(rows, CASES)
    by = ["police_station", "district", "crime_sub_head"]
    return ld.spike_leads(detect.spikes(cases, "registered", by, END, dt.date(2024, 8, 1), history_by=["police_station", "crime_sub_head"]), cases, END)


def _repeat(spark, name="Asha"):
    home = "8:100:200"
    lat, lon = spark.range(1).select(geo.hex_centre(F.lit(home)).alias("c")).select("c.lat", "c.lon").first()
    cand = spark.createDataFrame([("p", "burglary", home), ("p", "theft", home), ("q", "fraud", home)], "person_key string, crime_sub_head string, home_cell string")
    fresh = spark.createDataFrame([(500 + i, "burglary" if i % 2 else "theft", lat + 0.002 * (i // 3), lon) for i in range(6)]
                                  + [(510, "burglary", lat + 1, lon), (511, "fraud", lat, lon), (512, "theft", None, None)],
                                  "case_id int, crime_sub_head string, latitude double, longitude double")
    persons = spark.createDataFrame([("p", name, "City")], "person_key string, full_name string, district string")
    return ld.repeat_leads(cand, fresh, persons)


def _growth(spark):
    series = spark.createDataFrame([("SH-01", "theft", ["A", "B"], 0.7), ("SH-02", "fraud", [], 0.6), ("SH-03", "theft", ["C"], 0.6)],
                                   "series_id string, crime_sub_head string, districts array<string>, confidence double")
    members = spark.createDataFrame([("SH-01", 1), ("SH-01", 2), ("SH-01", 3), ("SH-02", 4), ("SH-02", 5), ("SH-03", 6)], "series_id string, case_id int")
    cases = spark.createDataFrame([(1, END), (2, END), (3, dt.date(2025, 1, 1)), (4, END), (5, END), (6, END)], "case_id int, registered date")
    return ld.growth_leads(series, members, cases, END)


def _rows(found):
    return {r["subject"]: r for r in found.leads.collect()}, {(r["subject"], r["case_id"]) for r in found.evidence.collect()}


def test_a_spike_names_its_station_and_cases(spark):
    leads, evidence = _rows(_spike(spark))
    assert list(leads) == ["East / City / theft"]
    lead = leads["East / City / theft"]
    assert lead["title"].startswith("theft ") and lead["title"].endswith("x baseline — East") and lead["value"] >= 3
    assert lead["district"] == "City" and lead["window"] == "last 14d" and "East" in lead["suggested_action"]
    # history ignores the district, so the records do too; an older case and another kind are no evidence
    assert {c for _, c in evidence} == {*range(100, 110), 200}


def test_a_repeat_lead_holds_its_cases(spark):
    leads, evidence = _rows(_repeat(spark))
    assert list(leads) == ["p"] and leads["p"]["value"] == 6 and leads["p"]["confidence"] == 0.9
    assert leads["p"]["title"] == "Possible re-offending by Asha near home turf" and leads["p"]["district"] == "City"
    assert evidence == {("p", 500 + i) for i in range(6)}
    assert _rows(_repeat(spark, None))[0]["p"]["title"] == "Possible re-offending by p near home turf"


def test_growth_needs_two_new_members(spark):
    leads, evidence = _rows(_growth(spark))
    assert set(leads) == {"SH-01", "SH-02"} and leads["SH-01"]["value"] == 2
    assert leads["SH-01"]["district"] == "A" and leads["SH-02"]["district"] == ""
    assert leads["SH-01"]["suggested_action"] == "Escalate SH-01 (theft) to a special team."
    assert {c for s, c in evidence if s == "SH-01"} == {1, 2, 3}


def test_combined_leads_are_numbered_and_keep_their_evidence(spark):
    parts = [_spike(spark), _repeat(spark), _growth(spark)]
    out = ld.combine(parts, END)
    rows = sorted(out.leads.collect(), key=lambda r: int(r["lead_id"][2:]))
    assert [r["lead_id"] for r in rows] == [f"L-{i}" for i in range(1, 5)]
    assert [r["type"] for r in rows] == ["spike", "repeat_offender", "series_growth", "series_growth"]
    assert [r["subject"] for r in rows][2:] == ["SH-01", "SH-02"] and {r["created_at"] for r in rows} == {END}
    assert set(out.leads.columns) == {"lead_id", *ld.COLUMNS, "created_at"}
    assert out.evidence.count() == sum(p.evidence.count() for p in parts)
    assert {r["lead_id"] for r in out.evidence.collect()} == {r["lead_id"] for r in rows}


def test_no_findings_give_no_leads(spark):
    cases = spark.createDataFrame([], CASES)
    spikes = detect.spikes(cases, "registered", ["police_station", "district", "crime_sub_head"], END, dt.date(2024, 1, 1))
    out = ld.combine([ld.spike_leads(spikes, cases, END)], END)
    assert out.leads.count() == 0 and out.evidence.count() == 0


def test_ranking_within_a_district_scores_the_whole_history(spark):
    rows = [("a", 1, "X"), ("a", 2, "X"), ("a", 3, "Y"), ("b", 4, "Y"), ("b", 5, "Y"), ("c", 6, "X")]
    history = spark.createDataFrame([(p, c, d, dt.date(2026, 7, 1), "Heinous") for p, c, d in rows],
                                    "person_key string, case_id int, district string, registered date, gravity string")
    scores = score.entity_score(history, "person_key", END)
    got = score.rank_pool(history, scores, "person_key", F.col("district") == "X").collect()
    assert [(r["person_key"], r["n_cases"], r["pool_rows"]) for r in got] == [("a", 3, 2)]
    both = score.rank_pool(history, scores, "person_key")
    assert [r["person_key"] for r in both.collect()] == ["a", "b"]
    assert {tuple(r) for r in score.history_rows(both, history, "person_key").collect()} == {("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5)}
