"""The analysts' golden question shapes as SQL text that runs unchanged on both engines."""
from __future__ import annotations

from . import model as m

# name -> query over case_360 / entity_history / accused / registry
TEXTS = {
    "gold_count_head_district_year": "SELECT COUNT(*) AS n FROM case_360 WHERE crime_sub_head = 'BUILDING' AND district = 'ASIA' AND year(registered) = 1997",
    "gold_count_category_year": "SELECT COUNT(*) AS n FROM case_360 WHERE crime_head = '2-HIGH' AND year(registered) = 1996",
    "gold_monthly_trend": "SELECT CAST(date_trunc('month', registered) AS DATE) AS ym, COUNT(*) AS n FROM case_360 WHERE crime_sub_head = 'BUILDING' AND district = 'EUROPE' AND year(registered) = 1998 GROUP BY CAST(date_trunc('month', registered) AS DATE) ORDER BY ym",
    "gold_top_stations": "SELECT police_station, COUNT(*) AS c FROM case_360 WHERE district = 'ASIA' AND year(registered) = 1997 GROUP BY police_station ORDER BY c DESC, police_station LIMIT 5",
    "gold_top_districts": "SELECT district, COUNT(*) AS c FROM case_360 GROUP BY district ORDER BY c DESC, district LIMIT 5",
    "gold_heinous_count": "SELECT COUNT(*) AS n FROM case_360 WHERE gravity = 'Heinous' AND year(registered) = 1999",
    "gold_station_since_date": "SELECT COUNT(*) AS n FROM case_360 WHERE crime_sub_head = 'MACHINERY' AND police_station = 'NATION_7' AND registered >= DATE '1999-07-01'",
    "gold_category_total": "SELECT COUNT(*) AS n FROM case_360 WHERE crime_head = '5-LOW'",
    "gold_status_district": "SELECT COUNT(*) AS n FROM case_360 WHERE case_status = 'O' AND district = 'AFRICA'",
    "gold_head_breakdown": "SELECT crime_head, COUNT(*) AS c FROM case_360 WHERE year(registered) = 1999 GROUP BY crime_head ORDER BY c DESC, crime_head",
    "gold_section_cases": "SELECT COUNT(DISTINCT case_id) AS n FROM accused WHERE person_key = 7 AND age >= 30",
    "gold_person_cases": "SELECT COUNT(DISTINCT case_id) AS n FROM entity_history WHERE full_name = 'Supplier#000000003'",
    "gold_person_heads": "SELECT DISTINCT crime_sub_head FROM entity_history WHERE full_name = 'Supplier#000000003' ORDER BY crime_sub_head",
    "gold_districts_with_head": "SELECT DISTINCT district FROM case_360 WHERE crime_sub_head = 'FURNITURE' AND year(registered) = 2000 ORDER BY district",
    "gold_cases_with_accused": "SELECT COUNT(DISTINCT case_id) AS n FROM accused",
    "gold_two_or_more_accused": "SELECT COUNT(*) AS n FROM case_360 WHERE accused_count >= 2",
    "gold_child_join_year": "SELECT COUNT(*) AS n FROM accused a JOIN case_360 c ON c.case_id = a.case_id WHERE a.age = 2 AND year(c.registered) = 1998",
    "gold_top_sub_heads": "SELECT crime_sub_head, COUNT(*) AS c FROM case_360 WHERE year(registered) = 1996 GROUP BY crime_sub_head ORDER BY c DESC, crime_sub_head LIMIT 5",
    "gold_station_year": "SELECT COUNT(*) AS n FROM case_360 WHERE police_station = 'NATION_11' AND year(registered) = 2000",
    "gold_pending_before_date": "SELECT COUNT(*) AS n FROM case_360 WHERE case_status = 'O' AND registered < DATE '1998-05-20'",
    "gold_final_report_type": "SELECT COUNT(*) AS n FROM case_360 WHERE final_report_type = 'R'",
    "gold_gravity_breakdown": "SELECT gravity, COUNT(*) AS c FROM case_360 WHERE year(registered) = 1996 GROUP BY gravity ORDER BY gravity",
    "gold_distinct_stations": "SELECT COUNT(DISTINCT police_station) AS n FROM case_360 WHERE crime_sub_head = 'BUILDING' AND year(registered) = 1996",
    "gold_total_cases": "SELECT COUNT(*) AS n FROM case_360",
    "gold_cases_per_year": "SELECT CAST(year(registered) AS INT) AS yr, COUNT(*) AS c FROM case_360 GROUP BY CAST(year(registered) AS INT) ORDER BY yr",
    "gold_most_accused_person": "SELECT person_key, COUNT(*) AS c FROM entity_history GROUP BY person_key ORDER BY c DESC, person_key LIMIT 1",
    "gold_districts_in_list": "SELECT COUNT(*) AS n FROM case_360 WHERE crime_sub_head = 'BUILDING' AND district IN ('ASIA', 'EUROPE', 'AMERICA') AND year(registered) = 1997",
    "gold_season_months": "SELECT COUNT(*) AS n FROM case_360 WHERE crime_sub_head = 'HOUSEHOLD' AND year(registered) = 1996 AND month(registered) IN (10, 11)",
    "gold_officer_cases": "SELECT COUNT(*) AS n FROM case_360 WHERE registering_officer = 'Customer#000000007'",
    "gold_status_breakdown": "SELECT case_status, COUNT(*) AS c FROM case_360 WHERE year(registered) = 1999 GROUP BY case_status ORDER BY case_status",
}

NARRATIVE_MENTIONS = "SELECT COUNT(*) AS n FROM documents WHERE lower(text) LIKE '%motorcycle%' OR lower(text) LIKE '%ther%'"


def _run(text: str):
    def query(spark, folder):
        if "case_360" in text:
            wanted = [c for c in m.CASE_COLUMNS if c in text] or ["case_id"]
            m.cases(spark, folder, wanted).createOrReplaceTempView("case_360")
        if "entity_history" in text:
            wanted = [c for c in ("registered", "crime_sub_head", "district") if c in text]
            m.history(spark, folder, wanted).createOrReplaceTempView("entity_history")
        m.accused(spark, folder).createOrReplaceTempView("accused")
        m.table(spark, folder, "documents").createOrReplaceTempView("documents")
        return spark.sql(text)
    return query


QUERIES = {name: _run(text) for name, text in TEXTS.items()}
QUERIES["gold_narrative_mentions"] = _run(NARRATIVE_MENTIONS)
ORACLE = {name: m.sql(text) for name, text in TEXTS.items()}
ORACLE["gold_narrative_mentions"] = NARRATIVE_MENTIONS
