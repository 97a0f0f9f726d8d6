"""Leads of all three detectors with their evidence, and the ranking within a district."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from caseweave.functions import fixed_values as fx
from caseweave.operators import detect, leads as ld, score, spatial
from caseweave.plans.lineage import cut

from . import model as m
from .analytics import REP_CTE, RES, SCORE_CTE, scores
from .linking import SERIES_CTE, _series
from .registry import Registry
from .scalars import HAVERSINE_SQL

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
q = R.add

# the tables hold no planted wave, so the limits lie lower than the defaults
END, START, DAYS = dt.date(2001, 7, 31), dt.date(1995, 1, 1), 14
LIMITS = {"min_recent": 3, "z_min": 1.5}
GROWTH_DAYS = 120


def _spike(s, d):
    cases = cut(m.cases(s, d, ["case_id", "registered", "police_station", "district", "crime_sub_head"]), "cases")
    rows = detect.spikes(cases, "registered", ["police_station", "district", "crime_sub_head"], END, START, DAYS,
                         history_by=["police_station", "crime_sub_head"], **LIMITS)
    return ld.spike_leads(rows, cases, END, window_days=DAYS)


def _repeat(s, d):
    end = dt.date(2001, 9, 30)
    history = m.history(s, d, ["registered", "crime_sub_head"])
    arrested = m.table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("person_key")).distinct()
    homes = spatial.with_cell(m.registry(s, d), "home_lat", "home_lon", RES, "home_cell").select("person_key", "home_cell")
    fresh = detect.fresh_unsolved(m.cases(s, d, ["case_id", "case_status", "accused_count", "registered", "crime_sub_head", "latitude", "longitude"]), end, "O", days=2433)
    nation, region = m.table(s, d, "nation"), m.table(s, d, "region")
    named = (m.table(s, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
             .select(F.col("s_suppkey").alias("person_key"), F.col("s_name").alias("full_name"), F.col("r_name").alias("district")))
    return ld.repeat_leads(detect.repeat_candidates(history, arrested, homes, end), fresh, named, km=80.0, days=2433)


def _growth(s, d):
    _, members, series = _series(s, d)
    series = cut(series.withColumn("confidence", F.round("confidence", 6)), "series")
    own = members.join(series.select("component", "series_id"), "component").select("series_id", "case_id")
    return ld.growth_leads(series, own, m.case_master(s, d), END, window_days=GROWTH_DAYS)


def _all(s, d):
    return ld.combine([_spike(s, d), _repeat(s, d), _growth(s, d)], END)


R1 = "CAST(format('{{:.1f}}', {0}) AS DOUBLE)"
WEEKS = f"{((END - dt.timedelta(days=DAYS)) - START).days}::DOUBLE / 7.0::DOUBLE"
SINCE, GROWN = END - dt.timedelta(days=DAYS), END - dt.timedelta(days=GROWTH_DAYS)
SPIKE_CTE = f"""
sc AS (SELECT police_station, district, crime_sub_head, recent, sum(old) OVER (PARTITION BY police_station, crime_sub_head)::DOUBLE / ({WEEKS}) AS base, recent / 2.0::DOUBLE AS rate FROM
  (SELECT police_station, district, crime_sub_head, count(*) FILTER (WHERE registered > DATE '{SINCE}') AS recent, count(*) FILTER (WHERE registered <= DATE '{SINCE}') AS old FROM case_360 GROUP BY ALL)),
sz AS (SELECT *, (rate - base) / greatest(sqrt(base), 0.5::DOUBLE) AS z, rate / greatest(base, 0.3::DOUBLE) AS ratio FROM sc WHERE recent >= {LIMITS['min_recent']}),
spike AS (SELECT *, concat_ws(' / ', police_station, district, crime_sub_head) AS subject FROM sz WHERE z >= {LIMITS['z_min']}
  ORDER BY z DESC, police_station, district, crime_sub_head LIMIT 8)"""
REPEAT_CTE = f"""
hits AS (SELECT person_key, case_id FROM centres c JOIN fresh f ON f.crime_sub_head = c.crime_sub_head AND {HAVERSINE_SQL.format('f.latitude', 'f.longitude', 'c.clat', 'c.clon')} <= 80.0),
rep AS (SELECT h.person_key, h.near, s_name AS full_name, r_name AS district FROM (SELECT person_key, count(*) AS near FROM hits GROUP BY 1 HAVING count(*) >= 4) h
  LEFT JOIN (supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) ON s_suppkey = h.person_key)"""
GROWTH_CTE = f"""
own AS (SELECT series_id, case_id FROM series JOIN members USING (component)),
grown AS (SELECT s.*, n.new FROM series s JOIN (SELECT series_id, count(*) AS new FROM own JOIN case_360 USING (case_id) WHERE registered > DATE '{GROWN}' GROUP BY 1 HAVING count(*) >= 2) n USING (series_id))"""
LEADS_CTE = f"""
found AS (SELECT 0 AS o, 'spike' AS type, subject, format('{{}} {{:.1f}}x baseline — {{}}', crime_sub_head, ratio, police_station) AS title, {R1.format('z')} AS value, 'last 14d' AS "window",
    round(least(0.95, 0.6 + z / 30), 2) AS confidence, 'Increase night patrols and pickets around ' || police_station || ' for the next 14 days.' AS suggested_action, district FROM spike
  UNION ALL SELECT 1, 'repeat_offender', person_key::VARCHAR, 'Possible re-offending by ' || full_name || ' near home turf', near::DOUBLE, 'last 2433d', round(least(0.9, 0.6 + 0.1 * near), 2),
    'Question ' || full_name || '; verify alibi for the ' || near || ' unsolved cases near their residence.', district FROM rep
  UNION ALL SELECT 2, 'series_growth', series_id, 'Series ' || series_id || ' grew by ' || new || ' cases', new::DOUBLE, 'last {GROWTH_DAYS}d', round(confidence, 6),
    'Escalate ' || series_id || ' (' || crime_sub_head || ') to a special team.', coalesce(districts[1], '') FROM grown),
leads AS (SELECT 'L-' || row_number() OVER (ORDER BY o, value DESC, subject) AS lead_id, * FROM found)"""
CTES = (REP_CTE.strip().rstrip(","), SPIKE_CTE, REPEAT_CTE, SERIES_CTE, GROWTH_CTE, LEADS_CTE)
METRIC = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fx.LEAD_METRICS.items()) + " END"

q("t9_whole_leads", m.sql(f'SELECT lead_id, type, subject, title, {METRIC} AS metric, value, "window", CAST(confidence AS DOUBLE) AS confidence, suggested_action, district, DATE \'{END}\' AS created_at '
                          "FROM leads -- entity_history", *CTES))(lambda s, d: _all(s, d).leads)
q("t9_lead_evidence", m.sql(
    "SELECT lead_id, case_id FROM leads JOIN (SELECT 'spike' AS type, s.subject, c.case_id FROM spike s JOIN case_360 c USING (police_station, crime_sub_head) "
    f"WHERE c.registered > DATE '{SINCE}' UNION ALL SELECT 'repeat_offender', person_key::VARCHAR, case_id FROM hits UNION ALL SELECT 'series_growth', series_id, case_id FROM own) "
    "USING (type, subject) -- entity_history", *CTES))(lambda s, d: _all(s, d).evidence)

# ---- ranking within a district ----------------------------------------------------

POOL_CTE = """
pool AS (SELECT person_key, count(*) AS pool_rows FROM entity_history WHERE district = 'ASIA' GROUP BY 1 HAVING count(*) >= 2 ORDER BY pool_rows DESC, person_key LIMIT 40),
ranked AS (SELECT person_key, score, pool_rows FROM scored JOIN pool USING (person_key) ORDER BY score DESC, person_key LIMIT 10)"""


def _ranked(s, d):
    history = m.history(s, d, ["registered", "gravity", "district"])
    return score.rank_pool(history, scores(s, d), "person_key", F.col("district") == "ASIA")


q("t11_rank_in_district", m.sql("SELECT person_key, score, pool_rows FROM ranked -- entity_history", SCORE_CTE, POOL_CTE))(
    lambda s, d: _ranked(s, d).select("person_key", "score", "pool_rows"))
q("t11_history_rows", m.sql("SELECT DISTINCT person_key, case_id FROM entity_history JOIN ranked USING (person_key) -- entity_history", SCORE_CTE, POOL_CTE))(
    lambda s, d: score.history_rows(cut(_ranked(s, d), "ranked"), m.accused(s, d), "person_key"))
