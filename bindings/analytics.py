"""Spatial cells, weekly series, detectors, scores, tagging, evaluation and governance."""
from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from caseweave.functions import geo, text as tx
from caseweave.functions.fixed_values import INTENT_KEYWORDS, SCORE_WEIGHTS
from caseweave.operators import detect, evaluate as ev, govern, score, spatial, sqlgate, tagging, timeseries as ts
from caseweave.sources import audit, tables

from . import model as m
from .registry import Registry
from .scalars import HAVERSINE_SQL, keyed

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
q = R.add

# ---- spatial ----------------------------------------------------------------------

RES = 6  # the derived points cover a region of 660 by 430 km; edge about 3.7 km


def hex_sql(lat: str, lon: str, res: int = RES) -> str:
    """Axial hexagon id by the same formulas."""
    size, third, root = geo.edge_km(res), 1.0 / 3.0, math.sqrt(3.0)
    x = f"(6371.0::DOUBLE * radians({lon}) * {math.cos(math.radians(15.0))!r}::DOUBLE)"
    y = f"(6371.0::DOUBLE * radians({lat}))"
    qf = f"({x} * {2.0 / 3.0 / size!r}::DOUBLE)"
    rf = f"({y} * {root / 3.0 / size!r}::DOUBLE - {x} * {third / size!r}::DOUBLE)"
    steps = lambda a, b: f"CAST(floor((floor({a}) + floor({b}) + 2) / 3) AS BIGINT)"
    return f"('{res}:' || {steps(f'{qf} - {rf}', f'{qf} * 2 + {rf}')} || ':' || {steps(f'{rf} - {qf}', f'{rf} * 2 + {qf}')})"


q("sp1_hex_cell", m.sql(f"SELECT case_id, {hex_sql('latitude', 'longitude')} AS cell FROM case_360"))(
    lambda s, d: spatial.with_cell(m.case_master(s, d), "latitude", "longitude", RES).select("case_id", "cell"))

CENTRE_LAT = "degrees({0} * sqrt(3.0::DOUBLE) * (CAST(split_part(cell, ':', 3) AS DOUBLE) + CAST(split_part(cell, ':', 2) AS DOUBLE) / 2) / 6371.0::DOUBLE)"
CENTRE_LON = "degrees({0} * 1.5::DOUBLE * CAST(split_part(cell, ':', 2) AS DOUBLE) / (6371.0::DOUBLE * cos(radians(15.0::DOUBLE))))"
EDGE = f"{geo.edge_km(RES)!r}::DOUBLE"
q("sp2_cell_centre", m.sql(f"SELECT person_key, round({CENTRE_LAT.format(EDGE)}, 6) AS lat, round({CENTRE_LON.format(EDGE)}, 6) AS lon FROM "
                           f"(SELECT person_key, {hex_sql('home_lat', 'home_lon')} AS cell FROM registry)"))(
    lambda s, d: spatial.with_cell(m.registry(s, d), "home_lat", "home_lon", RES).withColumn("c", geo.hex_centre("cell"))
    .select("person_key", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon")))

HOT_SQL = (f"SELECT cell, count(*) AS n, round(count(*) / max(count(*)) OVER (), 3) AS intensity, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon "
           f"FROM (SELECT {hex_sql('latitude', 'longitude')} AS cell, latitude, longitude FROM case_360 WHERE crime_sub_head = 'BUILDING' AND district = 'ASIA') GROUP BY cell")


def _hot(s, d):
    df = m.cases(s, d, ["crime_sub_head", "district", "latitude", "longitude"])
    return spatial.hotspots(df, "latitude", "longitude", RES, (F.col("crime_sub_head") == "BUILDING") & (F.col("district") == "ASIA"))


q("sp3_hotspots", m.sql(HOT_SQL))(_hot)
q("sp5_next_areas", m.sql(f"SELECT cell, intensity AS prob FROM ({HOT_SQL}) ORDER BY n DESC, cell LIMIT 5"))(lambda s, d: spatial.hottest(_hot(s, d)))

q("sp4_radius_match", m.sql(
    "SELECT r.person_key, o.o_custkey, round(" + HAVERSINE_SQL.format(m.lat_sql("o.o_custkey"), m.lon_sql("o.o_custkey"), "r.home_lat", "r.home_lon") + ", 6) AS km "
    "FROM registry r, (SELECT DISTINCT o_custkey FROM orders) o WHERE "
    + HAVERSINE_SQL.format(m.lat_sql("o.o_custkey"), m.lon_sql("o.o_custkey"), "r.home_lat", "r.home_lon") + " <= 15.0"))(
    lambda s, d: spatial.within_km(
        m.case_master(s, d).select(F.col("officer_id").alias("o_custkey"), "latitude", "longitude").distinct(), m.registry(s, d), 15.0,
        "latitude", "longitude", "home_lat", "home_lon").select("person_key", "o_custkey", F.round("km", 6).alias("km")))

q("j8_radius_join_counts", m.sql(
    "SELECT r.person_key, count(*) AS n FROM registry r JOIN case_360 c ON "
    + HAVERSINE_SQL.format("c.latitude", "c.longitude", "r.home_lat", "r.home_lon") + " <= 25.0 GROUP BY r.person_key"))(
    lambda s, d: spatial.within_km(
        m.case_master(s, d).groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("at")), m.registry(s, d), 25.0,
        "latitude", "longitude", "home_lat", "home_lon").groupBy("person_key").agg(F.sum("at").alias("n")))

# ---- weekly series ----------------------------------------------------------------

SERIES_CTE = """
counts AS (SELECT district, crime_head, CAST(date_trunc('week', registered) AS DATE) AS week, count(*) AS n FROM case_360 GROUP BY ALL),
spans AS (SELECT district, crime_head, min(week) AS a, max(week) AS b FROM counts GROUP BY ALL),
series AS (SELECT s.district, s.crime_head, s.week, coalesce(c.n, 0) AS n FROM
  (SELECT district, crime_head, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS week FROM spans) s
  LEFT JOIN counts c USING (district, crime_head, week))"""
BY = ["district", "crime_head"]


def series(s, d):
    return ts.weekly(m.cases(s, d, [*BY, "registered"]), "registered", BY)


q("t1_weekly_series", m.sql("SELECT * FROM series -- case_360", SERIES_CTE))(series)
q("t2_history_gate", m.sql("SELECT district, crime_head, count(*) AS weeks, CAST(sum(n) AS BIGINT) AS total, CASE WHEN count(*) < 80 OR sum(n) < 30 THEN "
                           "'insufficient history' ELSE 'ok' END AS status FROM series GROUP BY ALL -- case_360", SERIES_CTE))(
    lambda s, d: ts.history_gate(series(s, d), BY))
q("t3_seasonal_naive", m.sql(
    "SELECT district, crime_head, count(*) AS weeks, CASE WHEN count(*) > 60 THEN round(avg(abs(n - p)) FILTER (WHERE r <= 8), 6) END AS baseline_mae FROM "
    "(SELECT *, lag(n, 52) OVER (PARTITION BY district, crime_head ORDER BY week) AS p, row_number() OVER (PARTITION BY district, crime_head ORDER BY week DESC) AS r "
    "FROM series) GROUP BY ALL -- case_360", SERIES_CTE))(
    lambda s, d: ts.seasonal_naive(series(s, d), BY).withColumn("baseline_mae", F.round("baseline_mae", 6)))
q("w3_last_26_weeks", m.sql("SELECT district, crime_head, week, n FROM (SELECT *, row_number() OVER (PARTITION BY district, crime_head ORDER BY week DESC) AS r "
                            "FROM series) WHERE r <= 26 -- case_360", SERIES_CTE))(lambda s, d: ts.last_n(series(s, d), BY, 26))

# ---- detectors --------------------------------------------------------------------

AS_OF, START = dt.date(2024, 1, 31), dt.date(2024, 1, 1)
SPIKE_SQL = """
WITH g AS (SELECT event_type, user_id, count(*) FILTER (WHERE CAST(ts AS DATE) > DATE '2024-01-24') AS recent,
                  count(*) FILTER (WHERE CAST(ts AS DATE) <= DATE '2024-01-24') AS history FROM events GROUP BY ALL),
z AS (SELECT *, ((recent / 1.0::DOUBLE) - history / (23 / 7.0::DOUBLE)) / greatest(sqrt(history / (23 / 7.0::DOUBLE)), 0.5::DOUBLE) AS z,
             (recent / 1.0::DOUBLE) / greatest(history / (23 / 7.0::DOUBLE), 0.3::DOUBLE) AS ratio FROM g WHERE recent >= {min_recent})
"""


def _spikes(s, d, top=8):
    return detect.spikes(m.table(s, d, "events"), "ts", ["event_type", "user_id"], AS_OF, START, window_days=7, top=top)


_sp_cols = lambda df: df.select("event_type", "user_id", "recent", "history", F.round("z", 6).alias("z"), F.round("ratio", 6).alias("ratio"), "confidence")
_SP = "SELECT event_type, user_id, recent, history, round(z, 6) AS z, round(ratio, 6) AS ratio, round(least(0.95, 0.6 + z / 30), 2) AS confidence FROM z WHERE z >= 3"
q("t6_spikes_all", SPIKE_SQL.format(min_recent=6) + _SP)(lambda s, d: _sp_cols(_spikes(s, d, None)))
q("t6_spikes_top", SPIKE_SQL.format(min_recent=6) + _SP + " ORDER BY z DESC, event_type, user_id LIMIT 8")(lambda s, d: _sp_cols(_spikes(s, d)))
q("t6_spike_rows", SPIKE_SQL.format(min_recent=6) + "SELECT event_type, user_id, event_id FROM events JOIN (SELECT event_type, user_id FROM z WHERE z >= 3 "
  "ORDER BY z DESC, event_type, user_id LIMIT 8) USING (event_type, user_id) WHERE CAST(ts AS DATE) > DATE '2024-01-24'")(
    lambda s, d: detect.spike_rows(m.table(s, d, "events"), _spikes(s, d), "event_id", "ts", ["event_type", "user_id"], AS_OF, 7))

CASE_END = dt.date(2001, 7, 31)
q("t6_case_spikes", m.sql(
    "SELECT police_station, district, crime_sub_head, recent, history FROM (SELECT police_station, district, crime_sub_head, recent, "
    "CAST(sum(history) OVER (PARTITION BY police_station, crime_sub_head) AS BIGINT) AS history FROM (SELECT police_station, district, crime_sub_head, "
    "count(*) FILTER (WHERE registered > DATE '2001-07-17') AS recent, count(*) FILTER (WHERE registered <= DATE '2001-07-17') AS history FROM case_360 GROUP BY ALL)) "
    "WHERE recent >= 1"))(
    lambda s, d: detect.spike_counts(m.cases(s, d, ["police_station", "district", "crime_sub_head", "registered"]), "registered",
                                     ["police_station", "district", "crime_sub_head"], CASE_END, 14, ["police_station", "crime_sub_head"])
    .where("recent >= 1").select("police_station", "district", "crime_sub_head", "recent", "history"))


def _growth(s, d):
    members = m.cases(s, d, ["case_id", "registering_officer"]).withColumnRenamed("registering_officer", "series_id")
    return detect.growth(members, m.case_master(s, d), CASE_END, window_days=45)


q("t7_growth", m.sql("SELECT registering_officer AS series_id, count(*) AS new_cases FROM case_360 WHERE registered > DATE '2001-06-16' "
                     "GROUP BY 1 HAVING count(*) >= 2"))(_growth)

# repeat pattern: quiet persons are the suppliers without a case in the last year
REP_CTE = f"""
kinds AS (SELECT person_key, crime_sub_head, count(*) AS priors, max(registered) AS last_seen FROM entity_history GROUP BY ALL),
tot AS (SELECT *, sum(priors) OVER (PARTITION BY person_key) AS total, max(last_seen) OVER (PARTITION BY person_key) AS last_all FROM kinds),
arrested AS (SELECT DISTINCT l_suppkey AS person_key FROM lineitem WHERE l_returnflag = 'R'),
homes AS (SELECT person_key, {hex_sql('home_lat', 'home_lon')} AS cell FROM registry),
cand AS (SELECT t.person_key, t.crime_sub_head, h.cell FROM tot t JOIN homes h ON h.person_key = t.person_key JOIN arrested a ON a.person_key = t.person_key
         WHERE total >= 3 AND priors >= 2 AND last_all <= DATE '2001-08-01'),
centres AS (SELECT person_key, crime_sub_head, {CENTRE_LAT.format(EDGE)} AS clat, {CENTRE_LON.format(EDGE)} AS clon FROM cand),
fresh AS (SELECT case_id, crime_sub_head, latitude, longitude FROM case_360 WHERE case_status = 'O' AND accused_count = 0 AND registered > DATE '1995-02-01')
"""


def _repeat(s, d):
    history = m.history(s, d, ["registered", "crime_sub_head"])
    arrested = m.table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("person_key")).distinct()
    homes = spatial.with_cell(m.registry(s, d), "home_lat", "home_lon", RES, "home_cell").select("person_key", "home_cell")
    cand = detect.repeat_candidates(history, arrested, homes, dt.date(2001, 9, 30), quiet_days=60)
    fresh = detect.fresh_unsolved(m.cases(s, d, ["case_id", "case_status", "accused_count", "registered", "crime_sub_head", "latitude", "longitude"]),
                                  dt.date(2001, 9, 30), "O", days=2433)
    return detect.repeat_pattern(cand, fresh, km=80.0, min_near=4)


q("t8_repeat_pattern", m.sql(
    "SELECT person_key, count(*) AS near, CAST(round(least(0.9, 0.6 + 0.1 * count(*)), 2) AS DOUBLE) AS confidence FROM centres c JOIN fresh f ON f.crime_sub_head = c.crime_sub_head "
    "AND " + HAVERSINE_SQL.format("f.latitude", "f.longitude", "c.clat", "c.clon") + " <= 80.0 GROUP BY person_key HAVING count(*) >= 4 -- entity_history", REP_CTE))(_repeat)


@q("t9_leads", m.sql(
    "SELECT 'L-' || row_number() OVER (ORDER BY o, value DESC, subject) AS lead_id, type, subject, metric, value, confidence, DATE '2024-01-31' AS created_at FROM ("
    "SELECT 1 AS o, 'spike' AS type, event_type || ' / ' || user_id AS subject, 'rate_z' AS metric, round(z, 6) AS value, round(least(0.95, 0.6 + z / 30), 2) AS confidence FROM "
    "(SELECT * FROM z WHERE z >= 3 ORDER BY z DESC, event_type, user_id LIMIT 8) UNION ALL "
    "SELECT 3, 'series_growth', registering_officer, 'new_cases', count(*)::DOUBLE, 0.5 FROM case_360 WHERE registered > DATE '2001-06-16' GROUP BY registering_officer HAVING count(*) >= 2)",
    SPIKE_SQL.format(min_recent=6).replace("WITH g AS", "g AS")))
def _leads(s, d):
    spike = _spikes(s, d).withColumn("z", F.round("z", 6))
    grow = _growth(s, d).withColumn("confidence", F.lit(0.5))
    return detect.combine([
        detect.as_leads(spike, "spike", 1, F.concat_ws(" / ", "event_type", F.col("user_id").cast("string")), "rate_z", F.col("z")),
        detect.as_leads(grow, "series_growth", 3, F.col("series_id"), "new_cases", F.col("new_cases"))], AS_OF)


# ---- scores -----------------------------------------------------------------------

R3 = "CAST(format('{{:.3f}}', {0}) AS DOUBLE)"
SCORE_CTE = f"""
agg AS (SELECT person_key, count(*) AS n_cases, max(registered) AS last_seen, count(*) FILTER (WHERE gravity = 'Heinous') AS n_serious FROM entity_history GROUP BY person_key),
comp AS (SELECT person_key, n_cases, n_serious, CAST(date_diff('day', last_seen, DATE '2002-01-01') AS INT) AS days_since,
  {R3.format("exp(-date_diff('day', last_seen, DATE '2002-01-01') / 912.0::DOUBLE)")} AS recency,
  {R3.format("least(1.0::DOUBLE, n_cases / 900.0::DOUBLE)")} AS frequency, CASE WHEN n_serious > 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS gravity, 0.0::DOUBLE AS centrality FROM agg),
scored AS (SELECT *, {R3.format("0.0::DOUBLE + 0.3::DOUBLE * recency + 0.35::DOUBLE * frequency + 0.25::DOUBLE * gravity + 0.1::DOUBLE * centrality")} AS score FROM comp)
"""


def scores(s, d, centrality=None):
    return score.entity_score(m.history(s, d, ["registered", "gravity"]), "person_key", dt.date(2002, 1, 1), centrality=centrality,
                              weights=SCORE_WEIGHTS, saturation=900.0)


q("t10_entity_score", m.sql("SELECT person_key, score, recency, frequency, gravity, centrality, n_cases, n_serious, days_since FROM scored -- entity_history", SCORE_CTE))(scores)
q("t10_explanation", m.sql("SELECT person_key, format('{} prior case(s); most recent {} days before the data cutoff; {} heinous; network centrality {:.2f}.', "
                           "n_cases, days_since, n_serious, centrality) AS explanation FROM scored -- entity_history", SCORE_CTE))(
    lambda s, d: score.explain(scores(s, d)).select("person_key", "explanation"))
q("t11_rank", m.sql("SELECT person_key, score FROM scored WHERE n_cases >= 2 ORDER BY score DESC, person_key LIMIT 10 -- entity_history", SCORE_CTE))(
    lambda s, d: score.rank(scores(s, d), "person_key").select("person_key", "score"))
q("t11_rank_prefiltered", m.sql("SELECT person_key, score FROM (SELECT * FROM scored WHERE n_cases >= 2 ORDER BY n_cases DESC, person_key LIMIT 40) "
                                "ORDER BY score DESC, person_key LIMIT 10 -- entity_history", SCORE_CTE))(
    lambda s, d: score.rank(scores(s, d), "person_key", prefilter=40).select("person_key", "score"))

# ---- gate, tagging ----------------------------------------------------------------

GATED = "```sql\nWITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000) SELECT o_orderstatus, COUNT(*) AS n FROM big GROUP BY o_orderstatus;\n```"


@q("n1_gated_sql", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def _gated(s, d):
    tables.register({"orders": m.table(s, d, "orders")})
    return sqlgate.query(s, GATED, {"orders"})


@q("n2_read_only", "SELECT * FROM (VALUES ('select', true), ('union', true), ('insert', false), ('drop', false), ('two', false), ('unknown', false), "
                   "('path', false), ('reflect', false)) t(name, allowed) CROSS JOIN (SELECT count(*) AS n_orders FROM orders)")
def _read_only(s, d):
    texts = {"select": "SELECT * FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders)",
             "union": "SELECT o_orderkey FROM orders UNION SELECT o_custkey FROM orders", "insert": "INSERT INTO orders VALUES (1)",
             "drop": "DROP TABLE orders", "two": "SELECT 1 FROM orders; DROP TABLE orders", "unknown": "SELECT * FROM secret",
             "path": f"SELECT * FROM parquet.`{d}/orders.parquet`",
             "reflect": "SELECT reflect('java.lang.System', 'getenv', 'HOME') FROM orders"}
    n_orders = m.table(s, d, "orders").agg(F.count(F.lit(1)).alias("n_orders"))
    parts = [n_orders.select(F.lit(k).alias("name"), F.lit(sqlgate.is_read_only(s, t, {"orders"})).alias("allowed"), "n_orders") for k, t in texts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


MSG_SQL = "SELECT conv_id, turn, role, 'Sure.' || chr(10) || '```sql' || chr(10) || 'select ' || turn || ' from t where x = ''' || role || ''';' || chr(10) || '```' || text AS msg FROM conversations"
q("n3_extract_sql", f"SELECT conv_id, turn, 'select ' || turn || ' from t where x = ''' || role || '''' AS sql FROM ({MSG_SQL})")(
    lambda s, d: m.table(s, d, "conversations").select(
        "conv_id", "turn", tx.extract_sql(F.concat(F.lit("Sure.\n```sql\nselect "), F.col("turn").cast("string"), F.lit(" from t where x = '"),
                                                   F.col("role"), F.lit("';\n```"), F.col("text"))).alias("sql")))

KEYWORDS = {**INTENT_KEYWORDS, "linkage": ["thion", "laion"], "forecast": ["ention", "zuver"], "hotspots": ["ringe"], "risk_rank": ["erea"], "network": ["and"]}
DISTRICTS, SUBHEADS = ["the", "ther", "of"], ["ing", "ingre", "er"]


def _case(options):
    return "CASE " + " ".join(f"WHEN contains(lower(text), '{o}') THEN '{o}'" for o in sorted(options, key=len, reverse=True)) + " END"


_intent = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{k.lower()}')" for k in ks) + f" THEN '{i}'" for i, ks in KEYWORDS.items()) + " ELSE 'run_sql' END"
q("n4_intent", f"SELECT conv_id, turn, intent, CASE WHEN intent = 'forecast' THEN coalesce(d, 'the') WHEN intent IN ('hotspots', 'risk_rank') THEN d END AS district, "
               f"CASE WHEN intent = 'forecast' THEN coalesce(h, 'er') WHEN intent = 'hotspots' THEN h END AS sub_head FROM "
               f"(SELECT conv_id, turn, {_intent} AS intent, {_case(DISTRICTS)} AS d, {_case(SUBHEADS)} AS h FROM conversations)")(
    lambda s, d: tagging.intent(m.table(s, d, "conversations"), "text", {"district": DISTRICTS, "sub_head": SUBHEADS},
                                {"district": "the", "sub_head": "er"}, KEYWORDS).select("conv_id", "turn", "intent", "district", "sub_head"))

NAMES_SQL = "(SELECT s_suppkey AS person_key, lower(s_name) AS name FROM supplier)"
#: Messages that speak of a supplier: every text ends with the name of one.
MESSAGES_SQL = """(SELECT c.conv_id, c.turn, c.text || ' Seen with ' || s.s_name || '.' AS text FROM conversations c
  JOIN supplier s ON s.s_suppkey = (c.conv_id * 31 + c.turn * 7) % (SELECT max(s_suppkey) + 1 FROM supplier))"""


def _names(s, d):
    return m.table(s, d, "supplier").select(F.col("s_suppkey").alias("person_key"), F.lower("s_name").alias("name"))


def _messages(s, d):
    suppliers = m.table(s, d, "supplier")
    above = suppliers.agg(F.max("s_suppkey") + 1).scalar()
    talk = m.table(s, d, "conversations").withColumn("s_suppkey", (F.col("conv_id") * 31 + F.col("turn") * 7) % above)
    return talk.join(suppliers.select("s_suppkey", "s_name"), "s_suppkey").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("msg_id"),
        F.concat("text", F.lit(" Seen with "), "s_name", F.lit(".")).alias("text"))


q("j10_names_in_text", f"SELECT conv_id || '-' || turn AS msg_id, person_key FROM {MESSAGES_SQL} JOIN {NAMES_SQL} ON length(name) > 0 AND contains(lower(text), name)")(
    lambda s, d: tagging.names_in_text(_messages(s, d), "msg_id", "text", _names(s, d), "person_key", "name"))
q("n5_resolve_name", f"SELECT msg_id, person_key FROM (SELECT conv_id || '-' || turn AS msg_id, person_key, row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(n, 0) DESC, "
                     f"person_key) AS r FROM {MESSAGES_SQL} JOIN {NAMES_SQL} ON length(name) > 0 AND contains(lower(text), name) LEFT JOIN (SELECT l_suppkey AS person_key, count(*) AS n FROM lineitem "
                     f"GROUP BY 1) USING (person_key)) WHERE r = 1")(
    lambda s, d: tagging.resolve_name(_messages(s, d), "msg_id", "text", _names(s, d), "person_key", "name",
                                      m.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("person_key")).agg(F.count(F.lit(1)).alias("n"))))
q("n6_evidence_ids", m.sql("SELECT case_id FROM case_360 WHERE district = 'ASIA' ORDER BY case_id LIMIT 50"))(
    lambda s, d: tagging.evidence_ids(m.cases(s, d, ["case_id", "district"]).where("district = 'ASIA'"), cap=50))
q("n7_grounding", r"""
WITH n AS (SELECT c.conv_id, c.turn, regexp_extract_all(c.text, '\d[\d,]*') AS found FROM conversations c)
SELECT conv_id, turn, len(list_filter(found, lambda x: replace(x, ',', '') != CAST(turn AS VARCHAR) AND replace(x, ',', '') != CAST(conv_id AS VARCHAR))) = 0 AS grounded FROM n""")(
    lambda s, d: m.table(s, d, "conversations").select(
        "conv_id", "turn", tx.grounded("text", F.col("turn"), F.concat(F.lit("case "), F.col("conv_id").cast("string"))).alias("grounded")))
q("n8_confidence", "SELECT o_custkey, CASE WHEN count(*) >= 5 AND NOT bool_or(o_orderstatus = 'P') THEN 'high' WHEN count(*) - 4 <= 0 THEN 'low' ELSE 'medium' END AS confidence "
                   "FROM orders GROUP BY o_custkey")(
    lambda s, d: tagging.confidence(m.table(s, d, "orders").groupBy("o_custkey").agg(
        F.greatest(F.count(F.lit(1)) - 4, F.lit(0)).alias("row_count"), F.bool_or(F.col("o_orderstatus") == "P").alias("repaired"))).select("o_custkey", "confidence"))

# ---- evaluation and governance ----------------------------------------------------


@q("e1_execution_match", "SELECT * FROM (VALUES ('same', true), ('different', false)) t(name, matched) CROSS JOIN (SELECT count(*) AS rows_compared FROM lineitem)")
def _match(s, d):
    li = m.table(s, d, "lineitem")
    a = li.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("x"))
    b = li.groupBy("l_suppkey").agg((F.avg("l_quantity") * F.count(F.lit(1))).alias("y")).orderBy(F.desc("l_suppkey"))
    c = li.where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("x"))
    n = li.agg(F.count(F.lit(1)).alias("rows_compared"))
    return (n.select(F.lit("same").alias("name"), F.lit(ev.same_rows(a, b)).alias("matched"), "rows_compared")
            .unionByName(n.select(F.lit("different").alias("name"), F.lit(ev.same_rows(a, c)).alias("matched"), "rows_compared")))


_labelled = lambda s, d: m.table(s, d, "documents").select("doc_id", "lang", "source").join(m.table(s, d, "labels"), "doc_id").withColumn("ok", F.col("toxic") == 0)
q("e2_failures", "SELECT doc_id, lang, source FROM documents JOIN labels USING (doc_id) WHERE toxic <> 0")(
    lambda s, d: ev.failures(_labelled(s, d)).select("doc_id", "lang", "source"))
q("e2_accuracy", "SELECT source, count(*) FILTER (WHERE toxic = 0) AS passed, count(*) AS total, round(avg(CAST(toxic = 0 AS INT)), 6) AS accuracy "
                 "FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source)")(
    lambda s, d: ev.accuracy(_labelled(s, d), "source").withColumn("accuracy", F.round("accuracy", 6)))


def _clusterings(s, d):
    """Predicted: documents with the same words; truth: exact copies."""
    docs = m.table(s, d, "documents")
    truth = docs.select("doc_id", F.md5("text").alias("label"))
    pred = docs.select("doc_id", F.concat_ws(":", "lang", F.md5(F.array_join(tx.tokens("text"), " "))).alias("k"))
    pred = pred.join(pred.groupBy("k").agg(F.min("doc_id").alias("cluster")), "k").select("doc_id", "cluster")
    return pred, truth


PR_CTE = f"""
WITH truth AS (SELECT doc_id, md5(text) AS label FROM documents),
k AS (SELECT doc_id, lang || ':' || md5(coalesce(list_aggregate(regexp_extract_all(lower(text), '[a-z]+'), 'string_agg', ' '), '')) AS k FROM documents),
pred AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS cluster FROM k),
over AS (SELECT cluster, label, count(*) AS n FROM pred JOIN truth USING (doc_id) GROUP BY ALL),
ps AS (SELECT cluster, count(*) AS size_p FROM pred GROUP BY ALL), tsz AS (SELECT label, count(*) AS size_t FROM truth GROUP BY ALL)
"""
q("e3_cluster_pairs", PR_CTE + "SELECT tp, predicted, actual, tp / predicted AS precision, tp / actual AS recall FROM (SELECT (SELECT sum(n * (n - 1) / 2)::DOUBLE FROM over) AS tp, "
                               "(SELECT sum(size_p * (size_p - 1) / 2)::DOUBLE FROM ps) AS predicted, (SELECT sum(size_t * (size_t - 1) / 2)::DOUBLE FROM tsz) AS actual)")(
    lambda s, d: ev.cluster_pr(*_clusterings(s, d), "doc_id"))
q("e3_cluster_members", PR_CTE + "SELECT label, cluster AS best_cluster, n AS shared, n / size_p AS precision, n / size_t AS recall FROM (SELECT *, row_number() OVER (PARTITION BY label "
                                 "ORDER BY n DESC, cluster) AS r FROM over) JOIN ps USING (cluster) JOIN tsz USING (label) WHERE r = 1")(
    lambda s, d: ev.cluster_pr(*_clusterings(s, d), "doc_id", level="member"))

q("e4_key_report", "SELECT rule, violations FROM (SELECT count(*) FILTER (WHERE substr(o_orderpriority, 1, 1) NOT IN ('1', '3', '4', '8')) AS key_format, 0::BIGINT AS number_is_key_tail, "
                   "0::BIGINT AS category_matches_key FROM orders JOIN customer ON c_custkey = o_custkey) UNPIVOT (violations FOR rule IN (key_format, number_is_key_tail, category_matches_key))")(
    lambda s, d: ev.rule_report(keyed(s, d).withColumn("category", F.col("category").cast("int")), ev.key_rules("case_key", "case_no", "category")))
q("e4_serial_gaps", "SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linenumber <> e) AS wrong FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey "
                    "ORDER BY l_linenumber) AS e FROM lineitem) GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_linenumber <> e) > 0")(
    lambda s, d: ev.serial_gaps(m.table(s, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_linenumber"))
q("e4_orphans", "SELECT count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")(
    lambda s, d: ev.orphans(m.table(s, d, "lineitem"), m.table(s, d, "orders"), "l_orderkey", "o_orderkey").agg(F.count(F.lit(1)).alias("orphans")))


def _scopes(s, d):
    """Users and their rows to see, derived from the nation and region tables."""
    return (m.table(s, d, "nation").select(F.concat(F.lit("sho."), F.lower("n_name")).alias("user_id"), F.lit("police_station").alias("level"), F.col("n_name").alias("value"))
            .unionByName(m.table(s, d, "region").select(F.concat(F.lit("sp."), F.lower("r_name")).alias("user_id"), F.lit("district").alias("level"), F.col("r_name").alias("value")))
            .unionByName(m.table(s, d, "region").select(F.lit("dir").alias("user_id"), F.lit("statewide").alias("level"), F.lit("").alias("value")).distinct()))


for _user, _cond in (("sho.nation_7", "police_station = 'NATION_7'"), ("sp.asia", "district = 'ASIA'"), ("dir", "true"), ("nobody", "false")):
    q(f"m1_scope_{_user.replace('.', '_')}", m.sql(f"SELECT case_id, police_station FROM case_360 WHERE {_cond}"))(
        lambda s, d, u=_user: govern.scope(m.cases(s, d, ["case_id", "police_station", "district"]), u, _scopes(s, d)).select("case_id", "police_station"))

q("m2_mask", "SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: w[1] || '.'), 'string_agg', ' ') AS p_name, "
             "CAST(p_size // 10 * 10 AS VARCHAR) || '-' || CAST(p_size // 10 * 10 + 9 AS VARCHAR) AS p_size FROM part")(
    lambda s, d: govern.mask(m.table(s, d, "part"), ["p_name"], ["p_size"]).select("p_partkey", "p_name", "p_size"))


@q("m3_denied_columns", "SELECT 'orders' AS table_name, count(*) AS n_rows, false AS refused FROM orders UNION ALL SELECT 'customer', count(*), false FROM customer "
                        "UNION ALL SELECT 'customer with caste', count(*), true FROM customer")
def _denied(s, d):
    parts = []
    customer = m.table(s, d, "customer")
    checked = {"orders": m.table(s, d, "orders"), "customer": customer, "customer with caste": customer.withColumn("caste", F.lit(None).cast("string"))}
    for name, df in checked.items():
        try:
            score.refuse_denied(df.columns)
            refused = False
        except ValueError:
            refused = True
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(refused).alias("refused")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- sources ----------------------------------------------------------------------

q("src2_lenient_dates", "SELECT event_id, CAST(TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d') END AS DATE) AS DATE) AS day FROM events")(
    lambda s, d: tables.coerce_temporal(
        m.table(s, d, "events").select("event_id", F.when(F.col("event_type") == "error", "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day")), dates=["day"]))
q("src5_audit_tail", "SELECT event_id AS audit_id, user_id, event_type AS action FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")(
    lambda s, d: audit.tail(m.table(s, d, "events").select(F.col("event_id").alias("audit_id"), "ts", "user_id", F.col("event_type").alias("action")))
    .select("audit_id", "user_id", "action"))


@q("src6_status", "SELECT 'orders' AS table_name, true AS present, count(*) AS row_count FROM orders UNION ALL SELECT 'lineitem', true, count(*) FROM lineitem "
                  "UNION ALL SELECT 'no_such_table', false, 0")
def _status(s, d):
    tables.register({n: m.table(s, d, n) for n in ("orders", "lineitem")})
    return tables.status(s, ["orders", "lineitem", "no_such_table"])
