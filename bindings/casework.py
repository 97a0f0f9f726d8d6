"""Forecasts, case packs, streaming jobs, sources and sinks."""
from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from caseweave.functions import vectors as vec
from caseweave.operators import detect, forecast as fc, linkage as lk, neighbours as nb, pack, spatial
from caseweave.plans.lineage import cut, scratch_path
from caseweave.sources import audit, tables
from caseweave.streaming import jobs

from . import model as m
from .analytics import AS_OF, BY, RES, SPIKE_SQL, START, _sp_cols, _SP, scores, series, SCORE_CTE
from .linking import E64, KNN_CTE, R3
from .registry import Registry
from .scalars import SECTION_OF_SQL, SECTIONS_SQL, section_of, sections

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
q = R.add

# ---- forecasts --------------------------------------------------------------------

q("t4_forecast")(lambda s, d: fc.forecast(series(s, d), BY))
q("t5_backtest")(lambda s, d: fc.backtest(series(s, d), BY))

# ---- case pack: the series is the set of vectors of one label ----------------------

MEMBERS_SQL = "members AS (SELECT vec_id AS case_id FROM embeddings WHERE label = 3)"


def members(s, d):
    return m.table(s, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("case_id"))


def vectors(s, d):
    return m.table(s, d, "embeddings").select(F.col("vec_id").alias("case_id"), "embedding")


q("p1_timeline", m.sql("SELECT registered AS date, case_id, 'FIR registered — ' || police_station || ', ' || district AS event FROM case_360 WHERE case_id IN (SELECT case_id FROM members)", MEMBERS_SQL))(
    lambda s, d: pack.timeline(members(s, d), m.cases(s, d, ["case_id", "registered", "police_station", "district"])))

SUPPORT_CTE = KNN_CTE + f""",
{MEMBERS_SQL},
support AS (SELECT person_key, CAST(format('{{:.2f}}', sum(s)) AS DOUBLE) AS support FROM (SELECT neighbour, {R3.format('sim')} AS s FROM knn WHERE query IN (SELECT case_id FROM members) AND {R3.format('sim')} >= 0.3) k
  JOIN accused a ON a.case_id = k.neighbour GROUP BY person_key)"""


def _suspects(s, d):
    base = vectors(s, d)
    own = base.join(members(s, d), "case_id", "left_semi")
    support = nb.support(own, base, m.accused(s, d), min_sim=0.3)
    return pack.suspects(support, scores(s, d), m.registry(s, d))


q("p2_suspects", m.sql("SELECT row_number() OVER (ORDER BY support DESC, score DESC, person_key) AS rank, person_key, full_name, support, score FROM support JOIN scored USING (person_key) JOIN registry USING (person_key) "
                       "ORDER BY support DESC, score DESC, person_key LIMIT 8 -- entity_history", SCORE_CTE, SUPPORT_CTE))(_suspects)


def _similar(s, d):
    first = members(s, d).agg(F.min("case_id")).first()[0]  # one id
    return nb.similar(vectors(s, d), "case_id", "embedding", first, 5)


SIM_SQL = f"""(SELECT v.vec_id AS case_id, {R3.format('list_dot_product(v.u, p.u)')} AS similarity FROM v, (SELECT u, vec_id FROM v WHERE vec_id = (SELECT min(case_id) FROM members)) p
WHERE v.vec_id <> p.vec_id ORDER BY list_dot_product(v.u, p.u) DESC, v.vec_id LIMIT 5)"""
q("p3_similar_history", m.sql(f"SELECT case_id, similarity FROM {SIM_SQL} ORDER BY similarity DESC, case_id LIMIT 3", KNN_CTE, MEMBERS_SQL))(
    lambda s, d: _similar(s, d).orderBy(F.desc("similarity"), "case_id").limit(3))

INVOKED = f"invoked AS (SELECT DISTINCT {SECTION_OF_SQL.format('l_returnflag')} AS section FROM lineitem WHERE l_orderkey IN (SELECT case_id FROM members))"


def _sections(s, d):
    used = m.table(s, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), section_of("l_returnflag").alias("section"))
    return pack.sections_invoked(members(s, d), used, sections(s))


q("p4_sections", m.sql(f"SELECT DISTINCT section, description FROM invoked JOIN {SECTIONS_SQL} USING (section)", MEMBERS_SQL, INVOKED))(_sections)
q("p4_elements_check", m.sql("SELECT section, element, CASE WHEN pos = n_elements - 1 THEN 'missing' ELSE 'present' END AS status, CASE WHEN pos = n_elements - 1 THEN "
                             f"'not yet established — investigation gap' ELSE 'BriefFacts / arrest records' END AS source FROM invoked JOIN {SECTIONS_SQL} USING (section)", MEMBERS_SQL, INVOKED))(
    lambda s, d: pack.elements_check(_sections(s, d), sections(s)))


def _areas(s, d):
    df = m.cases(s, d, ["crime_sub_head", "district", "latitude", "longitude"])
    return spatial.hottest(spatial.hotspots(df, "latitude", "longitude", RES, (F.col("crime_sub_head") == "BUILDING") & (F.col("district") == "ASIA")))


@q("p5_outlook")
def _outlook(s, d):
    """Next week and areas for one district and head."""
    rows = fc.forecast(series(s, d).where("district = 'ASIA' AND crime_head = '1-URGENT'"), BY)
    return pack.outlook(cut(rows, "forecast"), _areas(s, d))


q("p6_leads", m.sql(f"""
SELECT 1::BIGINT AS rank, 'Prioritise surveillance of ' || full_name || ' (' || person_key || ')' AS lead, format('Highest risk score {{:.3f}}', score) AS rationale FROM
  (SELECT person_key, full_name, score FROM support JOIN scored USING (person_key) JOIN registry USING (person_key) ORDER BY support DESC, score DESC, person_key LIMIT 1)
UNION ALL SELECT 2, 'Cross-check MO against similar historical cases for recovery leads', format('{{}} cases share the narrative MO signature (top similarity {{:.3f}}).', count(*), max(similarity)) FROM {SIM_SQL} -- entity_history""",
                    SCORE_CTE, SUPPORT_CTE))(lambda s, d: pack.leads(_suspects(s, d), _similar(s, d)))


@q("p7_summary", m.sql("""
SELECT 'SH-03' AS series_id, 'Series SH-03: recurring MO. ' || (SELECT count(*) FROM members) || ' linked cases across ' ||
  (SELECT array_to_string(list_sort(list(DISTINCT district)), ', ') FROM case_360 WHERE case_id IN (SELECT case_id FROM members)) || ' (confidence 0.750). Prime suspect: ' || full_name ||
  format(' (risk {:.3f}). ', score) || 'Projected next activity window: next 1-2 weeks.' AS summary FROM (SELECT full_name, score, support, person_key FROM support JOIN scored USING (person_key)
  JOIN registry USING (person_key) ORDER BY support DESC, score DESC, person_key LIMIT 1) -- entity_history""", SCORE_CTE, SUPPORT_CTE))
def _summary(s, d):
    own = m.cases(s, d, ["case_id", "district"]).join(members(s, d), "case_id", "left_semi")
    head = own.agg(F.sort_array(F.collect_set("district")).alias("districts")).select(
        F.lit("SH-03").alias("series_id"), F.lit("recurring MO").alias("summary"), members(s, d).agg(F.count(F.lit(1))).scalar().alias("size"),
        "districts", F.lit(0.75).alias("confidence"))
    return pack.summary(head, _suspects(s, d))


# ---- streaming --------------------------------------------------------------------


def _stream(s, d):
    return jobs.read_files(m.prepare(s), d, m.SCHEMAS["events"], "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@q("st1_sweep", SPIKE_SQL.format(min_recent=6) + _SP + " ORDER BY z DESC, event_type, user_id LIMIT 8")
def _sweep(s, d):
    """The events arrive in three parts, oldest first; the leads of the last sweep are those of all events."""
    files, out, store, state = (scratch_path(s, f"sweep-{n}") for n in ("arrivals", "leads", "counts", "state"))
    events = m.table(s, d, "events").withColumn("day", F.to_date("ts"))
    days = events.select("day").distinct().withColumn("third", F.ntile(3).over(Window.orderBy("day")))  # a row per day
    by = ["event_type", "user_id"]
    find = lambda counts, _: _sp_cols(detect.spikes(counts, "day", by, AS_OF, START, window_days=7, weight="n"))
    for i in (1, 2, 3):
        events.join(days.where(F.col("third") == i).select("day"), "day").drop("day").write.mode("append").parquet(files)
        stream = jobs.read_files(m.prepare(s), files, m.SCHEMAS["events"]).withColumn("ts", F.col("ts").cast("timestamp"))
        jobs.remembering_sweep(stream, "ts", by, find, store, out, state, fold_every=2).awaitTermination()
    return jobs.latest_leads(s, out)


WINDOWS_SQL = """SELECT window_start, window_start + INTERVAL 14 DAY AS window_end, event_type, count(*) AS n FROM
(SELECT event_type, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY * unnest(range(0, 14)) AS window_start FROM events)
{0} GROUP BY ALL"""


@q("st2_window_counts", WINDOWS_SQL.format("WHERE window_start + INTERVAL 14 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY"))
def _windows(s, d):
    out = scratch_path(s, "windows")
    counts = jobs.window_counts(_stream(s, d), "ts", ["event_type"])
    jobs.write_once(counts, out, scratch_path(s, "windows-state")).awaitTermination()
    return s.read.parquet(out)


q("st2_batch_twin", WINDOWS_SQL.format(""))(lambda s, d: jobs.window_counts(m.table(s, d, "events"), "ts", ["event_type"]))


@q("st3_audit_ingest", "SELECT event_id AS audit_id, user_id, event_type AS action FROM events")
def _ingest(s, d):
    out = scratch_path(s, "audit")
    rows = _stream(s, d).select(F.col("event_id").alias("audit_id"), "ts", "user_id", F.col("event_type").alias("action"))
    again = _stream(s, d).select(F.col("event_id").alias("audit_id"), "ts", "user_id", F.col("event_type").alias("action"))
    clean = jobs.deduplicated_audit(rows.unionByName(again))
    jobs.write_once(clean, out, scratch_path(s, "audit-state"), partition_by="day").awaitTermination()
    return s.read.parquet(out).select("audit_id", "user_id", "action")


# ---- sources and sinks ------------------------------------------------------------


@q("src1_load_tables", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'nation', count(*) FROM nation")
def _load(s, d):
    loaded = tables.read_tables(s, d, {"orders": m.SCHEMAS["orders"], "nation": m.SCHEMAS["nation"], "_internal": None})
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in loaded.items()]
    return parts[0].unionByName(parts[1])


@q("src3_views_by_name", m.sql("SELECT district, count(*) AS n FROM case_360 GROUP BY district"))
def _by_name(s, d):
    tables.register({"case_360": m.cases(s, d, ["case_id", "district"])})
    return s.table("case_360").groupBy("district").agg(F.count(F.lit(1)).alias("n"))


@q("src4_snk1_csv_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def _csv(s, d):
    out = scratch_path(s, "csv")
    tables.export_csv({"customer": m.table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "_skipped": s.range(1)}, out)
    return tables.read_csv(s, f"{out}/customer.csv", ["c_custkey", "c_name", "c_mktsegment"])


@q("snk2_catalog_load", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def _catalog(s, d):
    out, name = scratch_path(s, "csv"), f"supplier_{uuid.uuid4().hex[:12]}"
    tables.export_csv({name: m.table(s, d, "supplier").select("s_suppkey", "s_name")}, out)
    columns = {name: ["s_suppkey", "s_name"], "absent": ["x"], "not_wanted": ["x"]}
    tables.load_into_catalog(s, out, columns, truncate=True, only=[name, "absent"])
    return s.table(name)


@q("snk3_vector_json", f"SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(list_dot_product({E64}, {E64}), 4) AS square FROM embeddings")
def _vector_json(s, d):
    out = scratch_path(s, "csv")
    tables.export_csv({"embeddings": m.table(s, d, "embeddings").select("vec_id", "embedding")}, out)
    back = tables.vectors_from_json(tables.read_csv(s, f"{out}/embeddings.csv", ["vec_id", "embedding"]), "embedding")
    return back.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.size("embedding").alias("n"), F.round(vec.dot("embedding", "embedding"), 4).alias("square"))


@q("snk4_json_labels", "SELECT doc_id, quality, toxic FROM labels")
def _json(s, d):
    out = scratch_path(s, "labels")
    tables.write_json(m.table(s, d, "labels"), out)
    return s.read.schema(m.SCHEMAS["labels"]).json(out)


@q("snk5_case_vectors", "SELECT doc_id, lang, 'night' AS tod_bucket, CAST(64 AS INT) AS dim FROM documents")
def _case_vectors(s, d):
    out = scratch_path(s, "case-vectors")
    docs = m.table(s, d, "documents").select("doc_id", "lang", "text").withColumns(
        {"ts": F.lit(None).cast("timestamp"), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})
    featured = lk.extract_features(lk.text_vectors(docs, "text", 64), "text", "ts", "lat", "lon")
    tables.write_case_vectors(featured.select("doc_id", "lang", "features", "embedding"), out, "lang")
    return s.read.parquet(out).select("doc_id", "lang", "features.tod_bucket", F.size("embedding").alias("dim"))


@q("snk6_audit_append", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def _audit(s, d):
    out = scratch_path(s, "audit-table")
    log = m.table(s, d, "events").select(F.uuid().alias("audit_id"), "ts", F.col("user_id").cast("string").alias("user_id"), F.lit("ANALYST").alias("role"),
                                         F.col("event_type").alias("action"), F.col("props").alias("detail"))
    audit.append(log, out)
    return s.read.parquet(out).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
