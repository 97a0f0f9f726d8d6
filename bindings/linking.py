"""Similarity search, record linkage and series on whole tables.

Linkable case: an open order. vehicle = priority, target = first return flag, tod = time
bucket of a derived hour, dow = weekday; its vector holds the quantities per return flag.
"""
from __future__ import annotations


from pyspark.sql import functions as F

from caseweave.functions import fixed_values as fx, temporal as tm, vectors as vec
from caseweave.operators import clusters, hierarchy, linkage as lk, neighbours as nb
from caseweave.plans.lineage import cut

from . import model as m
from .analytics import hex_sql
from .registry import Registry
from .scalars import E64, HAVERSINE_SQL, TOD_SQL, cue_sql

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
q = R.add

R3 = "CAST(format('{{:.3f}}', {0}) AS DOUBLE)"

# ---- nearest neighbours -----------------------------------------------------------

q("k1_similar", f"""SELECT e.vec_id, {R3.format(f'list_dot_product({E64.replace("embedding", "e.embedding")}, {E64.replace("embedding", "p.embedding")})')} AS similarity
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 17) p WHERE e.vec_id <> 17
ORDER BY list_dot_product({E64.replace("embedding", "e.embedding")}, {E64.replace("embedding", "p.embedding")}) DESC, e.vec_id LIMIT 5""")(
    lambda s, d: nb.similar(m.table(s, d, "embeddings"), "vec_id", "embedding", 17, 5))

q("k1_similar_missing", "SELECT vec_id, 0.0::DOUBLE AS similarity FROM embeddings WHERE vec_id < 0")(
    lambda s, d: nb.similar(m.table(s, d, "embeddings"), "vec_id", "embedding", -5, 5))

UNIT_CTE = f"v AS (SELECT vec_id, label, list_transform({E64}, lambda x: x / (sqrt(list_dot_product({E64}, {E64})) + 1e-9)) AS u FROM embeddings)"
KNN_CTE = f"""{UNIT_CTE},
knn AS (SELECT query, neighbour, sim FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_dot_product(a.u, b.u) AS sim,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.u, b.u) DESC, b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id) WHERE r <= 12)"""
q("k2_knn", m.sql("SELECT query, neighbour, round(sim, 6) AS similarity FROM knn", KNN_CTE))(
    lambda s, d: nb.pivot_knn(m.table(s, d, "embeddings"), m.table(s, d, "embeddings"), "vec_id", "embedding", 12)
    .withColumn("similarity", F.round("similarity", 6)))
q("k2_knn_within_label", m.sql(
    "SELECT query, neighbour, round(sim, 6) AS similarity FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_dot_product(a.u, b.u) AS sim, "
    "row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.u, b.u) DESC, b.vec_id) AS r FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id) "
    "WHERE r <= 5", UNIT_CTE))(
    lambda s, d: nb.knn(m.table(s, d, "embeddings"), m.table(s, d, "embeddings"), "vec_id", "embedding", 5, within="label")
    .withColumn("similarity", F.round("similarity", 6)))
q("k2_support", m.sql(f"SELECT person_key, round(sum(s), 3) AS support FROM (SELECT neighbour, {R3.format('sim')} AS s FROM knn WHERE {R3.format('sim')} >= 0.3) k "
                      "JOIN (SELECT l_orderkey AS neighbour, l_suppkey AS person_key FROM lineitem) USING (neighbour) GROUP BY person_key", KNN_CTE))(
    lambda s, d: nb.support(
        m.table(s, d, "embeddings").withColumnRenamed("vec_id", "case_id"), m.table(s, d, "embeddings").withColumnRenamed("vec_id", "case_id"),
        m.accused(s, d), min_sim=0.3).withColumn("support", F.round("support", 3)))

# ---- features and vectors ---------------------------------------------------------

q("k3_features", f"""SELECT c.conv_id, c.turn, 'night' AS tod_bucket, 0 AS dow, {cue_sql('text', fx.VEHICLE_CUES)} AS vehicle, {cue_sql('text', fx.TARGET_CUES)} AS target,
{cue_sql('text', fx.WEAPON_CUES)} AS weapon, {cue_sql('text', fx.ENTRY_CUES)} AS entry FROM conversations c""")(
    lambda s, d: lk.extract_features(
        m.table(s, d, "conversations").withColumn("ts", F.lit(None).cast("timestamp")).withColumn("lat", F.lit(None).cast("double")).withColumn("lon", F.lit(None).cast("double")),
        "text", "ts", "lat", "lon").select("conv_id", "turn", "features.tod_bucket", "features.dow", "features.vehicle", "features.target", "features.weapon", "features.entry"))


# hour, weekday and cell of an event that bears the conversation's number; the place is that of its user
q("k3_features_placed", f"""SELECT c.conv_id, c.turn, {TOD_SQL.format('e.ts')} AS tod_bucket, CAST(isodow(e.ts) - 1 AS INT) AS dow, {hex_sql(m.lat_sql('e.user_id'), m.lon_sql('e.user_id'), 8)} AS cell,
{cue_sql('text', fx.WEAPON_CUES)} AS weapon FROM conversations c JOIN events e ON e.event_id = c.conv_id""")(
    lambda s, d: lk.extract_features(_placed(s, d), "text", "ts", "lat", "lon").select("conv_id", "turn", "features.tod_bucket", "features.dow", "features.cell", "features.weapon"))


def _placed(s, d):
    events = m.table(s, d, "events").select(F.col("event_id").alias("conv_id"), "ts", m._lat("user_id").alias("lat"), m._lon("user_id").alias("lon"))
    return m.table(s, d, "conversations").join(events, "conv_id")


GRAMS = 64
K4_CTE = f"""
c AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t, row_number() OVER () AS rid FROM conversations),
g AS (SELECT rid, ('0x' || substr(md5(substr(t, i, 3)), 1, 8))::UBIGINT % {GRAMS} AS bucket FROM (SELECT rid, t, unnest(range(1, length(t) - 1)) AS i FROM c)),
tf AS (SELECT rid, bucket, count(*) AS n FROM g GROUP BY ALL),
idf AS (SELECT bucket, ln(((SELECT count(*) FROM c) + 1)::DOUBLE / (count(*) + 1)) AS w FROM tf GROUP BY bucket),
tw AS (SELECT rid, bucket, n * w AS w FROM tf JOIN idf USING (bucket)),
len AS (SELECT rid, sqrt(sum(w * w)) AS l FROM tw GROUP BY rid)"""
q("k4_text_vectors", m.sql("SELECT conv_id, turn, CAST(bucket AS INT) AS bucket, round(w / l, 6) + 0.0 AS weight FROM tw JOIN len USING (rid) JOIN c USING (rid) WHERE abs(w / l) > 1e-6", K4_CTE))(
    lambda s, d: lk.text_vectors(m.table(s, d, "conversations"), "text", GRAMS).select("conv_id", "turn", F.posexplode("embedding").alias("bucket", "weight"))
    .where("abs(weight) > 1e-6").withColumn("weight", F.round("weight", 6)))

# ---- linkable cases ---------------------------------------------------------------


def open_cases(s, d):
    """Open cases that have a vector, with their features."""
    qty = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0))
    vectors = m.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.array(qty("A"), qty("N"), qty("R")).alias("embedding"))
    base = m.cases(s, d, ["case_id", "registered", "case_status", "crime_head", "crime_sub_head", "district", "latitude", "longitude", "final_report_type"])
    return (base.where("case_status = 'O'").join(vectors, "case_id")
            .withColumns({"vehicle": F.col("crime_head"), "target": F.col("final_report_type"),
                          "tod": tm.tod_bucket((F.col("case_id") * 7 % 24).cast("int")), "dow": F.weekday("registered")}))


OPEN_CTE = f"""
oc AS (SELECT c.case_id, c.registered, c.crime_sub_head, c.district, c.latitude, c.longitude, c.crime_head AS vehicle, c.final_report_type AS target,
  {TOD_SQL.format("c.hr").replace("hour(c.hr)", "c.hr")} AS tod, CAST(isodow(c.registered) - 1 AS INT) AS dow, v.u, v.raw
  FROM (SELECT *, case_id * 7 % 24 AS hr FROM case_360) c JOIN (SELECT l_orderkey, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-9)) AS u, e AS raw FROM (SELECT l_orderkey,
    [coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0), coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0),
     coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0)]::DOUBLE[] AS e FROM lineitem GROUP BY 1)) v ON v.l_orderkey = c.case_id WHERE c.case_status = 'O')"""
PAIRS_CTE = OPEN_CTE + f""",
raw_pairs AS (SELECT a.crime_sub_head AS block, a.case_id AS a, b.case_id AS b, CAST(abs(date_diff('day', a.registered, b.registered)) AS INT) AS days,
  {HAVERSINE_SQL.format('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS km, (a.vehicle = b.vehicle)::INT AS same_vehicle, (a.target = b.target)::INT AS same_target,
  (a.tod = b.tod)::INT AS same_tod, (a.dow = b.dow)::INT AS same_dow, list_dot_product(a.u, b.u) AS cosine
  FROM oc a JOIN oc b ON a.crime_sub_head = b.crime_sub_head AND a.case_id < b.case_id AND abs(date_diff('day', a.registered, b.registered)) <= 180),
pairs AS (SELECT *, 0.2 * cosine + (0.15 * (1 - least(km, 120.0) / 120.0) + 0.4 * same_vehicle + 0.05 * same_target + 0.2 * same_tod + 0.0 * same_dow) AS score
  FROM raw_pairs WHERE km <= 120.0)"""
THRESHOLD = 0.80  # above the default of 0.65, because the features here are random
LINKED_CTE = PAIRS_CTE + f",\nlinked AS (SELECT * FROM pairs WHERE score >= {THRESHOLD})"
COMP_CTE = LINKED_CTE + """,
sym AS (SELECT a AS x, b AS y FROM linked UNION SELECT b, a FROM linked),
reach AS (SELECT x, x AS y FROM (SELECT DISTINCT x FROM sym) UNION SELECT r.x, s.y FROM reach r JOIN sym s ON s.x = r.y),
comp AS (SELECT x AS case_id, min(y) AS component FROM reach GROUP BY x),
members AS (SELECT * FROM comp WHERE component IN (SELECT component FROM comp GROUP BY component HAVING count(*) >= 4)),
best AS (SELECT component, case_id, max(score) AS best FROM (SELECT m.component, m.case_id, l.score FROM members m JOIN linked l ON l.a = m.case_id OR l.b = m.case_id) GROUP BY ALL),
conf AS (SELECT component, count(*) AS size, avg(best) AS confidence FROM best GROUP BY component HAVING avg(best) >= 0.55 AND count(*) >= 4)"""


def _linked(s, d):
    df = cut(open_cases(s, d), "open-cases")
    pairs = lk.candidate_pairs(df, threshold=THRESHOLD, vectors=True)
    return df, lk.score_pairs(pairs, df, threshold=THRESHOLD)


def _strongest(s, d):
    """(open cases, links that hold every record's strongest one and connect what all links connect)"""
    df = cut(open_cases(s, d), "open-cases")
    return df, cut(lk.strongest_pairs(df, threshold=THRESHOLD), "linked")


def _members(s, d):
    """(open cases, strongest links, members)"""
    df, linked = _strongest(s, d)
    comp = clusters.components(linked, "a", "b", node="case_id")
    return df, linked, clusters.of_size(comp, "component", fx.CLUSTER_MIN_SIZE)


q("l1_candidates", m.sql("SELECT case_id, crime_sub_head, vehicle, target, tod, dow FROM oc -- case_360", OPEN_CTE))(
    lambda s, d: open_cases(s, d).select("case_id", "crime_sub_head", "vehicle", "target", "tod", "dow"))
q("l2_block_sizes", m.sql("SELECT case_id FROM oc WHERE vehicle || district IN (SELECT vehicle || district FROM oc GROUP BY 1 HAVING count(*) >= 4) -- case_360", OPEN_CTE))(
    lambda s, d: lk.blocks_of_size(open_cases(s, d).withColumn("block", F.concat("vehicle", "district")), "block", 4).select("case_id"))
_pair_sql = "SELECT block, a, b, days, round(km, 5) AS km, same_vehicle::DOUBLE AS same_vehicle, same_tod::DOUBLE AS same_tod{} FROM {} -- case_360"
_pair_cols = lambda: ["block", "a", "b", "days", F.round("km", 5).alias("km"), "same_vehicle", "same_tod"]
q("j7_blocked_pairs", m.sql(_pair_sql.format("", "pairs"), PAIRS_CTE))(
    lambda s, d: lk.candidate_pairs(cut(open_cases(s, d), "open-cases")).select(*_pair_cols()))
q("j9_band_join", m.sql("SELECT a, b, days FROM raw_pairs WHERE km <= 20.0 -- case_360", PAIRS_CTE))(
    lambda s, d: lk.candidate_pairs(cut(open_cases(s, d), "open-cases"), rules=lk.Rules(max_km=20.0)).select("a", "b", "days"))


@q("l3_scored_pairs", m.sql(_pair_sql.format(", round(cosine, 6) AS cosine, round(score, 6) AS score", "pairs"), PAIRS_CTE))
def _scored(s, d):
    df = cut(open_cases(s, d), "open-cases")
    return lk.score_pairs(lk.candidate_pairs(df, vectors=True), df).select(*_pair_cols(), F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


q("l4_linked_pairs", m.sql("SELECT a, b, round(score, 6) AS score FROM linked -- case_360", LINKED_CTE))(
    lambda s, d: _linked(s, d)[1].select("a", "b", F.round("score", 6).alias("score")))
q("l5_components", m.sql("SELECT case_id, component FROM members -- case_360", COMP_CTE))(lambda s, d: _members(s, d)[2])


def _confident(s, d):
    df, linked, members = _members(s, d)
    return df, linked, members, lk.confidence(members, linked)


q("l6_confidence", m.sql("SELECT component, size, round(confidence, 6) AS confidence FROM conf -- case_360", COMP_CTE))(
    lambda s, d: _confident(s, d)[3].withColumn("confidence", F.round("confidence", 6)))


@q("l7_evidence_links", m.sql(f"""
SELECT component, a, b, {R3.format('cosine')} AS cosine, concat_ws('|', CASE WHEN va = vb THEN 'vehicle:' || va END, CASE WHEN ta = tb THEN 'target:' || ta END,
       CASE WHEN oa = ob THEN 'tod:' || oa END) AS shared
FROM (SELECT x.component, x.case_id AS a, y.case_id AS b, list_dot_product(p.u, q.u) AS cosine, p.vehicle AS va, q.vehicle AS vb, p.target AS ta, q.target AS tb, p.tod AS oa, q.tod AS ob,
   row_number() OVER (PARTITION BY x.component ORDER BY round(list_dot_product(p.u, q.u), 9) DESC, x.case_id, y.case_id) AS r
   FROM members x JOIN members y ON x.component = y.component AND x.case_id < y.case_id JOIN oc p ON p.case_id = x.case_id JOIN oc q ON q.case_id = y.case_id)
WHERE r <= 12 -- case_360""", COMP_CTE))
def _evidence(s, d):
    df, _, members = _members(s, d)
    members = cut(members, "members")
    pairs = lk.member_pairs(members, df).withColumn("cosine", F.round("cosine", 9))
    links = lk.evidence_links(pairs, df)
    return links.select("component", "a", "b", "cosine", F.array_join("shared_features", "|").alias("shared"))


SERIES_CTE = COMP_CTE + """,
summ AS (SELECT component, crime_sub_head, districts, first_date, last_date, vehicle, target, tod FROM
  (SELECT component, min(crime_sub_head) AS crime_sub_head, list_sort(list(DISTINCT district)) AS districts, min(registered) AS first_date, max(registered) AS last_date
   FROM members JOIN oc USING (case_id) GROUP BY component)
  JOIN (SELECT component, vehicle FROM (SELECT component, vehicle, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, vehicle) r FROM members JOIN oc USING (case_id) GROUP BY component, vehicle) WHERE r = 1) USING (component)
  JOIN (SELECT component, target FROM (SELECT component, target, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, target) r FROM members JOIN oc USING (case_id) GROUP BY component, target) WHERE r = 1) USING (component)
  JOIN (SELECT component, tod FROM (SELECT component, tod, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, tod) r FROM members JOIN oc USING (case_id) GROUP BY component, tod) WHERE r = 1) USING (component)),
series AS (SELECT component, crime_sub_head, districts, first_date, last_date, vehicle, target, tod, size, round(confidence, 6) AS confidence,
  'SH-' || lpad(CAST(row_number() OVER (ORDER BY round(confidence, 6) DESC, component) AS VARCHAR), 2, '0') AS series_id FROM summ JOIN conf USING (component))"""


def _series(s, d):
    df, linked, members, conf = _confident(s, d)
    summ = lk.summarise(members, df).drop("size").join(conf.withColumn("confidence", F.round("confidence", 6)), "component")
    return df, members, cut(lk.assign_ids(summ), "series")


q("l8_series_summary", m.sql("SELECT component, crime_sub_head, array_to_string(districts, ',') AS districts, first_date, last_date, "
                             "'vehicle=' || vehicle || '; target=' || target || '; time=' || tod AS summary FROM series -- case_360", SERIES_CTE))(
    lambda s, d: _series(s, d)[2].select("component", "crime_sub_head", F.array_join("districts", ",").alias("districts"), "first_date", "last_date", "summary"))
q("l9_series_ids", m.sql("SELECT series_id, component, size, confidence, crime_sub_head || ' series — ' || array_to_string(districts[1:3], ', ') AS name FROM series -- case_360", SERIES_CTE))(
    lambda s, d: _series(s, d)[2].select("series_id", "component", "size", "confidence", "name"))


@q("l10_series_of_records", m.sql("SELECT series_id, case_id FROM series JOIN members USING (component) -- case_360", SERIES_CTE))
def _of_records(s, d):
    _, members, series = _series(s, d)
    return members.join(series.select("component", "series_id"), "component").select("series_id", "case_id")


@q("l11_feedback", m.sql("SELECT series_id, CASE crime_sub_head WHEN 'BUILDING' THEN 'confirmed' WHEN 'MACHINERY' THEN 'rejected' ELSE 'open' END AS status FROM series -- case_360", SERIES_CTE))
def _feedback(s, d):
    _, _, series = _series(s, d)
    verdict = F.when(F.col("crime_sub_head") == "BUILDING", "confirm").when(F.col("crime_sub_head") == "MACHINERY", "reject")
    # every series was first rejected, then judged again
    notes = series.select("series_id", F.lit("reject").alias("verdict"), F.lit(1).alias("ts"), verdict.alias("_v")).where("_v IS NOT NULL")
    notes = notes.drop("_v").unionByName(series.select("series_id", verdict.alias("verdict"), F.lit(2).alias("ts")).where("verdict IS NOT NULL"))
    return lk.apply_feedback(series, notes).select("series_id", "status")


@q("l12_rescan_and_list", m.sql("SELECT series_id, confidence FROM series -- case_360", SERIES_CTE))
def _rescan(s, d):
    from caseweave.plans.lineage import scratch_path
    path = scratch_path(s, "series-store")
    _, _, series = _series(s, d)
    lk.save_series(series.select("series_id", "confidence"), path)
    lk.save_series(series.select("series_id", "confidence"), path)
    return lk.stored_series(s, path).orderBy(F.desc("confidence"))


FOREST_LEVELS = (0.80, 0.85, 0.90)


@q("l5_forest_components", m.sql("SELECT t AS threshold, case_id, component FROM at_level -- case_360", LINKED_CTE + f"""
,
level_sym AS (SELECT t, a AS x, b AS y FROM linked, (VALUES {', '.join(f'({t}::DOUBLE)' for t in FOREST_LEVELS)}) v(t) WHERE score >= t UNION SELECT t, b, a FROM linked, (VALUES {', '.join(f'({t}::DOUBLE)' for t in FOREST_LEVELS)}) v(t) WHERE score >= t),
level_reach AS (SELECT t, x, x AS y FROM (SELECT DISTINCT t, x FROM level_sym) UNION SELECT r.t, r.x, s.y FROM level_reach r JOIN level_sym s ON s.t = r.t AND s.x = r.y),
at_level AS (SELECT t, x AS case_id, min(y) AS component FROM level_reach GROUP BY t, x)"""))
def _forest_components(s, d):
    """The spanning forest alone gives the components of all linked pairs at every level."""
    _, linked = _strongest(s, d)
    forest = hierarchy.spanning_forest(linked.select("a", "b", (1.0 - F.col("score")).alias("d")))
    out = None
    for t in FOREST_LEVELS:
        part = clusters.components(forest.where(F.col("d") <= 1.0 - t), "a", "b", node="case_id").select(F.lit(t).alias("threshold"), "case_id", "component")
        out = part if out is None else out.unionByName(part)
    return out


def _hierarchy_members(s, d):
    """(open cases, members of the clusters selected from the hierarchy of all pairs)"""
    df = cut(open_cases(s, d), "open-cases")
    forest = cut(lk.strongest_pairs(df, clipped=True), "scored")
    found = hierarchy.hierarchy(forest, df.select(F.col("case_id").alias("node"), "crime_sub_head"), block="crime_sub_head")
    return df, cut(found.select(F.col("node").alias("case_id"), F.col("cluster").alias("component")), "members")


def _clusters(s, d):
    """(open cases, all scored pairs, members of the clusters selected from their hierarchy)"""
    df, members = _hierarchy_members(s, d)
    return df, lk.score_pairs(lk.candidate_pairs(df, vectors=True), df), members


def _strongest_inside(df, members):
    """Every member's highest score with another one of its cluster, as a pair with itself; only pairs inside a cluster are formed."""
    rules = lk.Rules()
    own = lk.blocks_of_size(df, "crime_sub_head", rules.min_block).join(members, "case_id").withColumn("inside", F.struct("crime_sub_head", "component"))
    fields, rules = lk.Fields(block="inside"), lk.Rules(min_block=1)
    pairs = lk.strongest_pairs(own, fields, rules)
    best = pairs.select(F.explode(F.array("a", "b")).alias("a"), "score").groupBy("a").agg(F.max("score").alias("score"))
    return best.select("a", F.col("a").alias("b"), "score")


@q("l5_hierarchy")
def _hierarchy(s, d):
    """Checked against brute force in the tests."""
    return _hierarchy_members(s, d)[1].select(F.col("case_id").alias("node"), F.col("component").alias("cluster"))


@q("l9_hierarchy_series")
def _hierarchy_series(s, d):
    """Named series of the hierarchy's clusters with their confidence, summary and number of evidence links."""
    df, members = _hierarchy_members(s, d)
    conf = lk.confidence(members, _strongest_inside(df, members)).withColumn("confidence", F.round("confidence", 6))
    series = cut(lk.assign_ids(lk.summarise(members, df).drop("size").join(conf, "component")), "series")
    best = lk.member_pairs(members, df).withColumn("cosine", F.round("cosine", 9))
    links = lk.evidence_links(best, df).groupBy("component").agg(F.count(F.lit(1)).alias("links"))
    return series.join(links, "component", "left").select("series_id", "component", "size", "confidence", "name", "summary", "links")
