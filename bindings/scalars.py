"""Scalar functions on whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.functions import fixed_values as fx, geo, keys as K, rounding, temporal as tm, text as tx, vectors as vec

from . import model as m
from .registry import Registry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
q = R.add

BIGRAMS_SQL = ("list_distinct(list_transform(list_zip(t[1:len(t)-1], t[2:]), lambda z: z[1] || ' ' || z[2]))")
TOKENS_SQL = "regexp_extract_all(lower(text), '[a-z]+')"

q("x1_year_month", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS yr, CAST(month(o_orderdate) AS INT) AS mo FROM orders")(
    lambda s, d: m.table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo")))

q("x2_date_trunc", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, "
                   "CAST(date_trunc('week', l_shipdate) AS DATE) AS week FROM lineitem")(
    lambda s, d: m.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", tm.month_start("l_shipdate").alias("month"),
                                                  tm.week_start("l_shipdate").alias("week")))

q("x3_casts_and_literals", "SELECT event_id, CAST(ts AS DATE) AS day, CAST(ts AS DATE) >= DATE '2024-01-15' AS late FROM events "
                           "WHERE ts <= now()::TIMESTAMP")(
    lambda s, d: m.table(s, d, "events").where(F.col("ts") <= F.current_timestamp().cast("timestamp_ntz")).select(
        "event_id", F.col("ts").cast("date").alias("day"), (F.col("ts").cast("date") >= F.lit("2024-01-15").cast("date")).alias("late")))

q("x4_days_apart", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(abs(date_diff('day', o_orderdate, l_shipdate)) AS INT) AS days "
                   "FROM lineitem JOIN orders ON o_orderkey = l_orderkey")(
    lambda s, d: m.table(s, d, "lineitem").join(m.table(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    .select("l_orderkey", "l_linenumber", "l_partkey", tm.days_apart("o_orderdate", "l_shipdate").alias("days")))

q("x5_hour_weekday", "SELECT event_id, CAST(coalesce(hour(ts), 0) AS INT) AS hr, CAST(coalesce(isodow(ts) - 1, 0) AS INT) AS dow FROM events")(
    lambda s, d: m.table(s, d, "events").select("event_id", tm.hour_or_zero("ts").alias("hr"), tm.weekday_or_zero("ts").alias("dow")))

TOD_SQL = ("CASE WHEN hour({0}) <= 5 THEN 'night' WHEN hour({0}) <= 11 THEN 'morning' WHEN hour({0}) <= 16 THEN 'afternoon' "
           "WHEN hour({0}) <= 20 THEN 'evening' ELSE 'late_evening' END")
q("x6_tod_bucket", f"SELECT event_id, {TOD_SQL.format('ts')} AS bucket FROM events")(
    lambda s, d: m.table(s, d, "events").select("event_id", tm.tod_bucket(tm.hour_or_zero("ts")).alias("bucket")))

q("x7_lower_like_contains", "SELECT doc_id, lower(source) LIKE 'src1%' AS like_hit, contains(lower(text), 'ther') AS has_ther FROM documents")(
    lambda s, d: m.table(s, d, "documents").select(
        "doc_id", F.lower("source").like("src1%").alias("like_hit"), F.lower("text").contains("ther").alias("has_ther")))


def cue_sql(column: str, table) -> str:
    parts = [f"WHEN " + " OR ".join(f"contains(lower({column}), '{c.lower()}')" for c in cues) + f" THEN '{label}'"
             for label, cues in table.items()]
    return "CASE " + " ".join(parts) + " END"


q("x8_cue_labels", f"SELECT doc_id, {cue_sql('text', fx.VEHICLE_CUES)} AS vehicle, {cue_sql('text', fx.TARGET_CUES)} AS target, "
                   f"{cue_sql('text', fx.ENTRY_CUES)} AS entry, {cue_sql('text', fx.WEAPON_CUES)} AS weapon FROM documents")(
    lambda s, d: m.table(s, d, "documents").select(
        "doc_id", tx.cue_label("text", fx.VEHICLE_CUES).alias("vehicle"), tx.cue_label("text", fx.TARGET_CUES).alias("target"),
        tx.cue_label("text", fx.ENTRY_CUES).alias("entry"), tx.cue_label("text", fx.WEAPON_CUES).alias("weapon")))

IDENT = r"\b\d{3,5}-\d[\dX]{3,}\b"
q("x9_identifiers", f"SELECT doc_id, unnest(regexp_extract_all(text, '{IDENT}')) AS ident FROM documents")(
    lambda s, d: m.table(s, d, "documents").select("doc_id", F.explode(tx.identifiers("text", IDENT)).alias("ident")))

q("x10_bigrams", f"SELECT conv_id, turn, CAST(len(t) AS INT) AS n_tokens, CAST(len({BIGRAMS_SQL}) AS INT) AS n_bigrams, "
                 f"list_aggregate(list_sort({BIGRAMS_SQL}), 'string_agg', '|') AS grams FROM "
                 f"(SELECT conv_id, turn, {TOKENS_SQL} AS t FROM conversations)")(
    lambda s, d: m.table(s, d, "conversations").select("conv_id", "turn", tx.tokens("text").alias("t"))
    .select("conv_id", "turn", F.size("t").alias("n_tokens"), tx.bigrams_of(F.col("t")).alias("g"))
    .select("conv_id", "turn", "n_tokens", F.size("g").alias("n_bigrams"),
            F.when(F.size("g") > 0, F.array_join(F.sort_array("g"), "|")).alias("grams")))

STOP_SQL = "[" + ", ".join(f"'{p}'" for p in fx.STOP_PHRASES) + "]"
q("x11_shared_phrases", f"""
WITH g AS (SELECT conv_id, turn, {BIGRAMS_SQL} AS b FROM (SELECT conv_id, turn, {TOKENS_SQL} AS t FROM conversations)),
c AS (SELECT x.conv_id, x.turn, list_filter(list_intersect(x.b, y.b), lambda p: NOT list_contains({STOP_SQL}, p)) AS common
      FROM g x JOIN g y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1),
r AS (SELECT conv_id, turn, p, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(p) DESC, p) AS k
      FROM (SELECT conv_id, turn, unnest(common) AS p FROM c))
SELECT conv_id, turn, string_agg(p, '|' ORDER BY k) AS phrases FROM r WHERE k <= 3 GROUP BY conv_id, turn""")(
    lambda s, d: m.table(s, d, "conversations").alias("x").join(
        m.table(s, d, "conversations").alias("y"),
        (F.col("x.conv_id") == F.col("y.conv_id")) & (F.col("y.turn") == F.col("x.turn") + 1))
    .select("x.conv_id", "x.turn", tx.shared_phrases("x.text", "y.text").alias("p")).where(F.size("p") > 0)
    .select("conv_id", "turn", F.array_join("p", "|").alias("phrases")))

KEY_SQL = ("CAST(o_orderpriority[1] AS VARCHAR) || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') "
           "|| CAST(year(o_orderdate) AS VARCHAR) || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0')")


def keyed(s, d):
    """Orders with a composite key built from their own columns."""
    joined = m.table(s, d, "orders").join(m.table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("category"), F.year("o_orderdate").alias("yr"), "c_nationkey",
        K.case_key(F.substring("o_orderpriority", 1, 1), "c_nationkey", F.col("c_custkey") % 10000, F.year("o_orderdate"),
                   F.col("o_orderkey") % 100000).alias("case_key"),
        K.case_number(F.year("o_orderdate"), F.col("o_orderkey") % 100000).alias("case_no"))


q("x12_case_key_build", f"SELECT o_orderkey, {KEY_SQL} AS case_key, CAST(year(o_orderdate) AS VARCHAR) || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') "
                        "AS case_no FROM orders JOIN customer ON c_custkey = o_custkey")(
    lambda s, d: keyed(s, d).select("o_orderkey", "case_key", "case_no"))

q("x13_case_key_parse", f"SELECT o_orderkey, CAST(substr(k, 1, 1) AS INT) AS category, CAST(substr(k, 2, 4) AS INT) AS district, CAST(substr(k, 6, 4) AS INT) AS unit, "
                        f"CAST(substr(k, 10, 4) AS INT) AS yr, CAST(substr(k, 14, 5) AS INT) AS serial, regexp_full_match(k, '[1348][0-9]{{17}}') AS valid FROM "
                        f"(SELECT o_orderkey, {KEY_SQL} AS k FROM orders JOIN customer ON c_custkey = o_custkey)")(
    lambda s, d: keyed(s, d).select("o_orderkey", K.parse_case_key("case_key").alias("p"), K.valid_case_key("case_key").alias("valid"))
    .select("o_orderkey", "p.category", "p.district", "p.unit", F.col("p.year").alias("yr"), "p.serial", "valid"))

q("x14_clip", "SELECT doc_id, substr(coalesce(text, ''), 1, 160) AS summary FROM documents")(
    lambda s, d: m.table(s, d, "documents").select("doc_id", tx.clip("text").alias("summary")))

q("x15_json_round_trip", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events")(
    lambda s, d: m.table(s, d, "events").withColumn("p", F.from_json("props", "struct<k:int>"))
    .select("event_id", "p.k", F.to_json("p").alias("again")))

HAVERSINE_SQL = ("(2::DOUBLE * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow(sin(radians({2} - {0}) / 2), 2) + "
                 "cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))))")
q("x16_haversine", m.sql("SELECT c.case_id, round(" + HAVERSINE_SQL.format("c.latitude", "c.longitude", "13.0", "77.5") + ", 6) AS km FROM case_360 c"))(
    lambda s, d: m.case_master(s, d).select("case_id", F.round(geo.haversine_km("latitude", "longitude", F.lit(13.0), F.lit(77.5)), 6).alias("km")))

E64 = "CAST(embedding AS DOUBLE[])"
q("x17_vectors", f"SELECT vec_id, round(sqrt(list_dot_product({E64}, {E64})), 6) AS norm, round(list_dot_product({E64}, {E64}) / "
                 f"((sqrt(list_dot_product({E64}, {E64})) + 1e-9) * (sqrt(list_dot_product({E64}, {E64})) + 1e-9)), 6) AS self_cosine, "
                 f"round({E64}[1] / (sqrt(list_dot_product({E64}, {E64})) + 1e-9), 6) AS first_unit FROM embeddings")(
    lambda s, d: m.table(s, d, "embeddings").select(
        "vec_id", F.round(vec.norm("embedding"), 6).alias("norm"), F.round(vec.cosine("embedding", "embedding"), 6).alias("self_cosine"),
        F.round(vec.unit("embedding")[0], 6).alias("first_unit")))

q("x18_array_length", "SELECT vec_id, CAST(len(embedding) AS INT) AS n FROM embeddings")(
    lambda s, d: m.table(s, d, "embeddings").select("vec_id", F.size("embedding").alias("n")))

q("x19_decay_and_clip", "SELECT l_orderkey, l_linenumber, l_partkey, round(exp(-l_quantity / 912.0), 9) AS decay, round(sqrt(greatest(l_quantity - 10, 0.25)), 9) AS root, "
                        "least(0.95, 0.6 + l_discount) AS capped FROM lineitem")(
    lambda s, d: m.table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(F.exp(-F.col("l_quantity") / 912.0), 9).alias("decay"),
        F.round(F.sqrt(F.greatest(F.col("l_quantity") - 10, F.lit(0.25))), 9).alias("root"),
        F.least(F.lit(0.95), 0.6 + F.col("l_discount")).alias("capped")))

q("x20_python_round", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(format('{:.2f}', l_extendedprice * (1 - l_discount)) AS DOUBLE) AS net, "
                      "CAST(format('{:.1f}', l_extendedprice / 4) AS DOUBLE) AS quarter FROM lineitem")(
    lambda s, d: m.table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", rounding.python_round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).alias("net"),
        rounding.python_round(F.col("l_extendedprice") / 4, 1).alias("quarter")))

feature_match = lambda a, b: F.coalesce((F.nullif(a, F.lit("")) == F.nullif(b, F.lit(""))).cast("double"), F.lit(0.0))
q("x21_nullable_match", f"SELECT a.doc_id, coalesce(CAST(a.v = b.v AS DOUBLE), 0.0::DOUBLE) AS same FROM (SELECT doc_id, {cue_sql('text', fx.TARGET_CUES)} AS v FROM documents) a "
                        f"JOIN (SELECT doc_id - 1 AS doc_id, {cue_sql('text', fx.TARGET_CUES)} AS v FROM documents) b USING (doc_id)")(
    lambda s, d: m.table(s, d, "documents").select("doc_id", tx.cue_label("text", fx.TARGET_CUES).alias("v")).join(
        m.table(s, d, "documents").select((F.col("doc_id") - 1).alias("doc_id"), tx.cue_label("text", fx.TARGET_CUES).alias("w")), "doc_id")
    .select("doc_id", feature_match(F.col("v"), F.col("w")).alias("same")))

q("x22_numbers_grounded", r"""
WITH n AS (SELECT doc_id, n_chars, list_transform(regexp_extract_all(text, '\d[\d,]*'), lambda t: replace(t, ',', '')) AS found FROM documents)
SELECT doc_id, CAST(len(found) AS INT) AS n_numbers,
       len(list_filter(found, lambda x: x != CAST(n_chars AS VARCHAR))) = 0 AS grounded FROM n""")(
    lambda s, d: m.table(s, d, "documents").select(
        "doc_id", F.size(tx.numbers("text")).alias("n_numbers"), tx.grounded("text", F.col("n_chars"), F.lit("")).alias("grounded")))

OPTIONS = ["the", "there", "then", "thing", "tion", "tionhe", "ea"]
q("x23_longest_option", "SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{o}') THEN '{o}'" for o in sorted(OPTIONS, key=len, reverse=True))
  + " END AS found FROM documents")(
    lambda s, d: m.table(s, d, "documents").select("doc_id", tx.longest_contained("text", OPTIONS).alias("found")))

q("x24_format", "SELECT s_suppkey, format('{} {:.1f}x baseline', s_name, s_acctbal / 64) AS title FROM supplier")(
    lambda s, d: m.table(s, d, "supplier").select(
        "s_suppkey", F.format_string("%s %.1fx baseline", F.col("s_name"), rounding.python_round(F.col("s_acctbal") / 64, 1)).alias("title")))

ACT_OF = {"A": "BNS 305", "N": "BNS 309", "R": "BNS 304(2)"}


def sections(spark):
    """The fixed section dictionary as a small table (one row per element)."""
    rows = [(k, desc, i, e, len(els)) for k, (desc, els) in fx.SECTION_ELEMENTS.items() for i, e in enumerate(els)]
    return spark.createDataFrame(rows, "section string, description string, pos int, element string, n_elements int")


SECTIONS_SQL = "(VALUES " + ", ".join(
    "('{}', '{}', {}, '{}', {})".format(k, desc.replace("'", "''"), i, e.replace("'", "''"), len(els))
    for k, (desc, els) in fx.SECTION_ELEMENTS.items() for i, e in enumerate(els)) + ") AS sec(section, description, pos, element, n_elements)"
SECTION_OF_SQL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACT_OF.items()) + " END"
section_of = lambda c: F.coalesce(*[F.when(F.col(c) == k, F.lit(v)) for k, v in ACT_OF.items()])

q("x25_dictionary_lookup", f"SELECT l_orderkey, element FROM (SELECT DISTINCT l_orderkey, {SECTION_OF_SQL.format('l_returnflag')} AS section FROM lineitem) "
                           f"JOIN {SECTIONS_SQL} USING (section)")(
    lambda s, d: m.table(s, d, "lineitem").select("l_orderkey", section_of("l_returnflag").alias("section")).distinct()
    .join(F.broadcast(sections(s)), "section").select("l_orderkey", "element"))
