"""Views, filters, joins, aggregations, windows, ordering and set operations."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Window, functions as F

from caseweave.operators import evaluate as ev, ranking as rk
from caseweave.plans import views as v

from . import model as m
from .registry import Registry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
q = R.add

N = lambda name="n": F.count(F.lit(1)).alias(name)

# ---- views ------------------------------------------------------------------------

q("v1_case_360", m.sql("SELECT case_id, registered, case_status, crime_head, gravity, registering_officer, "
                       "crime_sub_head, police_station, district, accused_count, victim_count, chargesheet_date, "
                       "final_report_type FROM case_360"))(
    lambda s, d: m.cases(s, d, [c for c in m.CASE_COLUMNS if c not in ("latitude", "longitude", "amount")]))

q("v2_entity_history", m.sql("SELECT * FROM entity_history"))(lambda s, d: m.history(s, d))

q("v3_station_monthly", m.sql(
    "SELECT district, police_station, crime_head, crime_sub_head, CAST(date_trunc('month', registered) AS DATE) AS month, "
    "count(*) AS case_count FROM case_360 GROUP BY ALL"))(
    lambda s, d: v.monthly_counts(
        m.cases(s, d, ["district", "police_station", "crime_head", "crime_sub_head", "registered"]),
        ["district", "police_station", "crime_head", "crime_sub_head"], "registered"))

q("v4_co_occurrence", m.sql(
    "SELECT DISTINCT a1.person_key AS person_a, a2.person_key AS person_b, a1.case_id FROM accused a1 "
    "JOIN accused a2 ON a1.case_id = a2.case_id AND a1.accused_id < a2.accused_id"))(
    lambda s, d: v.co_occurrence(m.accused(s, d), "case_id", "person_key", "accused_id"))

# ---- filters ----------------------------------------------------------------------

case_cols = ["case_id", "registered", "crime_sub_head", "district", "police_station", "case_status"]

q("f1_equality", m.sql("SELECT case_id, registered FROM case_360 WHERE crime_sub_head = 'BUILDING' AND district = 'ASIA' "
                       "AND case_status = 'F'"))(
    lambda s, d: m.cases(s, d, case_cols).where(
        (F.col("crime_sub_head") == "BUILDING") & (F.col("district") == "ASIA") & (F.col("case_status") == "F"))
    .select("case_id", "registered"))

q("f2_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')")(
    lambda s, d: m.table(s, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM"))
    .select("o_orderkey", "o_orderpriority"))

q("f3_between", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")(
    lambda s, d: m.table(s, d, "lineitem").where(F.col("l_quantity").between(10, 12))
    .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))

q("f4_date_range", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders "
                   "WHERE o_orderdate >= DATE '1997-03-01' AND o_orderdate < DATE '1997-06-01'")(
    lambda s, d: m.table(s, d, "orders")
    .where((F.col("o_orderdate") >= F.lit("1997-03-01").cast("timestamp_ntz"))
           & (F.col("o_orderdate") < F.lit("1997-06-01").cast("timestamp_ntz")))
    .select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")))

q("f5_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%bolt' OR lower(p_brand) LIKE 'brand#1%'")(
    lambda s, d: m.table(s, d, "part").where(F.col("p_name").like("%bolt") | F.lower("p_brand").like("brand#1%"))
    .select("p_partkey", "p_name"))

q("f6_is_not_null", m.sql("SELECT case_id, chargesheet_date FROM case_360 WHERE chargesheet_date IS NOT NULL"))(
    lambda s, d: m.cases(s, d, ["case_id", "chargesheet_date"]).where(F.col("chargesheet_date").isNotNull()))


def optional_filters(df, sub_head=None, district=None, date_from=None, date_to=None):
    given = [c for value, c in (
        (sub_head, F.col("crime_sub_head") == sub_head), (district, F.col("district") == district),
        (date_from, F.col("registered") >= F.lit(date_from).cast("date")),
        (date_to, F.col("registered") <= F.lit(date_to).cast("date"))) if value is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


q("f7_optional_filters", m.sql("SELECT case_id FROM case_360 WHERE crime_sub_head = 'MACHINERY' AND registered >= "
                               "DATE '1999-01-01'"))(
    lambda s, d: optional_filters(m.cases(s, d, case_cols), sub_head="MACHINERY", date_from="1999-01-01").select("case_id"))

q("f8_derived_count", m.sql("SELECT case_id, accused_count FROM case_360 WHERE accused_count >= 2 OR accused_count = 0"))(
    lambda s, d: m.cases(s, d, ["case_id", "accused_count"]).where(
        (F.col("accused_count") >= 2) | (F.col("accused_count") == 0)))

q("f9_distinct_sorted", m.sql("SELECT DISTINCT district, crime_sub_head FROM case_360 WHERE year(registered) = 1998 "
                              "ORDER BY district, crime_sub_head"))(
    lambda s, d: m.cases(s, d, case_cols).where(F.year("registered") == 1998).select("district", "crime_sub_head")
    .distinct().orderBy("district", "crime_sub_head"))

q("f10_projection_alias", "SELECT c_custkey AS customer_id, c_mktsegment AS segment, c_acctbal * 2 AS doubled FROM customer")(
    lambda s, d: m.table(s, d, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"),
        (F.col("c_acctbal") * 2).alias("doubled")))


@q("f11_parameters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 150000")
def _f11(s, d):
    return s.sql("SELECT o_orderkey FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :floor",
                 args={"status": "O", "floor": 150000}, orders=m.table(s, d, "orders"))


# ---- joins ------------------------------------------------------------------------

q("j1_left_lookup_chain", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey "
                          "LEFT JOIN region ON r_regionkey = n_regionkey")(
    lambda s, d: m.table(s, d, "customer").join(m.table(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    .join(m.table(s, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    .select("c_custkey", "n_name", "r_name"))

q("j2_inner_bridge", "SELECT o_custkey, l_suppkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey "
                     "JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")(
    lambda s, d: m.table(s, d, "lineitem").join(m.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    .join(m.table(s, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    .groupBy("o_custkey", "l_suppkey").agg(N()))

q("j3_self_join_theta", "SELECT least(a.p, b.p) AS part_a, greatest(a.p, b.p) AS part_b, count(*) AS together FROM "
                        "(SELECT DISTINCT l_orderkey o, l_partkey p FROM lineitem) a JOIN "
                        "(SELECT DISTINCT l_orderkey o, l_partkey p FROM lineitem) b ON a.o = b.o AND a.p < b.p "
                        "GROUP BY ALL HAVING count(*) >= 2")(
    lambda s, d: v.co_occurrence(m.table(s, d, "lineitem").withColumn("ord", F.col("l_partkey")),
                                 "l_orderkey", "l_partkey", "ord", "part_a", "part_b")
    .groupBy("part_a", "part_b").agg(N("together")).where("together >= 2"))

q("j4_join_using", "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")(
    lambda s, d: m.table(s, d, "documents").select("doc_id", "lang").join(m.table(s, d, "labels"), "doc_id"))

q("j5_semi_join", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem "
                  "WHERE l_returnflag = 'R')")(
    lambda s, d: m.table(s, d, "supplier").join(
        m.table(s, d, "lineitem").where("l_returnflag = 'R'"),
        F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name"))

q("j6_semi_join_id_list", m.sql(
    "SELECT c.case_id, c.police_station FROM case_360 c WHERE c.case_id IN (SELECT unnest(ids) FROM (SELECT list(l_orderkey) "
    "AS ids FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey))"))(
    lambda s, d: m.cases(s, d, ["case_id", "police_station"]).join(
        m.table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("case_id")),
        "case_id", "left_semi"))

q("j11_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")(
    lambda s, d: ev.orphans(m.table(s, d, "customer"), m.table(s, d, "orders"), "c_custkey", "o_custkey").select("c_custkey"))

q("j12_case_entities", m.sql("SELECT c.case_id, a.person_key FROM (SELECT case_id FROM case_360) c "
                             "JOIN (SELECT DISTINCT case_id, person_key FROM accused) a ON a.case_id = c.case_id"))(
    lambda s, d: m.accused(s, d).select("case_id", "person_key").distinct().join(
        m.case_master(s, d).select("case_id"), "case_id"))

# ---- aggregations -----------------------------------------------------------------

q("a1_count", "SELECT count(*) AS n FROM lineitem")(lambda s, d: m.table(s, d, "lineitem").agg(N()))

q("a2_group_count", m.sql("SELECT district, police_station, crime_head, crime_sub_head, count(*) AS n FROM case_360 GROUP BY ALL"))(
    lambda s, d: m.cases(s, d, ["district", "police_station", "crime_head", "crime_sub_head"])
    .groupBy("district", "police_station", "crime_head", "crime_sub_head").agg(N()))

q("a3_count_distinct", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS cases, count(DISTINCT l_suppkey) AS persons "
                       "FROM lineitem GROUP BY l_returnflag")(
    lambda s, d: m.table(s, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_orderkey").alias("cases"), F.count_distinct("l_suppkey").alias("persons")))

q("a4_having", "SELECT o_custkey, count(*) AS n, CAST(max(o_orderdate) AS DATE) AS last_seen FROM orders GROUP BY o_custkey "
               "HAVING count(*) >= 12 AND max(o_orderdate) <= DATE '2001-06-01'")(
    lambda s, d: m.table(s, d, "orders").groupBy("o_custkey").agg(N(), F.max("o_orderdate").cast("date").alias("last_seen"))
    .where("n >= 12 AND last_seen <= DATE '2001-06-01'"))

q("a5_min_max", "SELECT l_suppkey, CAST(min(l_shipdate) AS DATE) AS first_ship, CAST(max(l_shipdate) AS DATE) AS last_ship, "
                "max(l_extendedprice) AS top_price FROM lineitem GROUP BY l_suppkey")(
    lambda s, d: m.table(s, d, "lineitem").groupBy("l_suppkey").agg(
        F.min("l_shipdate").cast("date").alias("first_ship"), F.max("l_shipdate").cast("date").alias("last_ship"),
        F.max("l_extendedprice").alias("top_price")))

q("a6_any_value", "SELECT l_orderkey, first(l_returnflag ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_returnflag) "
                  "AS flag FROM lineitem GROUP BY l_orderkey")(
    lambda s, d: m.table(s, d, "lineitem").groupBy("l_orderkey").agg(
        F.min_by("l_returnflag", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")).alias("flag")))

q("a7_conditional_count", m.sql("SELECT police_station, count(*) FILTER (WHERE gravity = 'Heinous') AS heinous, count(*) AS total "
                                "FROM case_360 GROUP BY police_station"))(
    lambda s, d: m.cases(s, d, ["police_station", "gravity"]).groupBy("police_station").agg(
        F.count_if(F.col("gravity") == "Heinous").alias("heinous"), N("total")))

q("a8_mean_of_max", "SELECT o_custkey, round(avg(top), 8) AS mean_top FROM (SELECT o_custkey, o_orderkey, max(l_extendedprice) AS top "
                    "FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY o_custkey")(
    lambda s, d: m.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("top"))
    .join(m.table(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    .groupBy("o_custkey").agg(F.round(F.avg("top"), 8).alias("mean_top")))

q("a9_mode", "SELECT l_suppkey, l_returnflag AS flag FROM (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY "
             "l_suppkey ORDER BY count(*) DESC, l_returnflag) AS r FROM lineitem GROUP BY l_suppkey, l_returnflag) WHERE r = 1")(
    lambda s, d: m.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.mode("l_returnflag", True).alias("flag")))

q("a10_sorted_set", m.sql("SELECT crime_sub_head, list_aggregate(list_sort(list(DISTINCT district)), 'string_agg', ',') AS districts "
                          "FROM case_360 GROUP BY crime_sub_head"))(
    lambda s, d: m.cases(s, d, ["crime_sub_head", "district"]).groupBy("crime_sub_head").agg(
        F.concat_ws(",", F.sort_array(F.collect_set("district"))).alias("districts")))

q("a11_centroid", m.sql("SELECT district, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon FROM case_360 GROUP BY district"))(
    lambda s, d: m.cases(s, d, ["district", "latitude", "longitude"]).groupBy("district").agg(
        F.round(F.avg("latitude"), 6).alias("lat"), F.round(F.avg("longitude"), 6).alias("lon")))


@q("a12_peak_normalised", m.sql("SELECT police_station, n, round(n / max(n) OVER (), 3) AS intensity FROM (SELECT police_station, "
                                "count(*) AS n FROM case_360 GROUP BY 1)"))
def _a12(s, d):
    per = m.cases(s, d, ["police_station"]).groupBy("police_station").agg(N())
    return per.select("police_station", "n", F.round(F.col("n") / per.agg(F.max("n")).scalar(), 3).alias("intensity"))


q("a13_weighted_sum", "SELECT l_suppkey, round(sum(l_quantity * (1 - l_discount)), 2) AS support FROM lineitem GROUP BY l_suppkey")(
    lambda s, d: m.table(s, d, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))), 2).alias("support")))

q("a14_mean_absolute_error", "SELECT l_returnflag, round(avg(abs(l_extendedprice - l_quantity * 1000)), 4) AS mae FROM lineitem GROUP BY 1")(
    lambda s, d: m.table(s, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.avg(F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1000)), 4).alias("mae")))

q("a15_accuracy_rollup", "SELECT lang, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS passed, count(*) AS total, "
                         "round(avg(CAST(quality = 1 AS INT)), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")(
    lambda s, d: ev.accuracy(m.table(s, d, "documents").select("doc_id", "lang").join(m.table(s, d, "labels"), "doc_id")
                             .withColumn("ok", F.col("quality") == 1), "lang")
    .withColumn("accuracy", F.round("accuracy", 6)))

q("a16_distinct_pairs", "SELECT DISTINCT p_brand, p_type FROM part")(
    lambda s, d: m.table(s, d, "part").select("p_brand", "p_type").distinct())

# ---- windows ----------------------------------------------------------------------

q("w1_gapless_serial", m.sql("SELECT case_id, row_number() OVER (PARTITION BY police_station, crime_head, year(registered) ORDER BY case_id) "
                             "AS serial FROM case_360"))(
    lambda s, d: rk.serial_within(
        m.cases(s, d, ["case_id", "police_station", "crime_head", "registered"]).withColumn("yr", F.year("registered")),
        ["police_station", "crime_head", "yr"], ["case_id"], bucket=F.floor(F.col("case_id") / 1_000_000))
    .select("case_id", "serial"))

q("w2_lag", "SELECT c_custkey, month, n, lag(n, 12) OVER (PARTITION BY c_custkey ORDER BY month) AS before FROM (SELECT o_custkey AS "
            "c_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY ALL)")(
    lambda s, d: v.monthly_counts(m.table(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "o_orderdate", "n")
    .withColumn("before", F.lag("n", 12).over(Window.partitionBy("c_custkey").orderBy("month"))))

q("w3_last_n", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, "
               "o_orderkey DESC) r FROM orders) WHERE r <= 8")(
    lambda s, d: rk.top_k_per_group(m.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"],
                                    [F.desc("o_orderdate"), F.desc("o_orderkey")], 8).select("o_custkey", "o_orderkey"))

q("w4_top_k_per_group", "SELECT l_suppkey, l_orderkey, l_extendedprice, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey "
                        "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) r FROM lineitem) WHERE r <= 12")(
    lambda s, d: rk.top_k_per_group(
        m.table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_extendedprice", "l_linenumber"), ["l_suppkey"],
        [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 12, "rank")
    .select("l_suppkey", "l_orderkey", "l_extendedprice", F.col("rank").cast("long").alias("rank")))

q("w5_numbered_ids", "SELECT 'SH-' || lpad(CAST(r AS VARCHAR), 2, '0') AS id, n_name, bal FROM (SELECT n_name, round(sum(c_acctbal), 2) AS bal, "
                     "row_number() OVER (ORDER BY round(sum(c_acctbal), 2) DESC, n_name) AS r FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name)")(
    lambda s, d: rk.numbered(
        m.table(s, d, "customer").join(m.table(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .groupBy("n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("bal")), [F.desc("bal"), "n_name"], "SH-%02d")
    .select("id", "n_name", "bal"))

def _w6(s, d):
    per = m.table(s, d, "events").groupBy("event_type").agg(N())
    return per.withColumn("total", per.agg(F.sum("n")).scalar())


q("w6_global_total", "SELECT event_type, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM events GROUP BY event_type")(
    _w6)

q("w7_best_per_partition", "SELECT c_mktsegment, c_custkey, n FROM (SELECT c_mktsegment, c_custkey, count(*) AS n, row_number() OVER "
                           "(PARTITION BY c_mktsegment ORDER BY count(*) DESC, c_custkey) r FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment, c_custkey) WHERE r = 1")(
    lambda s, d: rk.top_k_per_group(
        m.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(N())
        .join(m.table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey"),
        ["c_mktsegment"], [F.desc("n"), "c_custkey"], 1).select("c_mktsegment", "c_custkey", "n"))

# ---- ordering, limits, caps -------------------------------------------------------

q("o1_multi_key_order", "SELECT p_brand, count(*) AS c FROM part GROUP BY p_brand ORDER BY c DESC, p_brand")(
    lambda s, d: m.table(s, d, "part").groupBy("p_brand").agg(N("c")).orderBy(F.desc("c"), "p_brand"))

q("o2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")(
    lambda s, d: m.table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20))

q("o3_row_cap", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500")(
    lambda s, d: rk.capped(m.table(s, d, "orders").select("o_orderkey").orderBy("o_orderkey"), 500)[0])


q("o4_truncated_flag", "SELECT o_orderkey, (SELECT count(*) FROM orders) > 500 AS truncated FROM orders ORDER BY o_orderkey LIMIT 500")(
    lambda s, d: rk.with_truncated(m.table(s, d, "orders").select("o_orderkey").orderBy("o_orderkey"), 500))
q("o4_whole_result", "SELECT n_nationkey, (SELECT count(*) FROM nation) > 500 AS truncated FROM nation ORDER BY n_nationkey LIMIT 500")(
    lambda s, d: rk.with_truncated(m.table(s, d, "nation").select("n_nationkey").orderBy("n_nationkey"), 500))


q("o5_two_phase_top", "SELECT o_custkey, n, round(0.7 * least(1.0, n / 20.0) + 0.3 * least(1.0, spend / 5000000.0), 6) AS score FROM "
                      "(SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spend FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 40) "
                      "ORDER BY score DESC, o_custkey LIMIT 10")(
    lambda s, d: rk.two_phase_top(
        m.table(s, d, "orders").groupBy("o_custkey").agg(N(), F.sum("o_totalprice").alias("spend")), [F.desc("n"), "o_custkey"], 40,
        F.round(0.7 * F.least(F.lit(1.0), F.col("n") / 20.0) + 0.3 * F.least(F.lit(1.0), F.col("spend") / 5000000.0), 6), 10, ["o_custkey"])
    .select("o_custkey", "n", "score"))

# ---- set operations ---------------------------------------------------------------

_supp_flag = lambda s, d, f: m.table(s, d, "lineitem").where(F.col("l_returnflag") == f).select("l_orderkey")
_supp_sql = "SELECT l_orderkey FROM lineitem WHERE l_returnflag = '{}'"

q("u1_intersect", f"{_supp_sql.format('R')} INTERSECT {_supp_sql.format('A')}")(
    lambda s, d: _supp_flag(s, d, "R").intersect(_supp_flag(s, d, "A")))
q("u2_union", f"{_supp_sql.format('R')} UNION {_supp_sql.format('A')}")(
    lambda s, d: _supp_flag(s, d, "R").union(_supp_flag(s, d, "A")).distinct())
q("u2_except", f"{_supp_sql.format('R')} EXCEPT {_supp_sql.format('A')}")(
    lambda s, d: _supp_flag(s, d, "R").subtract(_supp_flag(s, d, "A")))
q("u3_union_by_name", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")(
    lambda s, d: m.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    .unionByName(m.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True))
q("u4_bag_difference", "SELECT coalesce(a.c0, b.c0) AS c0, coalesce(in_a, 0) AS in_a, coalesce(in_b, 0) AS in_b FROM "
                       "(SELECT l_suppkey AS c0, count(*) AS in_a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a FULL JOIN "
                       "(SELECT l_suppkey AS c0, count(*) AS in_b FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON a.c0 = b.c0 "
                       "WHERE coalesce(in_a, 0) != coalesce(in_b, 0)")(
    lambda s, d: ev.difference(*[m.table(s, d, "lineitem").where(F.col("l_returnflag") == f).select("l_suppkey") for f in "RA"]))
q("u5_set_overlap", "SELECT a.source AS group_a, b.lang AS group_b, count(*) AS shared FROM documents a JOIN documents b USING (doc_id) GROUP BY ALL")(
    lambda s, d: ev.overlapping_clusters(
        m.table(s, d, "documents").select("doc_id", F.col("source").alias("group_a")),
        m.table(s, d, "documents").select("doc_id", F.col("lang").alias("group_b")), "doc_id", "group_a", "group_b"))
