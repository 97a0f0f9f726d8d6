"""The driver's tables read as a case database.

case = order; station = nation and district = region of the customer; accused record =
line item; person = supplier; gravity, head and sub-head come from the order priority
and the customer's segment. Coordinates are derived from keys, because no table has any.
The same definitions exist once as DataFrames and once as SQL for the checks.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseweave.plans.views import Lookup, Rollup, case_360, entity_history
from caseweave.session import prepare

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _lat(key: str):
    return 12.0 + (F.col(key) * 7919 % 10007) / 10007.0 * 6.0


def _lon(key: str):
    return 74.0 + (F.col(key) * 104729 % 10007) / 10007.0 * 4.0


def lat_sql(key: str) -> str:
    return f"(12.0::DOUBLE + ({key} * 7919 % 10007)::DOUBLE / 10007.0::DOUBLE * 6.0::DOUBLE)"


def lon_sql(key: str) -> str:
    return f"(74.0::DOUBLE + ({key} * 104729 % 10007)::DOUBLE / 10007.0::DOUBLE * 4.0::DOUBLE)"


def case_master(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").cast("date").alias("registered"),
        F.col("o_orderstatus").alias("case_status"), F.col("o_orderpriority").alias("crime_head"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Heinous").otherwise("Non-Heinous").alias("gravity"),
        F.col("o_totalprice").alias("amount"), F.col("o_custkey").alias("officer_id"),
        _lat("o_custkey").alias("latitude"), _lon("o_custkey").alias("longitude"))


def accused(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        (F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey")).alias("accused_id"),
        F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("person_key"),
        F.col("l_quantity").cast("int").alias("age"))


def _chargesheets(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem")


def lookups(spark, folder) -> list[Lookup]:
    t = lambda n: table(spark, folder, n)
    return [
        Lookup(t("customer"), "officer_id", "c_custkey",
               {"registering_officer": "c_name", "crime_sub_head": "c_mktsegment", "_nation": "c_nationkey"}),
        Lookup(t("nation"), "_nation", "n_nationkey", {"police_station": "n_name", "_region": "n_regionkey"}),
        Lookup(t("region"), "_region", "r_regionkey", {"district": "r_name"}),
    ]


def rollups(spark, folder) -> list[Rollup]:
    """Accused, victims and charge sheets all come from line items here: one pass."""
    order = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return [Rollup(_chargesheets(spark, folder), "l_orderkey", {
        "accused_count": F.count(F.lit(1)),
        "victim_count": F.count_if(F.col("l_returnflag") == "R"),
        "chargesheet_date": F.min("l_shipdate").cast("date"),
        "final_report_type": F.min_by("l_returnflag", order),
    }, zero=("accused_count", "victim_count"))]


CASE_COLUMNS = ["case_id", "registered", "case_status", "crime_head", "gravity", "amount", "latitude", "longitude",
                "registering_officer", "crime_sub_head", "police_station", "district",
                "accused_count", "victim_count", "chargesheet_date", "final_report_type"]


def cases(spark, folder, columns: Sequence[str] | None = None) -> DataFrame:
    return case_360(case_master(spark, folder), "case_id", lookups(spark, folder), rollups(spark, folder),
                    columns or CASE_COLUMNS)


def registry(spark, folder) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("person_key"), F.col("s_name").alias("full_name"),
        _lat("s_suppkey").alias("home_lat"), _lon("s_suppkey").alias("home_lon"))


def history(spark, folder, columns: Sequence[str] = ("registered", "crime_sub_head", "district",
                                                       "police_station", "case_status", "gravity")) -> DataFrame:
    return entity_history(accused(spark, folder), registry(spark, folder).select("person_key", "full_name"),
                          cases(spark, folder, ["case_id", *columns]))


# --- the same relations in SQL, for the checks --------------------------------------

CASES_CTE = f"""
case_360 AS (
  SELECT o.o_orderkey AS case_id, CAST(o.o_orderdate AS DATE) AS registered, o.o_orderstatus AS case_status,
         o.o_orderpriority AS crime_head,
         CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'Heinous' ELSE 'Non-Heinous' END AS gravity,
         o.o_totalprice AS amount, {lat_sql('o.o_custkey')} AS latitude, {lon_sql('o.o_custkey')} AS longitude,
         c.c_name AS registering_officer, c.c_mktsegment AS crime_sub_head, n.n_name AS police_station,
         r.r_name AS district,
         CAST(coalesce(l.accused_count, 0) AS BIGINT) AS accused_count,
         CAST(coalesce(l.victim_count, 0) AS BIGINT) AS victim_count,
         l.chargesheet_date, l.final_report_type
  FROM orders o
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN (
    SELECT l_orderkey, count(*) AS accused_count, count(*) FILTER (WHERE l_returnflag = 'R') AS victim_count,
           CAST(min(l_shipdate) AS DATE) AS chargesheet_date,
           first(l_returnflag ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_returnflag)
             AS final_report_type
    FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
)"""

ACCUSED_CTE = """
accused AS (
  SELECT CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey AS accused_id, l_orderkey AS case_id,
         l_suppkey AS person_key, CAST(l_quantity AS INTEGER) AS age
  FROM lineitem
)"""

REGISTRY_CTE = f"""
registry AS (
  SELECT s_suppkey AS person_key, s_name AS full_name, {lat_sql('s_suppkey')} AS home_lat,
         {lon_sql('s_suppkey')} AS home_lon
  FROM supplier
)"""

HISTORY_CTE = """
entity_history AS (
  SELECT a.person_key, p.full_name, a.accused_id, a.case_id, a.age, c.registered, c.crime_sub_head, c.district,
         c.police_station, c.case_status, c.gravity
  FROM accused a JOIN registry p ON p.person_key = a.person_key JOIN case_360 c ON c.case_id = a.case_id
)"""


def sql(body: str, *ctes: str) -> str:
    """A check query over the case model; the views it names are put in front."""
    known = {"case_360": CASES_CTE, "accused": ACCUSED_CTE, "registry": REGISTRY_CTE, "entity_history": HISTORY_CTE}
    parts = []
    if "entity_history" in body or any("entity_history" in c for c in ctes):
        parts = [known[k] for k in ("case_360", "accused", "registry", "entity_history")]
    else:
        text = body + " ".join(ctes)
        parts = [v for k, v in known.items() if k in text and k != "entity_history"]
    parts += list(ctes)
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n" + body if parts else body
