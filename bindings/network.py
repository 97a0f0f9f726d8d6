"""The graph of suppliers and orders, and of parts sold together."""
from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.functions import text as tx
from caseweave.operators import communities as cm, graph as gr, spatial
from caseweave.plans import views as v
from caseweave.plans.lineage import cut

from . import model as m
from .analytics import hex_sql, scores
from .registry import Registry
from .scalars import IDENT

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
q = R.add

HOME_RES = 4


def persons(s, d):
    return spatial.with_cell(m.registry(s, d), "home_lat", "home_lon", HOME_RES, "home_cell")


def mentions(s, d):
    """Identifiers in the text that belongs to a case (document id = case id)."""
    return m.table(s, d, "documents").select(F.col("doc_id").alias("case_id"), F.explode(tx.identifiers("text", IDENT)).alias("ident"))


def graph(s, d, **more):
    return gr.build(persons(s, d), m.accused(s, d), v.co_occurrence(m.accused(s, d), "case_id", "person_key", "accused_id", directed=False),
                    mentions(s, d), min_cases=2, **more)


ACC = "accused_edges AS (SELECT DISTINCT 'C-' || case_id AS a, 'P-' || person_key AS b, 'accused_in' AS kind FROM accused)"
CO = """co_edges AS (SELECT DISTINCT least('P-' || x.person_key, 'P-' || y.person_key) AS a, greatest('P-' || x.person_key, 'P-' || y.person_key) AS b, 'co_accused' AS kind
  FROM accused x JOIN accused y ON x.case_id = y.case_id AND x.person_key < y.person_key AND (x.accused_id <> y.accused_id))"""
HOME = f"""homes AS (SELECT person_key, {hex_sql('home_lat', 'home_lon', HOME_RES)} AS cell FROM registry),
small AS (SELECT cell FROM homes GROUP BY cell HAVING count(*) BETWEEN 2 AND 4),
home_edges AS (SELECT least('P-' || x.person_key, 'P-' || y.person_key) AS a, greatest('P-' || x.person_key, 'P-' || y.person_key) AS b, 'same_address' AS kind
  FROM homes x JOIN homes y ON x.cell = y.cell AND x.person_key < y.person_key WHERE x.cell IN (SELECT cell FROM small))"""
HUB = f"""seen AS (SELECT DISTINCT doc_id AS case_id, unnest(regexp_extract_all(text, '{IDENT}')) AS ident FROM documents),
many AS (SELECT * FROM seen WHERE ident IN (SELECT ident FROM seen GROUP BY ident HAVING count(*) >= 2)),
hub AS (SELECT ident, person_key FROM (SELECT ident, person_key, row_number() OVER (PARTITION BY ident ORDER BY count(*) DESC, person_key) AS r
  FROM many JOIN (SELECT DISTINCT case_id, person_key FROM accused) USING (case_id) GROUP BY ident, person_key) WHERE r = 1),
hub_edges AS (SELECT DISTINCT 'C-' || case_id AS a, 'P-' || person_key AS b, 'mule_account' AS kind FROM hub JOIN many USING (ident)
  WHERE NOT EXISTS (SELECT 1 FROM accused x WHERE x.case_id = many.case_id AND x.person_key = hub.person_key))"""
EDGES = f"""{ACC},
{CO},
{HOME},
{HUB},
edges AS (SELECT * FROM accused_edges UNION ALL SELECT * FROM co_edges UNION ALL SELECT * FROM home_edges UNION ALL SELECT * FROM hub_edges),
both_ways AS (SELECT a AS src, b AS dst FROM edges UNION SELECT b, a FROM edges)"""
TAG = " -- accused registry"

q("g1_nodes", m.sql("SELECT 'P-' || person_key AS id, 'person' AS kind, full_name AS label FROM registry UNION ALL SELECT DISTINCT a, 'case', a FROM edges WHERE a LIKE 'C-%'" + TAG, EDGES))(
    lambda s, d: graph(s, d).nodes)
q("g1_nodes_with_meta", m.sql("SELECT 'P-' || person_key AS id, 'person' AS kind, full_name AS label, NULL::VARCHAR AS crime_sub_head, NULL::VARCHAR AS district FROM registry UNION ALL "
                               "SELECT n.id, 'case', n.id, crime_sub_head, district FROM (SELECT DISTINCT a AS id FROM edges WHERE a LIKE 'C-%') n LEFT JOIN case_360 c ON 'C-' || c.case_id = n.id" + TAG, EDGES))(
    lambda s, d: graph(s, d, case_meta=m.cases(s, d, ["case_id", "crime_sub_head", "district"])).nodes)
q("g2_accused_in", m.sql("SELECT * FROM accused_edges" + TAG, ACC))(lambda s, d: gr.accused_edges(m.accused(s, d)))
q("g3_co_accused", m.sql("SELECT * FROM co_edges" + TAG, CO))(
    lambda s, d: gr.co_accused_edges(v.co_occurrence(m.accused(s, d), "case_id", "person_key", "accused_id", directed=False)))
q("g4_same_address", m.sql("SELECT * FROM home_edges" + TAG, HOME))(lambda s, d: gr.same_address_edges(persons(s, d)))
q("g5_hub", m.sql("SELECT * FROM hub_edges" + TAG, HUB))(lambda s, d: gr.hub_edges(mentions(s, d), m.accused(s, d), min_cases=2))
q("g6_simple_edges", m.sql("SELECT a, b, array_to_string(list_sort(list(DISTINCT kind)), '+') AS kinds FROM edges GROUP BY a, b" + TAG, EDGES))(
    lambda s, d: gr.kinds_text(graph(s, d).edges))
q("g7_person_projection", m.sql("SELECT DISTINCT least(x.b, y.b) AS a, greatest(x.b, y.b) AS b FROM edges x JOIN edges y ON x.a = y.a AND x.b < y.b "
                                "WHERE x.kind IN ('accused_in', 'mule_account') AND y.kind IN ('accused_in', 'mule_account') UNION SELECT a, b FROM home_edges" + TAG, EDGES))(
    lambda s, d: gr.project(graph(s, d).edges))


def part_graph(s, d):
    """Parts that were sold in one order."""
    rows = m.table(s, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_partkey").alias("ord"))
    edges = cut(gr.co_accused_edges(v.co_occurrence(rows, "l_orderkey", "l_partkey", "ord", directed=False)), "part-edges")
    nodes = m.table(s, d, "part").select(gr.person_id("p_partkey").alias("id"), F.lit("person").alias("kind"), F.col("p_name").alias("label"))
    return gr.Graph(nodes, edges)


def part_pairs(s, d):
    """The same graph with plain part numbers, which join faster than text ids."""
    rows = m.table(s, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_partkey").alias("ord"))
    return v.co_occurrence(rows, "l_orderkey", "l_partkey", "ord", "a", "b").select("a", "b").distinct()


NUM_EDGES = """part_edges AS (SELECT DISTINCT x.l_partkey AS src, y.l_partkey AS dst FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey <> y.l_partkey)"""
PART_EDGES = """part_edges AS (SELECT DISTINCT 'P-' || x.l_partkey AS src, 'P-' || y.l_partkey AS dst FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey <> y.l_partkey)"""


@q("g8_louvain")
def _louvain(s, d):
    return cm.louvain(part_graph(s, d).edges)


@q("g8_louvain_persons")
def _louvain_persons(s, d):
    g = graph(s, d)
    return cm.louvain(g.edges.where("kind = 'same_address'"), nodes=g.nodes.where("kind = 'person'"))


def _levels(n):
    """Level-by-level shortest path counts and dependencies, written out for n levels."""
    parts = [NUM_EDGES, "src0 AS (SELECT src AS s FROM (SELECT DISTINCT src FROM part_edges) ORDER BY md5(src || '|42'), src LIMIT 16)",
             "l0 AS (SELECT s, s AS v, 1.0::DOUBLE AS paths FROM src0)"]
    for i in range(1, n + 1):
        seen = " UNION ALL ".join(f"SELECT s, v FROM l{j}" for j in range(max(0, i - 2), i))
        parts.append(f"l{i} AS MATERIALIZED (SELECT l.s, e.dst AS v, sum(l.paths) AS paths FROM l{i - 1} l JOIN part_edges e ON e.src = l.v WHERE (l.s, e.dst) NOT IN ({seen}) GROUP BY l.s, e.dst)")
    parts.append(f"d{n} AS (SELECT s, v, paths, 0.0::DOUBLE AS delta FROM l{n})")
    for i in range(n - 1, 0, -1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT lo.s, lo.v, lo.paths, coalesce(lo.paths * sum((1 + up.delta) / up.paths), 0.0) AS delta FROM l{i} lo LEFT JOIN "
                     f"(SELECT u.s, e.dst AS v, u.delta, u.paths FROM d{i + 1} u JOIN part_edges e ON e.src = u.v) up ON up.s = lo.s AND up.v = lo.v GROUP BY lo.s, lo.v, lo.paths)")
    parts.append("raw AS (SELECT v, sum(delta) AS delta FROM (" + " UNION ALL ".join(f"SELECT v, delta FROM d{i}" for i in range(1, n + 1)) + ") GROUP BY v)")
    return parts


q("g9_betweenness", m.sql("SELECT n.src AS id, round(coalesce(r.delta, 0.0) / (SELECT max(delta) FROM raw), 6) AS centrality FROM (SELECT DISTINCT src FROM part_edges) n LEFT JOIN raw r ON r.v = n.src", *_levels(5)))(
    lambda s, d: gr.betweenness(part_pairs(s, d), k=16).withColumn("centrality", F.round("centrality", 6)))

q("g10_ego_nodes", m.sql("SELECT 'P-7' AS id, 0 AS hops UNION ALL SELECT dst, 1 FROM both_ways WHERE src = 'P-7'" + TAG, EDGES))(
    lambda s, d: _ego_hops(s, d))


def _ego_hops(s, d):
    g = graph(s, d)
    return gr.reach(gr.both_ways(g.edges), g.nodes.where("id = 'P-7'"), 1)


q("g10_ego_edges", m.sql("SELECT a, b, kind FROM edges WHERE a IN (SELECT dst FROM both_ways WHERE src = 'P-7' UNION SELECT 'P-7') AND b IN (SELECT dst FROM both_ways WHERE src = 'P-7' UNION SELECT 'P-7')" + TAG, EDGES))(
    lambda s, d: gr.ego(graph(s, d), "P-7", 1).edges)

_dist = f"""{PART_EDGES},
k0 AS (SELECT 'P-1' AS id), k1 AS (SELECT DISTINCT dst AS id FROM part_edges WHERE src = 'P-1'),
k2 AS (SELECT DISTINCT dst AS id FROM part_edges JOIN k1 ON src = id WHERE dst <> 'P-1' AND dst NOT IN (SELECT id FROM k1)),
k3 AS (SELECT DISTINCT dst AS id FROM part_edges JOIN k2 ON src = id WHERE dst NOT IN (SELECT id FROM k1) AND dst NOT IN (SELECT id FROM k2)),
p2 AS (SELECT min(dst) AS id FROM part_edges WHERE src = 'P-0' AND dst IN (SELECT id FROM k2)),
p1 AS (SELECT min(dst) AS id FROM part_edges WHERE src = (SELECT CASE WHEN 'P-0' IN (SELECT id FROM k3) THEN p2.id ELSE 'P-0' END FROM p2) AND dst IN (SELECT id FROM k1))"""
q("g11_shortest_path", m.sql("SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INT) AS step, id FROM (SELECT 1 AS o, 'P-0' AS id UNION ALL SELECT 2, id FROM p2 WHERE 'P-0' IN (SELECT id FROM k3) "
                             "UNION ALL SELECT 3, id FROM p1 WHERE 'P-0' NOT IN (SELECT id FROM k1) UNION ALL SELECT 4, 'P-1')", _dist))(
    lambda s, d: gr.shortest_path(part_graph(s, d), "P-0", "P-1"))


def _homes_membership(s, d):
    """Communities by home: the smallest person of a shared home."""
    p = persons(s, d).select(gr.person_id("person_key").alias("id"), "home_cell")
    return p.join(p.groupBy("home_cell").agg(F.min("id").alias("community")), "home_cell").select("id", "community")


_comm = "comm AS (SELECT 'P-' || person_key AS id, min('P-' || person_key) OVER (PARTITION BY cell) AS community FROM homes)"
q("g12_community_of_case", m.sql("SELECT id, CASE WHEN id LIKE 'C-%' THEN 'case' ELSE 'person' END AS kind FROM (SELECT id FROM mem UNION SELECT a FROM edges WHERE a LIKE 'C-%' AND b IN (SELECT id FROM mem) "
                                 "UNION SELECT 'C-5')" + TAG, EDGES, _comm,
                                 "mem AS (SELECT id FROM comm WHERE community = (SELECT community FROM comm WHERE id = (SELECT min(b) FROM edges WHERE a = 'C-5')))"))(
    lambda s, d: gr.communities_of_case(graph(s, d), _homes_membership(s, d), 5))
q("g13_induced", m.sql("SELECT a, b, kind FROM edges WHERE a IN (SELECT 'P-' || person_key FROM registry WHERE home_lat >= 15.0) AND b IN (SELECT 'P-' || person_key FROM registry WHERE home_lat >= 15.0)" + TAG, EDGES))(
    lambda s, d: gr.induced(graph(s, d), m.registry(s, d).where("home_lat >= 15.0").select(gr.person_id("person_key").alias("id"))).edges)
q("g14_degree_by_kind", m.sql("SELECT id, kind, count(*) AS n FROM (SELECT a AS id, kind FROM edges UNION ALL SELECT b, kind FROM edges) GROUP BY ALL" + TAG, EDGES))(
    lambda s, d: gr.neighbours_by_kind(graph(s, d).edges))
q("g14_spokes", m.sql("SELECT DISTINCT a AS id FROM edges WHERE b = 'P-7' AND kind IN ('accused_in', 'mule_account')" + TAG, EDGES))(
    lambda s, d: gr.spokes(graph(s, d).edges, "P-7"))
q("g15_network_person", m.sql("SELECT dst AS id, CASE WHEN dst LIKE 'C-%' THEN 'case' ELSE 'person' END AS kind FROM (SELECT dst FROM both_ways WHERE src = 'P-3' UNION SELECT 'P-3')" + TAG, EDGES))(
    lambda s, d: gr.network(graph(s, d), person=3, depth=1))
q("g16_stats", m.sql("SELECT (SELECT count(*) FROM registry) AS persons, (SELECT count(DISTINCT a) FROM edges WHERE a LIKE 'C-%') AS cases, (SELECT count(DISTINCT cell) FROM homes) AS communities" + TAG, EDGES))(
    lambda s, d: gr.stats(graph(s, d), _homes_membership(s, d)))


@q("t10_score_with_centrality")
def _central(s, d):
    """Scores with centrality in the network of shared orders and homes, from the paths of all persons."""
    central = gr.betweenness(gr.project(graph(s, d).edges), k=None)
    central = cut(central.select(F.substring("id", 3, 20).cast("bigint").alias("person_key"), "centrality"), "centrality")
    return scores(s, d, central)
