"""The entity-case graph as two tables, and searches on it.

nodes(id, kind, label) and edges(a, b, kind) with a < b. Person ids start with 'P-', case
ids with 'C-'. Searches work level by level: each level is one join with the adjacency.
"""
from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import Rounds, cut, drop
from .ranking import top_k_per_group


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def person_id(c: Column | str) -> Column:
    return F.concat(F.lit("P-"), (F.col(c) if isinstance(c, str) else c).cast("string"))


def case_id(c: Column | str) -> Column:
    return F.concat(F.lit("C-"), (F.col(c) if isinstance(c, str) else c).cast("string"))


def _edge(a: Column, b: Column, kind: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.lit(kind).alias("kind")]


def accused_edges(links: DataFrame, person: str = "person_key", case: str = "case_id") -> DataFrame:
    return links.select(person, case).distinct().select(*_edge(person_id(person), case_id(case), "accused_in"))


def co_accused_edges(pairs: DataFrame, a: str = "person_a", b: str = "person_b") -> DataFrame:
    """Undirected and without self-loops; ``pairs`` may hold a pair once per case."""
    once = pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()
    return once.select(*_edge(person_id(a), person_id(b), "co_accused"))


def same_address_edges(homes: DataFrame, person: str = "person_key", home: str = "home_cell", low: int = 2, high: int = 4) -> DataFrame:
    """Persons sharing a home, for homes of ``low`` to ``high`` persons only.

    The home sizes are counted before the pairs are formed, so a crowded home never is a
    group, whatever its share of the table.
    """
    known = homes.where(F.col(home).isNotNull()).select(person, home)
    sizes = known.groupBy(home).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(low, high)).select(home)
    small = known.join(sizes, home, "left_semi")
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, (F.col(f"x.{home}") == F.col(f"y.{home}")) & (F.col(f"x.{person}") < F.col(f"y.{person}")))
    return pairs.select(*_edge(person_id(F.col(f"x.{person}")), person_id(F.col(f"y.{person}")), "same_address"))


def hub_edges(mentions: DataFrame, links: DataFrame, person: str = "person_key", case: str = "case_id",
              ident: str = "ident", min_cases: int = 3) -> DataFrame:
    """For every identifier in enough cases: its dominant person, tied to all its cases.

    ``mentions`` is (case, ident). The dominant person is accused in most of the cases (the
    smallest id on ties). Cases already linked to the person get no second edge.
    """
    seen = mentions.select(case, ident).distinct()
    shared = seen.groupBy(ident).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_cases).select(ident)
    seen = cut(seen.join(shared, ident, "left_semi"), "mentions")
    links = links.select(person, case).distinct()
    counts = seen.join(links, case).groupBy(ident, person).agg(F.count(F.lit(1)).alias("n"))
    hub = top_k_per_group(counts, [ident], [F.desc("n"), person], 1).select(ident, person)
    ties = hub.join(seen, ident).select(person, case).distinct().join(links, [person, case], "left_anti")
    return ties.select(*_edge(person_id(person), case_id(case), "mule_account"))


def build(persons: DataFrame, links: DataFrame, pairs: DataFrame, mentions: DataFrame | None = None,
          case_labels: DataFrame | None = None, person: str = "person_key", label: str = "full_name",
          home: str = "home_cell", case: str = "case_id", min_cases: int = 3, home_sizes: tuple[int, int] = (2, 4),
          case_meta: DataFrame | None = None) -> Graph:
    """All persons, the cases that occur in an edge, and the edges of all kinds.

    Only persons of the registry take part. ``case_labels`` is (case, label). ``case_meta``
    is (case, ...): its other columns become columns of the nodes, null for persons and for
    cases it does not hold. ``home_sizes`` are the least and most persons of a home that ties them.
    """
    links = links.join(persons.select(person), person, "left_semi").select(person, case)
    for end in ("person_a", "person_b"):
        pairs = pairs.join(persons.select(F.col(person).alias(end)).distinct(), end, "left_semi")
    edges = accused_edges(links, person, case).unionByName(co_accused_edges(pairs))
    edges = edges.unionByName(same_address_edges(persons, person, home, *home_sizes))
    if mentions is not None:
        edges = edges.unionByName(hub_edges(mentions, links, person, case, min_cases=min_cases))
    edges = cut(edges, "edges")
    person_nodes = persons.select(person_id(person).alias("id"), F.lit("person").alias("kind"), F.col(label).alias("label"))
    in_edges = edges.select(F.explode(F.array("a", "b")).alias("id")).where(F.col("id").startswith("C-")).distinct()
    case_nodes = in_edges.select("id", F.lit("case").alias("kind"), F.col("id").alias("label"))
    if case_labels is not None:
        named = case_labels.select(case_id(case).alias("id"), F.col("label").cast("string").alias("_label"))
        case_nodes = in_edges.join(named, "id", "left").select("id", F.lit("case").alias("kind"), F.coalesce("_label", "id").alias("label"))
    if case_meta is not None:
        columns = [c for c in case_meta.columns if c != case]
        clash = sorted({c.lower() for c in columns} & {"id", "kind", "label"})
        if clash:
            raise ValueError(f"case_meta would overwrite node columns: {clash}")
        meta = case_meta.select(case_id(case).alias("id"), *columns)
        case_nodes = case_nodes.join(meta, "id", "left")
    return Graph(person_nodes.unionByName(case_nodes, allowMissingColumns=True), edges)


def simple(edges: DataFrame) -> DataFrame:
    """One row per node pair with the set of its kinds (at most one entry per kind)."""
    return edges.groupBy("a", "b").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def _directed(pairs: DataFrame) -> DataFrame:
    """Directed copies (src, dst); a search of few hops reads them from the edge table, without laying it out anew."""
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def both_ways(edges: DataFrame) -> DataFrame:
    """Directed copies (src, dst) of distinct node pairs."""
    return _directed(edges.select("a", "b").distinct())


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions, laid out by source and kept for the rounds of a search, so that the
    levels reuse one shuffle. Lost parts are recomputed from the edge table."""
    return both_ways(edges).repartition("src").persist(StorageLevel.MEMORY_AND_DISK)


def project(edges: DataFrame) -> DataFrame:
    """Person pairs that share a case (accused or hub) or a home."""
    on_case = edges.where(F.col("kind").isin("accused_in", "mule_account")).select(
        F.col("b").alias("person"), F.col("a").alias("case")).distinct()  # 'C-' sorts before 'P-'
    x, y = on_case.alias("x"), on_case.alias("y")
    shared = x.join(y, (F.col("x.case") == F.col("y.case")) & (F.col("x.person") < F.col("y.person"))).select(
        F.col("x.person").alias("a"), F.col("y.person").alias("b"))
    return shared.unionByName(edges.where(F.col("kind") == "same_address").select("a", "b")).distinct()


def induced(graph: Graph, ids: DataFrame) -> Graph:
    """The nodes of ``ids`` and the edges among them."""
    ids = ids.select("id").distinct()
    inside = graph.edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(
        ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return Graph(graph.nodes.join(ids, "id", "left_semi"), inside)


def reach(adj: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, hops) of all nodes within ``depth`` hops of the start nodes."""
    seen = cut(start.select("id").distinct().withColumn("hops", F.lit(0)), "reach")
    for hop in range(1, depth + 1):
        frontier = seen.where(F.col("hops") == hop - 1).select(F.col("id").alias("src"))
        fresh = adj.join(frontier, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        fresh = fresh.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop))
        seen = cut(seen.unionByName(fresh), "reach")
    return seen


def ego(graph: Graph, node: str, depth: int = 2) -> Graph:
    """Nodes within ``depth`` hops of a node and the edges among them; empty if unknown."""
    start = graph.nodes.where(F.col("id") == node).select("id")
    return induced(graph, reach(_directed(graph.edges), start, depth))


def shortest_path(graph: Graph, a: str, b: str) -> DataFrame:
    """(step, id) of the smallest shortest path from a to b; no rows if there is none.

    Levels grow from b, every node remembers its smallest neighbour one level nearer to b;
    from a these are followed back. The path is as long as the graph is wide, not as it is
    large.
    """
    spark = graph.edges.sparkSession
    adj = adjacency(graph.edges)
    known = graph.nodes.where(F.col("id").isin(a, b)).select("id")
    level = cut(known.where(F.col("id") == b).where(F.lit(known.count() == len({a, b}))).select("id", F.lit(None).cast("string").alias("next")), "path")
    levels = [level]
    try:
        while not level.isEmpty() and level.where(F.col("id") == a).isEmpty():
            step = adj.join(level.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("next"))
            # neighbours of a level lie in the level before, the same or the next one
            old = level if len(levels) == 1 else level.unionByName(levels[-2])
            level = cut(step.join(old.select("id"), "id", "left_anti"), "path")
            levels.append(level)
    finally:
        adj.unpersist()
    path, here = [], a
    for row_level in reversed(levels):
        row = row_level.where(F.col("id") == here).select("id", "next").first()
        if row is None:
            break
        path.append(row["id"])
        here = row["next"]
    found = bool(path) and path[-1] == b
    rows = list(enumerate(path)) if found else []
    return spark.createDataFrame(rows, "step int, id string")


def neighbours_by_kind(edges: DataFrame) -> DataFrame:
    """(id, kind, n) degree per edge kind."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"), "kind")
    return ends.groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n"))


def communities_of_case(graph: Graph, membership: DataFrame, case) -> DataFrame:
    """(id, kind) of the community around a case: the members of the community of its
    smallest person, and their cases. ``membership`` is (id, community).

    Without a known person only the case remains; an unknown case gives no rows.
    """
    node = f"C-{case}"
    persons = graph.edges.where((F.col("a") == node) & F.col("b").startswith("P-")).select(F.col("b").alias("id"))
    first = persons.agg(F.min("id").alias("id"))
    own = membership.join(first, "id", "left_semi").select("community")
    members = membership.join(own, "community", "left_semi").select("id")
    members = members.unionByName(persons.join(membership, "id", "left_anti")).distinct()
    cases = graph.edges.where(F.col("a").startswith("C-")).join(members.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id"))
    self_node = graph.nodes.where(F.col("id") == node).select("id")
    ids = members.unionByName(cases).unionByName(self_node).distinct()
    return graph.nodes.join(ids, "id", "left_semi").select("id", "kind")


def network(graph: Graph, membership: DataFrame | None = None, person=None, case=None, depth: int = 2) -> DataFrame:
    """Ego network of a person or community of a case, as nodes (id, kind)."""
    if person is not None:
        return ego(graph, f"P-{person}", depth).nodes.select("id", "kind")
    if case is not None:
        return communities_of_case(graph, membership, case)
    raise ValueError("network needs a person or a case")


def stats(graph: Graph, membership: DataFrame) -> DataFrame:
    """Node counts by kind and the number of communities."""
    counts = graph.nodes.agg(F.count_if(F.col("kind") == "person").alias("persons"), F.count_if(F.col("kind") == "case").alias("cases"))
    return counts.withColumn("communities", membership.agg(F.count_distinct("community")).scalar())


def kinds_text(edges: DataFrame, sep: str = "+") -> DataFrame:
    return simple(edges).select("a", "b", F.array_join("kinds", sep).alias("kinds"))


def sampled_sources(nodes: DataFrame, k: int, seed: int = 42, key: str = "id") -> DataFrame:
    """k nodes in the order of a seeded digest of their id: the same on every run."""
    return nodes.select(key).distinct().orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(k)


#: Sources that are searched at a time: a step holds so many rows a node at most, whatever the number of sources.
SOURCES = 256


def betweenness(edges: DataFrame, k: int | None = 200, seed: int = 42, sources: DataFrame | None = None, at_once: int = SOURCES) -> DataFrame:
    """(id, centrality) from shortest paths of k sampled sources (with None, of all nodes), scaled by the largest.

    Sources are searched ``at_once`` at a time and their dependencies added up; the tables of a
    search go when it ends, so disk grows with the nodes and not with nodes times sources.
    """
    adj = adjacency(edges)
    try:
        nodes = adj.select(F.col("src").alias("id")).distinct()
        chosen = sources if sources is not None else (nodes if k is None else sampled_sources(nodes, k, seed))
        if sources is None and k is not None and k <= at_once:
            raw = _dependencies(adj, nodes, chosen)
        else:
            chosen = cut(chosen.select("id"), "sources")
            turns = max(1, math.ceil(chosen.count() / at_once))
            total, raw = Rounds(edges.sparkSession, "dependencies"), None
            for turn in range(turns):
                part = _dependencies(adj, nodes, chosen.where(F.pmod(F.xxhash64("id"), F.lit(turns)) == turn) if turns > 1 else chosen)
                if turns == 1:
                    raw = part
                else:
                    raw = total.cut(part if raw is None else raw.unionByName(part).groupBy("id").agg(F.sum("raw").alias("raw")))
                    drop(part)
            drop(chosen)
    finally:
        adj.unpersist()
    top = raw.agg(F.max("raw")).scalar()
    return raw.select("id", F.when(top > 0, F.col("raw") / top).otherwise(F.lit(0.0)).alias("centrality"))


def _dependencies(adj: DataFrame, nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, raw) of all nodes: what the shortest paths from the chosen nodes owe them.

    Forward, a level holds (source, node, paths). Neighbours of a level lie in the level
    before, the same or the next one, so only two levels are needed to tell new nodes.
    Backward, every level passes its dependency to the level before. Each step goes out from
    the side with fewer rows: a level looks for new nodes, or the nodes not yet met look for
    the level; a level passes shares down, or the level below fetches them. Either side
    crosses the same edges, so the sums are the same, and the largest level's edges, nearly
    all of which lead nowhere, are not sent. The search ends once every node is met.
    """
    first = cut(chosen.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")), "level")
    starts = first.where(F.col("s").isNotNull()).select("s").distinct()
    levels, sizes = [first], [starts.count()]
    unmet = sizes[0] * nodes.where(F.col("id").isNotNull()).count() - sizes[0]
    while unmet > 0:
        if unmet < sizes[-1]:
            pairs = starts.crossJoin(nodes.where(F.col("id").isNotNull()).select(F.col("id").alias("v")))
            met = functools.reduce(DataFrame.unionByName, [level.select("s", "v") for level in levels])
            ahead = pairs.join(met, ["s", "v"], "left_anti").join(adj, F.col("v") == F.col("src")).select("s", F.col("v").alias("new"), F.col("dst").alias("v"))
            fresh = ahead.join(levels[-1], ["s", "v"]).groupBy("s", F.col("new").alias("v")).agg(F.sum("paths").alias("paths"))
        else:
            grown = (levels[-1].join(adj, F.col("v") == F.col("src")).where(F.col("dst").isNotNull())
                     .groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths")))
            old = levels[-1] if len(levels) == 1 else levels[-1].unionByName(levels[-2])
            fresh = grown.join(old.select("s", "v"), ["s", "v"], "left_anti")
        fresh = cut(fresh, "level")
        found = fresh.count()
        levels.append(fresh)
        if not found:
            break
        sizes.append(found)
        unmet -= found
    carried, passes = None, []  # (s, v, delta) of the level above
    parts: list[DataFrame] = []
    for d in range(len(sizes) - 1, 0, -1):
        upper = levels[d]
        if carried is None:
            upper = upper.withColumn("delta", F.lit(0.0))
        else:
            upper = upper.join(carried, ["s", "v"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        parts.append(upper.select("v", "delta"))
        if d == 1:  # a source depends on nothing
            break
        share = upper.select("s", F.col("v").alias("src"), ((1 + F.col("delta")) / F.col("paths")).alias("share"))
        lower = levels[d - 1].select("s", F.col("v").alias("dst"), "paths")
        # all shares that reach a lower node are summed per (source, node) first
        if sizes[d - 1] < sizes[d]:  # edges go both ways
            passed = lower.select("s", F.col("dst").alias("src")).join(adj, "src").select("s", F.col("src").alias("low"), F.col("dst").alias("src")).join(
                share, ["s", "src"]).groupBy("s", F.col("low").alias("dst")).agg(F.sum("share").alias("share"))
        else:
            passed = share.join(adj, "src").groupBy("s", "dst").agg(F.sum("share").alias("share"))
        carried = cut(passed.join(lower, ["s", "dst"]).select("s", F.col("dst").alias("v"), (F.col("paths") * F.col("share")).alias("delta")), "delta")
        passes.append(carried)
    raw = nodes.select(F.col("id").alias("v"), F.lit(0.0).alias("delta"))
    for p in parts:
        raw = raw.unionByName(p)
    raw = cut(raw.groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("raw")), "betweenness")
    for table in levels + passes:
        drop(table)
    return raw


def spokes(edges: DataFrame, hub: str, kinds: Sequence[str] = ("accused_in", "mule_account")) -> DataFrame:
    """Cases tied to a person."""
    return edges.where((F.col("b") == hub) & F.col("kind").isin(*kinds)).select(F.col("a").alias("id")).distinct()
