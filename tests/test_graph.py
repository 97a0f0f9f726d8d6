from __future__ import annotations

import glob
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.operators import communities as cm, graph as gr
from caseweave.plans import views


def _hub_graph(spark):
    """One person named in 14 cases, 8 more tied only by a shared number in the text."""
    links = [(1, c) for c in range(14)] + [(2, 3), (3, 3), (9, 100)]
    persons = [(p, f"name {p}", h) for p, h in ((1, "h1"), (2, "h2"), (3, "h2"), (9, None), (10, "h3"))] + [(20 + i, "x", "crowd") for i in range(6)]
    texts = [(c, "98450-12XXX") for c in range(22)] + [(100, "11111-1111"), (101, "11111-1111")]
    return gr.build(spark.createDataFrame(persons, "person_key int, full_name string, home_cell string"),
                    spark.createDataFrame(links, "person_key int, case_id int"),
                    spark.createDataFrame([(2, 3, 3), (1, 2, 3), (2, 1, 3), (1, 1, 3)], "person_a int, person_b int, case_id int"),
                    spark.createDataFrame(texts, "case_id int, ident string"))


def test_hub_has_22_spokes(spark):
    g = _hub_graph(spark)
    cases = gr.ego(g, "P-1", 1).nodes.where("kind = 'case'").count()
    assert cases == 22
    assert g.edges.where("kind = 'mule_account'").count() == 8
    assert gr.spokes(g.edges, "P-1").count() == 22


def test_homes_of_two_to_four_only(spark):
    g = _hub_graph(spark)
    assert [tuple(r) for r in g.edges.where("kind = 'same_address'").select("a", "b").collect()] == [("P-2", "P-3")]


def test_cases_carry_their_meta_and_homes_their_limits(spark):
    persons = spark.createDataFrame([(i, f"n{i}", "h") for i in range(5)], "person_key int, full_name string, home_cell string")
    links = spark.createDataFrame([(0, 7), (1, 8)], "person_key int, case_id int")
    pairs = spark.createDataFrame([], "person_a int, person_b int")
    meta = spark.createDataFrame([(7, "theft", "City"), (99, "fraud", "City")], "case_id int, crime_sub_head string, district string")
    g = gr.build(persons, links, pairs, home_sizes=(2, 5), case_meta=meta)
    got = {r["id"]: (r["kind"], r["crime_sub_head"], r["district"]) for r in g.nodes.collect()}
    assert got["C-7"] == ("case", "theft", "City") and got["C-8"] == ("case", None, None) and got["P-0"] == ("person", None, None)
    assert len(got) == 7 and g.edges.where("kind = 'same_address'").count() == 10
    assert gr.build(persons, links, pairs).edges.where("kind = 'same_address'").count() == 0
    with pytest.raises(ValueError, match="label"):
        gr.build(persons, links, pairs, case_meta=meta.withColumnRenamed("district", "label"))


def test_paths(spark):
    g = _hub_graph(spark)
    assert [r["id"] for r in gr.shortest_path(g, "P-1", "P-3").orderBy("step").collect()] == ["P-1", "C-3", "P-3"]
    assert gr.shortest_path(g, "P-1", "P-10").count() == 0
    assert gr.shortest_path(g, "P-1", "P-404").count() == 0
    assert gr.ego(g, "P-404").nodes.count() == 0


def test_community_of_case_contains_ring(spark):
    g = _hub_graph(spark)
    comm = cm.louvain(gr.project(g.edges), nodes=g.nodes.where("kind = 'person'"))
    ids = {r["id"] for r in gr.communities_of_case(g, comm, 3).collect()}
    assert {"P-1", "P-2", "P-3", "C-3"} <= ids
    assert {r["id"] for r in gr.communities_of_case(g, comm, 100).collect()} >= {"P-9", "C-100"}
    assert gr.communities_of_case(g, comm, 12345).count() == 0


def _brandes(edges, n):
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    total = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        order, sigma, dist, delta = [], dict.fromkeys(range(n), 0.0), {s: 0}, dict.fromkeys(range(n), 0.0)
        sigma[s] = 1.0
        todo = deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    top = max(total.values())
    return {k: v / top for k, v in total.items()}


def test_betweenness_equals_brute_force(spark):
    rng = random.Random(9)
    edges = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(45)} | {(i, i + 1) for i in range(29)}
    want = _brandes(edges, 30)
    got = {r["id"]: r["centrality"] for r in gr.betweenness(spark.createDataFrame(sorted(edges), "a int, b int"), k=None).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(30))


def test_betweenness_adds_up_parts_of_the_sources(spark):
    """Sources come a few at a time; only the sums of the last turn stay as a table."""
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(20), 2))) for _ in range(30)} | {(i, i + 1) for i in range(19)}
    want = _brandes(edges, 20)
    tables = lambda: {p for label in ("level", "delta", "betweenness", "dependencies", "sources") for p in glob.glob(f"{spark.conf.get('spark.checkpoint.dir').replace('file:', '')}/caseweave-{label}-*")}
    before = tables()
    got = {r["id"]: r["centrality"] for r in gr.betweenness(spark.createDataFrame(sorted(edges), "a int, b int"), k=None, at_once=7).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(20)) and len(tables() - before) == 1


def test_scores_take_centrality_from_all_persons(spark, monkeypatch):
    """Eight sources were sampled; here a path of twelve persons, of whom each is a source."""
    from bindings import network
    seen = {}
    edges = spark.createDataFrame([(f"P-{i:02d}", f"P-{i + 1:02d}", "same_address") for i in range(11)], "a string, b string, kind string")
    monkeypatch.setattr(network, "graph", lambda s, d: gr.Graph(None, edges))
    monkeypatch.setattr(network, "scores", lambda s, d, central: seen.update({r["person_key"]: r["centrality"] for r in central.collect()}))
    network._central(spark, None)
    want = [i * (11 - i) / 30 for i in range(12)]  # pairs parted by a person of the path, the largest being 30
    assert all(abs(seen[i] - want[i]) < 1e-9 for i in range(12))


def test_pairs_of_unregistered_persons_give_no_edge(spark):
    g = gr.build(spark.createDataFrame([(1, "x", None), (3, "y", None)], "person_key int, full_name string, home_cell string"),
                 spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "person_key int, case_id int"),
                 spark.createDataFrame([(1, 2, 5), (1, 3, 5), (2, 3, 5)], "person_a int, person_b int, case_id int"))
    assert [tuple(r) for r in g.edges.where("kind = 'co_accused'").select("a", "b").collect()] == [("P-1", "P-3")]


def test_louvain_separates_cliques_and_does_not_lose_modularity(spark):
    edges = []
    for base in (0, 10, 20):
        edges += [(base + i, base + j) for i in range(6) for j in range(i)]
    edges += [(0, 10), (10, 20)]
    df = spark.createDataFrame(edges, "a int, b int")
    comm = cm.louvain(df)
    groups = {}
    for r in comm.collect():
        groups.setdefault(r["community"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [list(range(b, b + 6)) for b in (0, 10, 20)]
    single = comm.select("id", F.col("id").alias("community"))
    assert cm.modularity(df, comm) > cm.modularity(df, single)


def _dependencies(pairs, sources):
    """Dependencies by Brandes' algorithm in plain Python."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    total = dict.fromkeys(near, 0.0)
    for s in sources:
        hops, paths, order, queue = {s: 0}, {s: 1.0}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in hops:
                    hops[w], paths[w] = hops[v] + 1, 0.0
                    queue.append(w)
                if hops[w] == hops[v] + 1:
                    paths[w] += paths[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if hops[v] == hops[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    top = max(total.values())
    return {v: x / top for v, x in total.items()}


def test_betweenness_sends_only_the_edges_of_the_smaller_side(spark, monkeypatch):
    """A dense part reached in two hops, with a tail and a part of its own that some sources never meet."""
    rnd = random.Random(3)
    pairs = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(700)} | {(59, 60), (60, 61), (61, 62), (70, 71), (71, 72)}
    edges = spark.createDataFrame(sorted(pairs), "a int, b int")
    sources = [1, 5, 30, 62, 71]
    calls, plain = [], gr.cut
    monkeypatch.setattr(gr, "cut", lambda df, label="stage": calls.append(label) or plain(df, label))
    got = {r["id"]: r["centrality"] for r in gr.betweenness(edges, sources=spark.createDataFrame([(i,) for i in sources], "id int")).collect()}
    want = _dependencies(pairs, sources)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    calls.clear()
    full = [(a, b) for a in range(12) for b in range(a)]
    assert set(gr.betweenness(spark.createDataFrame(full, "a int, b int"), k=3).select("centrality").toPandas()["centrality"]) == {0.0}
    assert calls.count("level") == 2 and calls.count("delta") == 0  # all nodes are met after one hop; before: a third level and a delta of the sources


def test_ego_reads_the_edge_table_without_laying_it_out(spark, monkeypatch):
    def refuse(edges):
        raise AssertionError("all edges would be shuffled and stored for a few hops")
    monkeypatch.setattr(gr, "adjacency", refuse)
    g = _hub_graph(spark)
    twice = gr.Graph(g.nodes, g.edges.unionByName(g.edges))
    assert {r["id"] for r in gr.ego(twice, "P-2", 1).nodes.collect()} == {"P-1", "P-2", "P-3", "C-3"}


def test_louvain_of_the_parts_goes_on_while_gains_are_small(spark, monkeypatch):
    """A least gain of 0.005 ended the rounds of a random graph early; the operator's own is 1e-7."""
    from bindings import network
    with monkeypatch.context() as seen:
        seen.setattr(network.cm, "louvain", lambda edges, **given: given)
        seen.setattr(network, "part_graph", lambda s, d: gr.Graph(None, None))
        assert network._louvain(spark, None) == {}
    assert cm.louvain.__defaults__[-1] <= 1e-7
    rng = random.Random(11)
    pairs = sorted({tuple(sorted(rng.sample(range(400), 2))) for _ in range(4000)})
    edges = spark.createDataFrame(pairs, "a int, b int")
    monkeypatch.setattr(network, "part_graph", lambda s, d: gr.Graph(None, edges))
    comm = {r["id"]: r["community"] for r in network._louvain(spark, None).collect()}
    degree = [sum(v in p for p in pairs) for v in range(400)]

    def quality(of):
        total = {}
        for v, c in of.items():
            total[c] = total.get(c, 0) + degree[v]
        return sum(of[a] == of[b] for a, b in pairs) / len(pairs) - sum((t / 2 / len(pairs)) ** 2 for t in total.values())

    near = {v: [] for v in range(400)}
    for a, b in pairs:
        near[a].append(b), near[b].append(a)
    plain, total, moved = {v: v for v in near}, dict(enumerate(degree)), True
    while moved:  # one level, node after node, until none gains
        moved = False
        for v in near:
            total[plain[v]] -= degree[v]
            gain = lambda c: sum(plain[u] == c for u in near[v]) - degree[v] * total[c] / 2 / len(pairs)  # noqa: B023, E731
            best = max([plain[v], *sorted({plain[u] for u in near[v]})], key=lambda c: (gain(c), c == plain[v]))  # noqa: B023
            if gain(best) > gain(plain[v]) + 1e-9:
                plain[v], moved = best, True
            total[plain[v]] += degree[v]
    assert all(min(v for v in comm if comm[v] == c) == c for c in set(comm.values()))
    assert quality(comm) > 0.97 * quality(plain)
    assert abs(quality(comm) - cm.modularity(edges, spark.createDataFrame(list(comm.items()), "id int, community int"))) < 1e-9


def test_louvain_parts_give_the_best_community_of_each_node(monkeypatch):
    rng = np.random.default_rng(5)
    n = 30
    links = rng.integers(0, n, (120, 2))
    w = rng.random(120) + 0.1
    near = np.zeros((n, n))
    for (a, b), x in zip(links, w):
        near[a, b] += x
        near[b, a] += x
    k, comm = near.sum(1), rng.integers(0, 6, n).astype(np.int32)
    src, dst = np.nonzero(near)
    tot, m2 = np.bincount(comm, weights=k, minlength=n), k.sum()
    node, to, better, inside = cm._offers(cm._layout(src.astype(np.int32), dst.astype(np.int32), near[src, dst]), comm, k, tot, m2)
    assert abs(inside - sum(near[a, b] for a in range(n) for b in range(n) if a != b and comm[a] == comm[b])) < 1e-9
    for v, c, good in zip(node, to, better):
        gain = lambda x: sum(near[v, u] for u in range(n) if u != v and comm[u] == x) - k[v] * (tot[x] - (k[v] if x == comm[v] else 0)) / m2  # noqa: B023, E731
        offers = {comm[u] for u in np.flatnonzero(near[v]) if u != v}
        assert abs(gain(c) - max(map(gain, offers))) < 1e-9 and good == (max(map(gain, offers)) > gain(comm[v]) + 1e-12)


def test_louvain_leaves_one_table(spark):
    edges = spark.createDataFrame([(b + i, b + j) for b in (0, 10, 20) for i in range(6) for j in range(i)] + [(0, 10), (10, 20)], "a int, b int")
    tables = lambda: set(glob.glob(spark.conf.get("spark.checkpoint.dir").replace("file:", "") + "/caseweave-louvain-*"))
    before = tables()
    cm.louvain(edges)
    assert len(tables() - before) == 1  # the membership


def test_co_accused_pairs_come_once_whichever_record_is_first(spark):
    rows = spark.createDataFrame([(1, "p", 1), (1, "q", 2), (1, "p", 3), (2, "q", 1), (2, "p", 2), (3, "p", 1), (3, "q", 1), (4, "p", 1), (4, "p", 2), (None, "p", 1)],
                                 "case int, who string, ord int")
    pairs = views.co_occurrence(rows, "case", "who", "ord", directed=False)
    assert sorted(map(tuple, pairs.collect())) == [("p", "q", 1), ("p", "q", 2)]
    both = views.co_occurrence(rows, "case", "who", "ord")
    assert gr.co_accused_edges(pairs).collect() == gr.co_accused_edges(both).collect()
