"""The distributed hierarchy against a plain top-down recursion on small inputs."""
from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import hierarchy as hi


def _components(nodes, edges):
    seen, out = set(), []
    near = {n: [] for n in nodes}
    for a, b, _ in edges:
        near[a].append(b), near[b].append(a)
    for n in nodes:
        if n not in seen:
            todo, comp = [n], set()
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp.add(x)
                    todo += near[x]
            seen |= comp
            out.append(comp)
    return out


def _split(nodes, edges, birth, m):
    """Cluster node: dict(points, birth, stability, children) by removing longest edges."""
    start, total, children = birth, 0.0, []
    nodes, edges = set(nodes), sorted(edges, key=lambda e: (e[2], e[0], e[1]))
    points = set(nodes)
    while True:
        if not edges:
            break
        last = edges.pop()
        parts = _components(nodes, edges)
        rate = 1 / max(last[2], 1e-9)
        big = [p for p in parts if len(p) >= m]
        if len(big) == 2:
            total += rate * len(nodes)
            for p in big:
                children.append(_split(p, [e for e in edges if e[0] in p], last[2], m))
            break
        if len(big) == 1:
            total += rate * (len(nodes) - len(big[0]))
            nodes = big[0]
            edges = [e for e in edges if e[0] in nodes]
        else:
            total += rate * len(nodes)
            break
    return {"points": points, "birth": start, "stability": total - len(points) / start, "children": children}


def _brute(n, weights, m, eps):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    mst = []
    for d, a, b in sorted((d, a, b) for (a, b), d in weights.items() if d < 1):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            mst.append((a, b, d))
    comps = [c for c in _components(range(n), mst) if len(c) >= m]
    tops = [_split(c, [e for e in mst if e[0] in c], 1.0, m) for c in comps]
    if len(comps) == 1 and len(comps[0]) == n:
        tops = tops[0]["children"]

    def best(c):
        parts = sum(best(k) for k in c["children"])
        c["wins"] = c["stability"] >= parts
        return max(c["stability"], parts)

    out = []

    def choose(c, path):
        if c["wins"]:
            pick = c
            if c["birth"] < eps:
                for p in reversed(path):
                    pick = p
                    if p["birth"] > eps:
                        break
            out.append(frozenset(pick["points"]))
        else:
            for k in c["children"]:
                choose(k, path + [c])

    for t in tops:
        best(t)
        choose(t, [])
    return set(out)


@pytest.mark.parametrize("seed,slab,m,eps", [(3, 20, 3, 0.1), (4, 1000, 4, 0.35)])
def test_equals_recursion(spark, seed, slab, m, eps):
    rng = random.Random(seed)
    pts = [(rng.gauss(cx, s), rng.gauss(cy, s)) for cx, cy, s, k in ((0, 0, .03, 12), (.3, 0, .04, 10), (.3, .35, .02, 8), (1.5, 1.5, .05, 9), (2.4, 0, .3, 8)) for _ in range(k)]
    weights = {(i, j): min(1.0, ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5) for i, p in enumerate(pts) for j, q in enumerate(pts) if i < j}
    df = spark.createDataFrame([(a, b, 1.0 - d) for (a, b), d in weights.items()], "a long, b long, score double")
    weights = {k: 1.0 - (1.0 - d) for k, d in weights.items()}
    nodes = spark.range(len(pts)).withColumnRenamed("id", "node")
    got = {}
    for r in hi.hierarchy(df, nodes, min_size=m, epsilon=eps, slab=slab).collect():
        got.setdefault(r["cluster"], set()).add(r["node"])
    assert {frozenset(v) for v in got.values()} == _brute(len(pts), weights, m, eps)


def test_spanning_forest_equals_kruskal(spark):
    rng = random.Random(9)
    edges = {(a, b): rng.choice([0.1, 0.2, 0.3, 0.4]) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(260)) if a < b}
    edges.update({(100 + i, 101 + i): 0.5 for i in range(40)})  # a chain of ties
    edges[(300, 301)] = 0.9
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    want = set()
    for d, a, b in sorted((d, a, b) for (a, b), d in edges.items()):
        if find(a) != find(b):
            up[find(a)] = find(b)
            want.add((a, b, d))
    rows = [(b, a, d) if i % 3 else (a, b, d) for i, ((a, b), d) in enumerate(edges.items())] + [(5, 5, 0.0), (300, 301, 0.95)]
    df = spark.createDataFrame(rows, "a long, b long, d double")
    assert {tuple(r) for r in hi.spanning_forest(df).collect()} == want
    assert hi.spanning_forest(df.where("false")).count() == 0


@pytest.mark.parametrize("every", [7, 1 << 20])
def test_thinned_edges_grow_with_nodes_and_hold_the_forest(spark, every):
    """Every pair of 80 nodes, with ties, loops, copies and nulls, over three tasks."""
    from caseweave.operators.clusters import thinned
    rng = random.Random(5)
    rows = [(a, b, rng.choice([0.1, 0.2, 0.3]), "kept") for a in range(80) for b in range(80)]
    odd = [(None, 3, 0.1, "kept"), (3, 4, None, "kept"), (3, 4, None, "kept")]
    df = spark.createDataFrame(rows + odd, "a long, b long, d double, more string").repartition(3)
    got = thinned(df, order="d", every=every).cache()
    assert got.schema == df.schema and got.where("a IS NULL").count() == 1 and got.where("d IS NULL").count() == 2
    got = got.where("a IS NOT NULL AND d IS NOT NULL")
    forest = lambda e: {tuple(r) for r in hi.spanning_forest(e.select("a", "b", "d")).collect()}
    assert forest(got) == forest(df.where("a IS NOT NULL AND d IS NOT NULL"))
    if every > 7:
        assert got.count() <= 3 * 79
    nearest = {n: min((d, min(a, b), max(a, b)) for a, b, d, _ in rows if n in (a, b) and a != b) for n in range(80)}
    held = {(r["d"], min(r["a"], r["b"]), max(r["a"], r["b"])) for r in got.collect()}
    assert set(nearest.values()) <= held


def test_thinned_text_ids_and_no_order(spark):
    from caseweave.operators.clusters import components, thinned
    rng = random.Random(6)
    df = spark.createDataFrame([(f"n{rng.randrange(50)}", f"n{rng.randrange(50)}") for _ in range(400)] + [("x", "y")], "a string, b string").repartition(2)
    found = lambda e: {tuple(r) for r in components(e).collect()}
    assert found(thinned(df)) == found(df) and thinned(df).count() <= 2 * 51
    assert thinned(df.where("false")).count() == 0


def test_strongest_pairs_inside_a_cluster_give_its_confidence(spark):
    """Records without a vector have pairs without a score, which bind a cluster but are nobody's strongest."""
    import datetime as dt

    from bindings import linking
    from caseweave.operators import linkage as lk
    rng = random.Random(7)
    rows = [(i, "xy"[i % 2], dt.date(2025, 1, 1) + dt.timedelta(days=rng.randrange(90)), 12 + rng.random() / 2, 75.0, rng.choice(["car", "auto"]), "cash", "night", 1,
             [rng.random(), rng.random()] if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "case_id long, crime_sub_head string, registered date, latitude double, longitude double, vehicle string, target string, "
                                     "tod string, dow int, embedding array<double>")
    members = spark.createDataFrame([(i, i % 4) for i in range(50)], "case_id long, component long")
    listed = lambda pairs: sorted((r[0], r[1], round(r[2], 9)) for r in lk.confidence(members, pairs).collect())
    want = listed(lk.score_pairs(lk.candidate_pairs(df), df))
    assert listed(linking._strongest_inside(df, members)) == want and len(want) == 4


def test_crowded_cells_give_the_forest_of_all_scored_pairs(spark, monkeypatch):
    """Scored as matrices, of whole and of split cells; some records have no vector, and no pair of numbers is joined."""
    import datetime as dt

    from caseweave.operators import dense_links, linkage as lk
    rng = random.Random(3)
    rows = [(i, "xy"[i % 2], dt.date(2025, 1, 1) + dt.timedelta(days=rng.randrange(500)), 12 + rng.randrange(30) / 20, 75 + rng.randrange(30) / 20, rng.choice(["car", "auto", None]),
             rng.choice(["cash", "gold"]), rng.choice(["night", "day"]), 1, [rng.random(), rng.random()] if i % 40 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "case_id long, crime_sub_head string, registered date, latitude double, longitude double, vehicle string, target string, "
                                     "tod string, dow int, embedding array<double>")

    def forest(pairs):
        sets = hi._Sets()
        rows = sorted((-r["score"], r["a"], r["b"]) for r in pairs.collect() if r["score"] is not None)
        return [(a, b, round(d, 9)) for d, a, b in rows if sets.join(a, b)]

    monkeypatch.setattr(dense_links, "MANY", 100)
    monkeypatch.setattr(dense_links, "BLOCK", 16)
    want = forest(lk.score_pairs(lk.candidate_pairs(df, threshold=0.6), df, threshold=0.6))
    assert forest(lk.strongest_pairs(df, threshold=0.6, dense_pairs=0, cell_rows=20)) == want and len(want) > 100


def test_series_of_the_given_tables_equal_recursion(spark):
    """All open cases of the smallest tables, block by block."""
    from bindings import linking
    df, pairs, members = linking._clusters(spark, "/root/testdata/sf0.001")
    block = {r["case_id"]: r["crime_sub_head"] for r in df.select("case_id", "crime_sub_head").collect()}
    got, scored = {}, {}
    for r in members.collect():
        got.setdefault(r["component"], set()).add(r["case_id"])
    for r in pairs.select("block", "a", "b", "score").collect():
        scored.setdefault(r["block"], []).append((r["a"], r["b"], min(1.0, max(0.0, 1.0 - r["score"]))))
    want = set()
    for name, rows in scored.items():
        ids = sorted(c for c, b in block.items() if b == name)
        at = {c: i for i, c in enumerate(ids)}
        weights = {(at[a], at[b]): d for a, b, d in rows}
        want |= {frozenset(ids[i] for i in part) for part in _brute(len(ids), weights, 4, 0.35)}
    assert {frozenset(v) for v in got.values()} == want
