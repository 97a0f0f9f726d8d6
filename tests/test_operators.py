from __future__ import annotations

import collections
import hashlib
import math
import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from caseweave.functions import fixed_values as fx, geo, text as tx
from caseweave.operators import (clusters, detect, evaluate as ev, forecast as fc, govern, linkage as lk, neighbours as nb, ranking as rk,
                                 score, spatial, sqlgate, tagging, timeseries as ts)
from caseweave.plans import lineage, views
from test_functions import _km


def test_serial_of_a_hot_group_is_gapless(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("g"))
    got = rk.serial_within(df, ["g"], ["id"], bucket=F.floor(F.col("id") / 300)).groupBy("g").agg(
        F.min("serial"), F.max("serial"), F.count_distinct("serial"), F.max(F.abs(F.col("serial") - F.col("id") - 1))).collect()
    by = {r[0]: tuple(r[1:]) for r in got}
    assert by["hot"] == (1, 4000, 4000, 0) and by["cold"][:3] == (1, 1000, 1000)


def test_row_cap_and_flag(spark):
    rows, cut = rk.capped(spark.range(10), 5)
    assert rows.count() == 5 and cut
    assert not rk.capped(spark.range(5), 5)[1]


def test_co_occurrence_keeps_order_and_self_pairs(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "c", 9)], "case int, p string, ord int")
    got = {tuple(r) for r in views.co_occurrence(rows, "case", "p", "ord").collect()}
    assert got == {("a", "b", 1), ("b", "a", 1), ("a", "a", 1)}


@pytest.mark.parametrize("box", [(12, 18, 74, 78), (-1, 1, 179, 181), (84, 89, -180, 180)])
def test_radius_join_equals_brute_force(spark, box):
    rng = random.Random(3)
    wrap = lambda x: (x + 180) % 360 - 180
    pts = [(i, rng.uniform(*box[:2]), wrap(rng.uniform(*box[2:]))) for i in range(150)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    got = spatial.within_km(df.toDF("pid", "plat", "plon"), df, 60.0, "plat", "plon", "lat", "lon").select("id", "pid").collect()
    want = {(a[0], b[0]) for a in pts for b in pts if _km(a[1], a[2], b[1], b[2]) <= 60.0}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_hotspot_peak_is_one(spark):
    df = spark.createDataFrame([(12.9, 77.5)] * 5 + [(13.5, 77.9)] * 2 + [(None, 77.0)], "lat double, lon double")
    rows = spatial.hotspots(df, "lat", "lon").orderBy(F.desc("n")).collect()
    assert [(r["n"], r["intensity"]) for r in rows] == [(5, 1.0), (2, 0.4)]


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(500, i) for i in range(501, 600)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {x: root(x) for x in parent}
    got = {r["node"]: r["component"] for r in clusters.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == want


def test_knn_grid_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(90, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id int, e array<double>")
    got = {}
    for r in nb.knn(df, df, "id", "e", 4, chunk=11).collect():
        got.setdefault(r["query"], set()).add(r["neighbour"])
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    assert got == {i: set(np.argsort(-sims[i])[:4].tolist()) for i in range(90)}


def _grid_and_pivots(spark, vecs, k=4, **more):
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vecs)], "id int, e array<double>")
    rows = lambda out: sorted((r["query"], r["neighbour"], round(r["similarity"], 9)) for r in out.collect())
    return rows(nb.knn(df, df, "id", "e", k)), rows(nb.pivot_knn(df, df, "id", "e", k, **more))


@pytest.mark.parametrize("pivots", [1, 7, None])
def test_pivot_search_equals_grid(spark, pivots):
    """Clusters, copies of one vector (a third of all), short, zero and null vectors, small chunks."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 5)) * 4
    vecs = [*(centres[i % 6] + rng.normal(size=5) * 0.3 for i in range(120)), *[centres[0]] * 70, np.zeros(5), np.zeros(5), np.full(5, 1e-9), None]
    grid, found = _grid_and_pivots(spark, vecs, chunk=16, pivots=pivots)
    assert found == grid and len(grid) == 4 * 193


def test_best_of_a_chunk_equals_a_full_sort_in_little_memory():
    """Ties, copies, missing numbers and the record itself; a full chunk needs little beside its similarities."""
    import tracemalloc
    rng = np.random.default_rng(4)
    m = np.round(rng.normal(size=(300, 2)), 1)
    m[7] = np.nan
    df = pd.DataFrame({"id": rng.permutation(300), "e": list(m)})
    got = nb._best_of("id", "e", 6, True, 0.2)(df, df)
    right = df.sort_values("id")
    unit = lambda x: (lambda v: v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9))(np.vstack(list(x)))
    sims = unit(df["e"]) @ unit(right["e"]).T
    want = []
    for i, q in enumerate(df["id"]):
        best = [(-s, c) for s, c in zip(sims[i], right["id"]) if c != q and s >= 0.2]
        want += [(q, c, -s) for s, c in sorted(best)[:6]]
    assert list(got.itertuples(index=False, name=None)) == want
    big = pd.DataFrame({"id": np.arange(2048), "e": list(rng.normal(size=(2048, 4)))})
    tracemalloc.start()
    nb._best_of("id", "e", 5, True)(big, big)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.8 * 2048 * 2048 * 8


def test_pivot_search_with_a_least_similarity(spark):
    rng = np.random.default_rng(9)
    vecs = rng.normal(size=(150, 4))
    grid, found = _grid_and_pivots(spark, vecs, min_sim=0.9)
    assert found == [r for r in grid if r[2] >= 0.9] and 0 < len(found) < len(grid)


def test_pivot_search_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, e array<double>")
    assert nb.pivot_knn(df, df, "id", "e", 3).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, e array<double>")
    assert nb.pivot_knn(one, df, "id", "e", 3).count() == 0 and nb.pivot_knn(one, one, "id", "e", 3).count() == 0


def test_queries_visit_few_cells_of_clustered_vectors(spark):
    """Well-parted clusters: a query leaves its cell only for pivots of its own cluster."""
    rng = np.random.default_rng(10)
    centres = np.eye(8) * 10
    df = spark.createDataFrame([(i, (centres[i % 8] + rng.normal(size=8) * 0.1).tolist()) for i in range(400)], "id int, e array<double>")
    at = nb.pivot_rows(df, "id", "e", 60)
    cells = nb.with_cell(df, "e", at).cache()
    bounds = {r[0]: (r[1], r[2]) for r in cells.groupBy("_cell").agg(F.min("_angle"), F.max("_angle")).collect()}
    visits = nb.cell_visits(cells.withColumn("_floor", F.lit(0.99)), "id", "e", at, bounds)
    own = dict(enumerate(np.argmax(at @ np.eye(8), axis=1)))  # the cluster of a pivot
    assert set(own.values()) == set(range(8)) and all(own[r["_cell"]] == r["id"] % 8 for r in visits.collect())


def test_text_vectors_follow_their_definition(spark):
    """Null, empty, short, repeated and non-Latin texts; a clashing column name passes through."""
    texts = ["The red car", "the RED car and the red van", None, "", "ab", "наш дом", "abc" * 400, "the red car", "𝒳yz𝒳yz"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id int, t string, bucket int")
    dim, n = 16, 3
    counts = []
    for t in texts:
        low = (t or "").lower()
        counts.append(collections.Counter(int(hashlib.md5(low[i:i + n].encode()).hexdigest()[:8], 16) % dim for i in range(len(low) - n + 1)))
    idf = {b: math.log((len(texts) + 1) / (sum(b in c for c in counts) + 1)) for c in counts for b in c}
    rows = lk.text_vectors(df, "t", dim, n).orderBy("id").collect()
    assert [r["bucket"] for r in rows] == list(range(len(texts)))
    for r, c in zip(rows, counts, strict=True):
        raw = np.array([c[b] * idf.get(b, 0.0) for b in range(dim)])
        want = raw / np.linalg.norm(raw) if raw.any() else raw
        assert np.allclose(r["embedding"], want, atol=1e-12)
    assert lk.text_vectors(df.where("id < 0"), "t", dim, n).count() == 0


def _cases(spark, n=220, seed=6):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["x", "y"]), dt.date(2025, 1, 1) + dt.timedelta(days=rng.randrange(700)), 12 + rng.random() * 3, 75 + rng.random() * 3,
             rng.choice(["car", "auto", None, ""]), rng.choice(["cash", "mobile"]), rng.choice(["night", "evening"]), rng.randrange(7),
             [rng.gauss(0, 1) for _ in range(4)]) for i in range(n)]
    schema = ("case_id int, crime_sub_head string, registered date, latitude double, longitude double, vehicle string, target string, tod string, "
              "dow int, embedding array<double>")
    return rows, spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("threshold", [None, 0.65])
def test_pairs_equal_brute_force(spark, threshold):
    rows, df = _cases(spark)
    w = fx.LINK_WEIGHTS
    pairs = lk.candidate_pairs(df, threshold=threshold or 0.0)
    got = {(r["a"], r["b"]): round(r["score"], 9) for r in lk.score_pairs(pairs, df, threshold=threshold).collect()}
    want = {}
    for p, q in itertools.combinations(rows, 2):
        km = _km(p[3], p[4], q[3], q[4])
        if p[1] != q[1] or abs((p[2] - q[2]).days) > 180 or km > 120:
            continue
        same = [float(bool(p[i]) and p[i] == q[i]) if i < 8 else float(p[i] == q[i]) for i in (5, 6, 7, 8)]
        a, b = np.array(p[9]), np.array(q[9])
        cos = float(a @ b / ((np.linalg.norm(a) + 1e-9) * (np.linalg.norm(b) + 1e-9)))
        s = w["cosine"] * cos + w["vehicle"] * same[0] + w["target"] * same[1] + w["tod"] * same[2] + w["dow"] * same[3] + w["geo"] * (1 - min(km, 120) / 120)
        if threshold is None or s >= threshold:
            want[(p[0], q[0])] = round(s, 9)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-7 for k in want)


@pytest.mark.parametrize("threshold", [None, 0.65])
def test_pairs_that_carry_vectors_need_no_join_on_pairs(spark, threshold):
    """Same rows as with fetched vectors, also for repeated keys and null vectors."""
    rows, df = _cases(spark, 120)
    odd = [(*rows[3][:9], [1.0, 0.0, 0.0, 0.5]), rows[4], (500, *rows[5][1:9], None)]  # a key with two vectors, a row twice, no vector
    df = df.unionByName(spark.createDataFrame(odd, df.schema))
    plain, carried = (lk.score_pairs(lk.candidate_pairs(df, threshold=threshold or 0.0, vectors=v), df, threshold=threshold) for v in (False, True))
    listed = lambda x: sorted(map(repr, x.withColumn("score", F.round("score", 9)).withColumn("cosine", F.round("cosine", 9)).collect()))
    assert plain.columns == carried.columns and listed(plain) == listed(carried)
    joins = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    patterns = len(lk.mismatch_patterns(lk.Rules(), lk.Fields().features, threshold or 0.0))
    assert joins(carried) == patterns and joins(plain) > patterns


def test_patterns_are_disjoint_and_whole():
    features = ("vehicle", "target", "tod", "dow")
    assert lk.mismatch_patterns(lk.Rules(), features, 0.0) == [lk.Pattern((), (), fx.LINK_MAX_KM)]
    total = sum(fx.LINK_WEIGHTS.values())
    for threshold in (0.3, 0.45, 0.5, 0.65, 0.72, 0.8, 0.9, 0.99, 1.0, 1.2):
        plan = lk.mismatch_patterns(lk.Rules(), features, threshold)
        for n in range(4):
            for differ in itertools.combinations(features[:3], n):
                fits = [p for p in plan if not set(p.same) & set(differ) and set(p.differ) <= set(differ)]
                reachable = total - sum(fx.LINK_WEIGHTS[f] for f in differ) >= threshold - 1e-9
                assert len(fits) == reachable


@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.65, 0.8])
def test_crowded_cells_give_the_same_pairs_over_a_grid(spark, threshold):
    rows, _ = _cases(spark, 150)
    crowd = [(1000 + i, "x", dt.date(2025, 5, 1) + dt.timedelta(days=i % 40), 13.0, 76.0, "car" if i % 3 else "auto", "cash" if i % 4 else "mobile",
              "night" if i % 5 else "evening", i % 7, [1.0, i / 100, 0.0, 0.2]) for i in range(120)]  # one place
    df = spark.createDataFrame(rows + crowd, _cases(spark, 1)[1].schema)
    got = [sorted(map(tuple, lk.score_pairs(lk.candidate_pairs(df, threshold=threshold, cell_rows=n), df, threshold=threshold).select(
        "a", "b", "days", F.round("score", 9)).collect())) for n in (7, 10_000)]
    assert got[0] == got[1] and len({p[:2] for p in got[0]}) == len(got[0]) > 400
    same = lambda p, q: [bool(p[i]) and p[i] == q[i] for i in (5, 6, 7)]
    w, want = fx.LINK_WEIGHTS, set()
    for p, q in itertools.combinations(rows + crowd, 2):
        km = _km(p[3], p[4], q[3], q[4])
        if p[1] == q[1] and abs((p[2] - q[2]).days) <= 180 and km <= 120:
            a, b = np.array(p[9]), np.array(q[9])
            v, t, o = same(p, q)
            score_ = (w["cosine"] * a @ b / ((np.linalg.norm(a) + 1e-9) * (np.linalg.norm(b) + 1e-9)) + w["vehicle"] * v + w["target"] * t + w["tod"] * o
                      + w["geo"] * (1 - km / 120))
            if score_ >= threshold:
                want.add((p[0], q[0]))
    assert want == {x[:2] for x in got[0]}


def test_planted_series_is_found(spark):
    rows, _ = _cases(spark, 200)
    series = [(1000 + i, "x", dt.date(2026, 3, 1) + dt.timedelta(days=5 * i), 14.0 + i * 0.01, 76.0, "motorcycle", "gold_chain", "evening", i % 7,
               [1.0, 0.1 * i, 0.0, 0.2]) for i in range(12)]
    df = spark.createDataFrame(rows + series, ("case_id int, crime_sub_head string, registered date, latitude double, longitude double, vehicle string, "
                                               "target string, tod string, dow int, embedding array<double>")).withColumn("district", F.lit("D1"))
    pairs = lineage.cut(lk.score_pairs(lk.candidate_pairs(df, threshold=0.65), df, threshold=0.65))
    members = clusters.of_size(clusters.components(pairs, node="case_id"))
    planted = set(range(1000, 1012))
    found = [{r["case_id"] for r in members.where(F.col("component") == c[0]).collect()} for c in members.select("component").distinct().collect()]
    best = max(found, key=lambda m: len(m & planted))
    assert len(best & planted) == 12 and len(best & planted) / len(best) >= 0.8
    conf = lk.confidence(members, pairs)
    named = lk.assign_ids(lk.summarise(members, df).drop("size").join(conf, "component"), pin=F.col("vehicle") == "motorcycle", pin_id="SH-07").collect()
    pinned = [r for r in named if r["series_id"] == "SH-07"]
    assert len(pinned) == 1 and pinned[0]["component"] == 1000 and pinned[0]["confidence"] >= 0.55
    assert len({r["series_id"] for r in named}) == len(named)
    links = lk.evidence_links(lk.member_pairs(members, df), df).where("component = 1000").collect()
    assert len(links) == 12 and all("vehicle:motorcycle" in r["shared_features"] for r in links)


def test_small_blocks_are_left_out_and_large_ones_kept(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 10, "k string")
    assert lk.blocks_of_size(df, "k", 4).count() == 10
    assert lk.blocks_of_size(df, "k", 1).count() == 13


def test_protected_attributes_are_refused(spark):
    with pytest.raises(ValueError):
        score.refuse_denied(["registered", "ReligionID"])
    with pytest.raises(ValueError):
        lk.candidate_pairs(_cases(spark, 5)[1], lk.Fields(features=("caste",)))


def test_score_components(spark):
    rows = spark.createDataFrame([("p", dt.date(2026, 7, 10), "Heinous")] * 4 + [("q", dt.date(2020, 1, 1), "Non-Heinous")], "person_key string, registered date, gravity string")
    everyone = spark.createDataFrame([("p",), ("q",), ("none",)], "person_key string")
    central = spark.createDataFrame([("p", 1.0)], "person_key string, centrality double")
    got = {r["person_key"]: r for r in score.entity_score(rows, "person_key", dt.date(2026, 7, 20), centrality=central, all_entities=everyone).collect()}
    assert got["p"]["score"] >= 0.8 and got["p"]["frequency"] == 1.0
    assert got["none"]["score"] == 0.0 and got["q"]["gravity"] == 0.5


def test_repeat_pattern_fires(spark):
    home = "8:100:200"
    lat, lon = spark.sql("select 1").select(__import__("caseweave.functions.geo", fromlist=["geo"]).hex_centre(F.lit(home)).alias("c")).select("c.lat", "c.lon").first()
    hist = spark.createDataFrame([("p", "burglary", dt.date(2025, 1, i + 1)) for i in range(5)], "person_key string, crime_sub_head string, registered date")
    cases = spark.createDataFrame([(i, "UI", 0, "burglary", dt.date(2026, 7, 1), lat + 0.002 * i, lon) for i in range(4)]
                                  + [(9, "UI", 0, "burglary", dt.date(2026, 7, 1), lat + 1, lon), (10, "UI", 1, "burglary", dt.date(2026, 7, 1), lat, lon)],
                                  "case_id int, case_status string, accused_count int, crime_sub_head string, registered date, latitude double, longitude double")
    end = dt.date(2026, 7, 20)
    cand = detect.repeat_candidates(hist, hist.select("person_key").distinct(), spark.createDataFrame([("p", home)], "person_key string, home_cell string"), end)
    got = detect.repeat_pattern(cand, detect.fresh_unsolved(cases, end, "UI")).collect()
    assert [(r["person_key"], r["near"], r["confidence"]) for r in got] == [("p", 4, 0.9)]


def test_weekly_series_is_dense(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 3),), (dt.date(2024, 1, 4),), (dt.date(2024, 2, 1),)], "d date")
    rows = ts.weekly(df, "d").orderBy("week").collect()
    assert [(str(r["week"]), r["n"]) for r in rows] == [("2024-01-01", 2), ("2024-01-08", 0), ("2024-01-15", 0), ("2024-01-22", 0), ("2024-01-29", 1)]


def test_residuals_follow_the_recursion():
    rng = np.random.default_rng(7)
    w, (ar, ma, sar, sma), s = rng.normal(size=40), (0.4, -0.3, 0.2, 0.5), 5
    e = np.zeros(40)
    at = lambda x, i: x[i] if i >= 0 else 0.0
    for t in range(40):
        e[t] = (w[t] - ar * at(w, t - 1) - sar * at(w, t - s) + ar * sar * at(w, t - s - 1) - ma * at(e, t - 1) - sma * at(e, t - s) - ma * sma * at(e, t - s - 1))
    assert np.allclose(fc.residuals(w, np.array([ar, ma, sar, sma]), s), e)


def test_forecast_beats_its_bound_and_marks_thin_series(spark):
    rng = np.random.default_rng(8)
    start = dt.date(2022, 1, 3)
    rows = [("s", start + dt.timedelta(weeks=i), int(rng.poisson(12 + 6 * np.sin(2 * np.pi * i / 52)))) for i in range(180)]
    rows += [("thin", start + dt.timedelta(weeks=i), 1) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, week date, n long")
    got = {r["k"]: r for r in fc.backtest(df, ["k"]).collect()}
    assert got["thin"]["status"] == "insufficient history" and got["thin"]["backtest_mae"] is None
    assert got["s"]["backtest_mae"] <= 1.25 * got["s"]["baseline_mae"]
    steps = fc.forecast(df, ["k"]).where("k = 's'").orderBy("step").collect()
    assert len(steps) == 8 and all(0 <= r["lo"] <= r["hi"] for r in steps)
    assert steps[0]["week"] == start + dt.timedelta(weeks=180)


ALLOWED = {"case_360"}


@pytest.mark.parametrize("bad", [
    "", "DELETE FROM case_360 WHERE n > 1", "UPDATE case_360 SET n = n + 1", "INSERT INTO case_360 SELECT 1", "TRUNCATE TABLE case_360", "DROP VIEW case_360",
    "CREATE TABLE copied AS SELECT * FROM case_360", "ALTER TABLE case_360 RENAME TO other", "SELECT n FROM case_360; SELECT n FROM case_360", "SELECT * FROM payroll",
    "SELECT * FROM parquet.`/data/x`", "SELECT * FROM case_360 WHERE n IN (SELECT n FROM payroll)", "WITH a AS (SELECT * FROM payroll) SELECT * FROM a", "SET spark.x=1",
    "SHOW TABLES", "SELECT reflect('java.lang.System', 'nanoTime') FROM case_360", "EXPLAIN SELECT * FROM case_360", "SELECT * FROM range(5)", "CACHE TABLE case_360",
    "WITH payroll AS (SELECT * FROM payroll) SELECT * FROM payroll", "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a",
    "SELECT * FROM (WITH t AS (SELECT 1 AS x) SELECT * FROM t) JOIN t", "SELECT system.builtin.reflect('java.lang.System', 'nanoTime') FROM case_360"])
def test_gate_refuses(spark, bad):
    with pytest.raises(sqlgate.GateError):
        sqlgate.check(spark, bad, ALLOWED)
    assert not sqlgate.is_read_only(spark, bad, ALLOWED)


def test_gate_runs_and_caps(spark):
    spark.range(600).withColumnRenamed("id", "n").createOrReplaceTempView("case_360")
    out = sqlgate.run(spark, "```sql\nSELECT n FROM case_360;\n```", ALLOWED)
    assert (out.row_count, out.truncated, out.columns) == (500, True, ["n"])
    out = sqlgate.run(spark, "WITH t AS (SELECT n FROM case_360 LIMIT 10) SELECT count(*) AS c FROM t UNION SELECT 1 FROM t", ALLOWED)
    assert out.row_count == 2 and not out.truncated
    assert sqlgate.query(spark, "SELECT n FROM case_360", ALLOWED).count() == 600  # whole; only run caps, and says so
    out = sqlgate.run(spark, "WITH a AS (SELECT n FROM case_360), b AS (SELECT n FROM a) SELECT max(n) AS m FROM b WHERE n IN (SELECT n FROM a)", ALLOWED)
    assert out.rows == [(599,)]
    out = sqlgate.run(spark, "WITH RECURSIVE r AS (SELECT 1 AS x UNION ALL SELECT x + 1 FROM r WHERE x < 5) SELECT sum(x) AS s FROM r", ALLOWED)
    assert out.rows == [(15,)]


def test_intents(spark):
    msgs = ["Is this the same series as in spring?", "Predict cattle theft in Hassan for the coming weeks", "Give me a hotspot view of arson in Udupi",
            "List the habitual offenders of Hassan", "Count the arson cases of 2024", "Show the associates of this man", "forecast please"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(msgs)], "i int, t string")
    options = {"district": ["Hassan", "Udupi"], "sub_head": ["Cattle Theft", "Theft", "Arson"]}
    got = tagging.intent(df.withColumn("p", F.lit(None).cast("string")), "t", options, {"district": "Udupi"}, person="p").orderBy("i").collect()
    assert [r["intent"] for r in got] == ["linkage", "forecast", "hotspots", "risk_rank", "run_sql", "run_sql", "forecast"]
    assert (got[1]["district"], got[1]["sub_head"]) == ("Hassan", "Cattle Theft")
    assert (got[2]["district"], got[2]["sub_head"]) == ("Udupi", "Arson")
    assert got[3]["district"] == "Hassan" and got[4]["district"] is None
    assert (got[6]["district"], got[6]["sub_head"]) == ("Udupi", None)


def test_most_connected_namesake(spark):
    msgs = spark.createDataFrame([(1, "who is asha menon?"), (2, "nobody")], "id int, t string")
    names = spark.createDataFrame([("P1", "Asha Menon"), ("P2", "Asha Menon"), ("P3", "Menon X")], "p string, name string")
    degree = spark.createDataFrame([("P2", 14), ("P1", 2)], "p string, n int")
    assert [tuple(r) for r in tagging.resolve_name(msgs, "id", "t", names, "p", "name", degree).collect()] == [(1, "P2")]


def test_masking(spark):
    row = govern.mask(spark.createDataFrame([("Ravi K", 37)], "name string, age int"), ["name"], ["age"]).first()
    assert tuple(row) == ("R. K.", "30-39")


def test_same_rows_is_a_bag_comparison(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2), (1, 0.3)], "x int, y double")
    b = spark.createDataFrame([(1, 0.3), (1, 0.3)], "z long, w double")
    assert ev.same_rows(a, b)
    assert not ev.same_rows(a, b.limit(1))
    assert not ev.same_rows(a, b.select("z"))


def test_pair_precision_and_recall(spark):
    pred = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "m int, cluster string")
    truth = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y")], "m int, label string")
    row = ev.cluster_pr(pred, truth, "m").first()
    assert (row["tp"], row["precision"], row["recall"]) == (1.0, 1 / 3, 0.5)


def test_checkpoint_folder_is_read_from_the_session(spark):
    assert lineage.checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert lineage.cut(spark.range(3)).count() == 3


def test_names_of_any_length_are_found(spark):
    texts = [(1, "Ravi Kumar met Bo and X"), (1, "kumar"), (2, ""), (3, None), (4, "x" * 5000 + "ravi kumar"), (5, "bob")]
    names = [("p1", "Ravi Kumar"), ("p1", "Kumar"), ("p2", "Bo"), ("p3", "X"), ("p4", "Kumari"), ("p5", ""), ("p6", None), ("p7", "kumar"), ("p7", "kumar")]
    want = sorted((i, p) for i, t in texts for p, n in set((p, n.lower()) for p, n in names if n) if n in (t or "").lower())
    got = tagging.names_in_text(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame(names, "p string, name string"), "p", "name")
    assert sorted(map(tuple, got.collect())) == want


def test_evidence_ids_are_whole_or_the_smallest(spark):
    df = spark.createDataFrame([(9,), (3,), (None,), (7,)], "case_id int")
    assert sorted(r[0] for r in tagging.evidence_ids(df).collect()) == [3, 7, 9]
    assert [r[0] for r in tagging.evidence_ids(df, cap=2).collect()] == [3, 7]


@pytest.mark.parametrize("km, wide", [(120.0, 2.0), (0.001, 100.0), (20.0, 3.0), (900.0, 2.0)])
def test_wide_cells_hold_every_partner_in_few_copies(spark, km, wide):
    rnd = random.Random(7)
    near = km / 111.0
    points = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(150)] + [(90.0, 0.0), (-90.0, 5.0), (89.99, 170.0), (0.0, 180.0), (0.0, -180.0)]
    points += [(max(-90.0, min(90.0, a + rnd.uniform(-near, near))), o + rnd.uniform(-near, near)) for a, o in points for _ in range(3)]
    df = spark.createDataFrame([(i, a, o) for i, (a, o) in enumerate(points)], "id int, lat double, lon double")
    rows = df.select("id", geo.tile_key("lat", "lon", km, wide).alias("own"), geo.tile_probe_keys("lat", "lon", km, wide).alias("probe")).collect()
    for x in rows:
        assert len(set(x["probe"])) == len(x["probe"])
        for y in rows:
            if _km(*points[x["id"]], *points[y["id"]]) <= km:
                assert y["own"] in x["probe"]
    flat = [len(r["probe"]) for r in rows if abs(points[r["id"]][0]) < 60]
    assert sum(flat) / len(flat) < 1.2 * (1 + 2 / wide) ** 2 + 0.1 and max(flat) <= 6  # nine cells before


def test_shuffle_files_of_finished_steps_are_not_kept(spark):
    from caseweave.session import prepare
    assert prepare(spark).conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_visits_are_handed_on_in_bounded_parts():
    """Vectors that nothing can be ruled out for visit every cell; their copies are not held at once."""
    class Best:
        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("e", T.ArrayType(T.FloatType()))])

        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return run

    rng = np.random.default_rng(1)
    at = rng.normal(size=(300, 8))
    at /= np.linalg.norm(at, axis=1, keepdims=True)
    rows = pd.DataFrame({"id": range(256), "e": list(rng.normal(size=(256, 8))), "_cell": 0, "_floor": -2.0})
    parts = list(nb.cell_visits(Best(), "id", "e", at, dict.fromkeys(range(300), (0.0, np.pi)))(iter([rows])))
    assert sum(map(len, parts)) == 256 * 299 and max(map(len, parts)) <= 8192


def test_numbered_names_are_looked_up_by_runs_that_tell_them_apart(spark):
    low = spark.createDataFrame([(i, f"seen with supplier#{100000 + i * 2713:09d}.") for i in range(300)], "id int, _text string")
    known = spark.createDataFrame([(i, f"supplier#{100000 + i * 2713:09d}") for i in range(300)], "p int, _name string")
    assert tagging._candidates(low, known, "id", "p").count() < 400


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8, 9])
def test_names_around_the_run_lengths_are_found_by_code_points(spark, size):
    name = "𝒳é李bcdefgh"[:size]
    texts = spark.createDataFrame([(1, f"..{name}.."), (2, name[:-1]), (3, name.upper()), (4, None)], "id int, t string")
    got = tagging.names_in_text(texts, "id", "t", spark.createDataFrame([("p", name)], "p string, n string"), "p", "n")
    assert sorted(map(tuple, got.collect())) == [(1, "p"), (3, "p")]


def test_a_text_is_lowered_once_for_all_cues(spark):
    df = spark.createDataFrame([("A KNIFE",), (None,)], "t string").select(tx.cue_label("t", {"x": ["gun", "rifle"], "y": ["knife"]}).alias("l"))
    assert df._jdf.queryExecution().analyzed().toString().count("lower(") == 1
    assert [r["l"] for r in df.collect()] == ["y", None]


def test_grams_of_any_length_are_hashed_once_each(spark):
    text, n, dim = "abracadabra " * 50, 4, 8
    want = collections.Counter(int(hashlib.md5(text[i:i + n].encode()).hexdigest()[:8], 16) % dim for i in range(len(text) - n + 1))
    df = spark.createDataFrame([(text.upper(),)], "t string").select(lk.gram_counts("t", dim, n).alias("g"))
    assert {r["bucket"]: r["count"] for r in df.first()["g"]} == dict(want)
    assert "Arrow" in df._jdf.queryExecution().executedPlan().toString()
