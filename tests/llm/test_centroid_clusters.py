"""Operator 13 against a plain clustering."""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from caseweave.llm import centroid_clusters as cc


@pytest.mark.parametrize("spread", [2, 9, 400])
def test_nearest_equals_brute_force_also_with_ties(spread):
    rng = np.random.default_rng(spread)
    for k, dims in ((1, 3), (7, 1), (40, 6), (25, 64)):
        c = rng.integers(-spread, spread, (k, dims))
        c[k // 2] = c[0]  # equal centroids: the smaller number wins
        v = np.concatenate((rng.integers(-spread, spread, (300, dims)), c, np.repeat(c[:1], 5, 0)))
        who, distance, met = cc.SortedCentroids(c).nearest(v)
        d = ((v[:, None, :] - c[None]) ** 2).sum(2)
        assert (distance == d.min(1)).all() and (who == d.argmin(1)).all() and (met >= 1).all()


def test_search_ends_before_all_centroids_are_met():
    c = np.array([[i * 100, i * 100, i * 100] for i in range(50)])
    _, _, met = cc.SortedCentroids(c).nearest(c + 7)
    assert met.max() <= 3


def plain(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    c = [v for _, v in sorted((p for p in kept if p[0] is not None), key=lambda p: (sha(f"2:{p[0]}"), p[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        c = [[sum(col) // own.count(j) for col in zip(*[v for (_, v), o in zip(kept, own) if o == j])] if j in own else c[j]
             for j in range(len(c))]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    return [(i, j, d, sum(x[2] for x in last if x[1] == j), sum(x[2] for x in last), sha(",".join(map(str, c[j])))) for i, j, d in last]


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("k", [4, 1000])
def test_clusters_equal_a_plain_run_with_odd_rows_and_clashing_columns(spark, k):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    rows += [rows[5], rows[5], (None, rows[7][1]), (300, None), (301, [0.5] * 5), (302, [float("nan")] * 6), (303, [None] * 6),
             (304, [math.inf] + [0.0] * 5), (305, []), *[(400 + i, [0.25] * 6) for i in range(90)]]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string")
    got = cc.cluster_table(df, k=k, rounds=3, dims=6).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = plain(rows, k, 3, 6)
    assert sorted([tuple(r[c] for c in COLUMNS) for r in got], key=key) == sorted(want, key=key)


def test_empty_table_and_components_out_of_range(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    out = cc.cluster_table(empty)
    assert out.columns == COLUMNS and out.count() == 0
    far = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        cc.cluster_table(far, dims=2).count()
