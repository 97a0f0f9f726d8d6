"""Whole-number k-means whose nearest centroids are found by the threshold algorithm.

Every dimension holds the centroids sorted by their component. A vector looks up its own
component in each list and walks outward from there, in every round one step to the nearer
side of every dimension. A centroid met for the first time gets its exact distance. Any
centroid not met yet is, in every dimension, at least as far as the nearer of the two
frontiers, so the sum of the squared frontier distances bounds it from below: the search
ends once that sum strictly exceeds the best exact distance (an equal one may still hide an
equally near centroid of a smaller number) or no centroid is left.

Vectors are spread over tasks; a round of the clustering shuffles one sum per task, cluster
and dimension. Only the centroids, ``k`` rows, travel through the driver.

Defined cases: vectors that are null, of another length or with a null or non-finite
component are not kept; a null id is kept as a row but never picks a starting centroid;
rows of equal ids or vectors stay rows, and starting centroids of equal ids go by their
components; fewer kept vectors than ``k`` give as many centroids as there are; an empty table gives an empty result; components
beyond 2**27 in size raise an error, because a squared distance would not fit a long.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.lineage import cut

LIMIT = 1 << 27
FAR = np.int64(1) << 31  # beyond the reach of any gap between two components; squares are never taken of it
BLOCK = 2048


class SortedCentroids:
    """Per dimension the centroids in the order of their components."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, np.int64)
        self.order = np.argsort(self.centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(self.centroids, self.order, axis=0)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, squared distance, how many centroids were measured) per row of ``v``; ties go to the smaller number."""
        n, dims = v.shape
        k = len(self.centroids)
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        met = np.zeros((n, k), bool)
        high = np.empty((n, dims), np.int64)
        for j in range(dims):
            high[:, j] = np.searchsorted(self.values[:, j], v[:, j])
        low, column = high - 1, np.arange(dims)[None, :]
        active = np.arange(n)
        while len(active):
            own, a, b = v[active], low[active], high[active]
            below = np.where(a >= 0, own - self.values[np.maximum(a, 0), column], FAR)
            above = np.where(b < k, self.values[np.minimum(b, k - 1), column] - own, FAR)
            frontier = np.minimum(below, above)
            left = (frontier < FAR).all(1) & ~met[active].all(1)  # a list walked to both ends has shown every centroid
            left &= (np.where(left[:, None], frontier, 0) ** 2).sum(1) <= best[active]
            active, a, b, down = active[left], a[left], b[left], (below <= above)[left]
            if not len(active):
                break
            shown = np.zeros((len(active), k), bool)
            shown[np.arange(len(active))[:, None], self.order[np.where(down, a, b), column]] = True
            row, c = np.nonzero(shown & ~met[active])
            met[active] |= shown
            low[active], high[active] = a - down, b + ~down
            distance = ((v[active[row]] - self.centroids[c]) ** 2).sum(1)
            first = np.lexsort((c, distance, row))  # the nearest new centroid of every row comes first
            row, c, distance = row[first], c[first], distance[first]
            head = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
            at, c, distance = active[row[head]], c[head], distance[head]
            better = (distance < best[at]) | ((distance == best[at]) & (c < who[at]))
            best[at[better]], who[at[better]] = distance[better], c[better]
        return who, best, met.sum(1)


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v) of the kept vectors; each component x becomes floor(scale * x), x as double."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = df.where(x.isNotNull() & (F.size(x) == dims) & finite)
    return kept.select(F.col(vec_id).alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v"))


def starting_centroids(vectors: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest sha256 of prefix + id, in that order."""
    named = vectors.where("vec_id IS NOT NULL").withColumn("_h", F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256))
    return np.array([r["v"] for r in named.orderBy("_h", "v").limit(k).collect()], np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    if len(v) and max(int(v.max()), -int(v.min())) > LIMIT:
        raise ValueError(f"a component lies beyond {LIMIT}")
    return v


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = SortedCentroids(centroids)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                who, distance, _ = table.nearest(_matrix(part.column(1), centroids.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(who.astype(np.int32)), pa.array(distance)],
                                                 names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid moved to floor(sum / count) of its vectors; one without vectors stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = SortedCentroids(centroids), np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                v = _matrix(batch.column(1).slice(at, BLOCK), dims)
                np.add.at(sums, table.nearest(v)[0], np.concatenate((v, np.ones((len(v), 1), np.int64)), axis=1))
        c, j = np.nonzero(sums[:, -1:] * np.ones((1, dims + 1), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums[c, j])],
                                         names=["cluster", "dim", "part"])

    sums = vectors.mapInArrow(run, "cluster int, dim int, part long").groupBy("cluster", "dim").agg(F.sum("part").alias("s"))
    found = {(r["cluster"], r["dim"]): r["s"] for r in sums.collect()}  # at most k * (dims + 1) sums
    out = centroids.copy()
    for c in range(k):
        if (c, dims) in found:
            out[c] = [found[c, j] // found[c, dims] for j in range(dims)]
    return out


def cluster(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) after ``rounds`` moves, the final centroids)."""
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids)
    return cut(assign(vectors, centroids), "clusters"), centroids


def with_inertia(members: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the inertia of the cluster and of all, and the sha256 of the centroid's components."""
    sha = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    names = members.sparkSession.createDataFrame(sha, "cluster int, centroid_sha256 string")
    own = members.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = own.agg(F.sum("cluster_inertia").alias("inertia"))
    per = own.join(names, "cluster").withColumn("inertia", total.scalar())
    return members.join(F.broadcast(per), "cluster").select(*members.columns, "cluster_inertia", "inertia", "centroid_sha256")


def cluster_table(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64,
                  scale: int = 256, prefix: str = "2:") -> DataFrame:
    """Whole-number vectors of ``df``, clustered, with inertia and centroid digests."""
    vectors = cut(whole_vectors(df, vec_id, vector, dims, scale), "vectors")
    start = starting_centroids(vectors, k, prefix)
    if not len(start):
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return df.sparkSession.createDataFrame(
            [], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    return with_inertia(*cluster(vectors, start, rounds))
