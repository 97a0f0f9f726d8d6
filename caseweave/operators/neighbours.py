"""Exact nearest neighbours by cosine, one record's neighbours, and support from them."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import text as tx, vectors as vec
from ..functions.rounding import python_round
from ..plans.lineage import cut
from .ranking import top_k_per_group

CHUNK = 4096


def similar(df: DataFrame, key: str, vector: str, query_id, k: int = 5, text: str | None = None) -> DataFrame:
    """The k records most similar to one record (id breaks ties); none if it has no vector.

    The one query row is a scalar subquery; the scan keeps k rows per task.
    """
    have = df.where(F.col(vector).isNotNull())
    query = have.where(F.col(key) == F.lit(query_id)).select(vec.unit(vector).alias("q")).limit(1).scalar()
    scored = (have.where(F.col(key) != F.lit(query_id)).withColumn("_q", query).where(F.col("_q").isNotNull())
              .withColumn("similarity", vec.dot("_q", vector) / (vec.norm(vector) + vec.NORM_EPSILON)))
    out = scored.orderBy(F.desc("similarity"), key).limit(k)
    cols = [F.col(key), python_round("similarity", 3).alias("similarity")]
    return out.select(*cols, tx.clip(text).alias("summary")) if text else out.select(*cols)


def knn(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, within: str | None = None,
        exclude_self: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(query, neighbour, similarity): the k most similar corpus records of every query.

    Exact. Queries and corpus are cut into chunks of bounded size (per group if ``within``
    is given), each query chunk meets each corpus chunk in one task as a matrix product,
    and a task returns at most k rows per query. A group of any size thus becomes a grid of
    equal tasks; the k-best lists are merged by a ranking per query.
    """
    groups = [within] if within else []
    q, c = (df.where(F.col(vector).isNotNull()).select(*groups, key, vector) for df in (queries, corpus))

    c = c.toDF(*c.columns)  # own column identities, so a table may be searched against itself

    def chunks(df, name):
        if within:
            return df.groupBy(within).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias(name))
        return max(1, math.ceil(df.count() / chunk))

    slot = lambda n: F.pmod(F.xxhash64(key), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    nq, nc = chunks(q, "_nq"), chunks(c, "_nc")
    if within:
        sizes = nq.join(nc, within)
        q, c = q.join(sizes, within), c.join(sizes, within)
        nq, nc = F.col("_nq"), F.col("_nc")
    else:
        nq, nc = F.lit(nq), F.lit(nc)
    q = q.select(*groups, key, vector, slot(nq).alias("_qb"), all_of(nc).alias("_cb"))
    c = c.select(*groups, key, vector, slot(nc).alias("_cb"), all_of(nq).alias("_qb"))
    keys = [*groups, "_qb", "_cb"]
    best = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(
        _best_of(key, vector, k, exclude_self), _neighbour_schema(queries, key))
    return top_k_per_group(best, ["query"], [F.desc("similarity"), "neighbour"], k)


#: Vectors in a cell on average; smaller cells prune more and cost more visits.
CELL = 256
#: Most pivots, and so the rows that the driver and every task hold: 8,192 vectors. Beyond that cells grow and are cut into chunks.
MAX_PIVOTS = 8192
#: Vectors shorter than this lose their direction to the epsilon of ``vec.unit``; they form a cell that every query visits.
MIN_LENGTH = 1e-3
#: Vectors that a task compares with all pivots at a time, and rows it hands on at a time: its memory does not grow with either.
SLICE, HANDED = 256, 8192
#: Covers that epsilon and rounding, so that no neighbour is lost at a bound.
SIM_SLACK = 1e-5


def _matrix(column) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in column])


def _directions(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which rows were too short to have a direction."""
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.maximum(length, MIN_LENGTH), length[:, 0] < MIN_LENGTH


def pivot_rows(corpus: DataFrame, key: str, vector: str, pivots: int | None = None) -> np.ndarray:
    """Directions of the pivots: the corpus rows with the smallest hashes of their keys.

    One in ``CELL`` rows, at most ``MAX_PIVOTS``. The choice changes the work, never the result.
    """
    usable = corpus.where(vec.norm(vector) >= MIN_LENGTH)
    n = min(MAX_PIVOTS, pivots or math.ceil(usable.count() / CELL))
    rows = usable.select(key, vector).orderBy(F.xxhash64(key), key).limit(n).collect()  # at most MAX_PIVOTS rows
    return _directions(_matrix([r[vector] for r in rows]))[0] if rows else np.zeros((0, 0))


def with_cell(df: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    """``df`` with ``_cell``, the nearest pivot, and ``_angle`` to it; short vectors share the cell after the last pivot."""
    @F.pandas_udf("struct<cell:int,angle:double>")
    def nearest(column: pd.Series) -> pd.DataFrame:
        unit, short = _directions(_matrix(column))
        cell, best = np.zeros(len(unit), np.int32), np.zeros(len(unit))
        for at in range(0, len(unit) if len(pivots) else 0, SLICE):
            cos = unit[at:at + SLICE] @ pivots.T
            cell[at:at + SLICE], best[at:at + SLICE] = np.argmax(cos, axis=1), cos.max(axis=1)
        return pd.DataFrame({"cell": np.where(short, len(pivots), cell).astype(np.int32), "angle": np.where(short, 0.0, np.arccos(np.clip(best, -1, 1)))})

    return df.withColumn("_at", nearest(vector)).select(*df.columns, F.col("_at.cell").alias("_cell"), F.col("_at.angle").alias("_angle"))


def _highest_similarity(unit: np.ndarray, home: np.ndarray, pivots: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """query x cell: no vector of the cell is more similar to the query than this.

    Angles are a metric on the sphere, so a cell that lies ``low`` to ``high`` from its pivot is at least so far away;
    and the plane halfway between two pivots parts their cells.
    """
    cos = np.clip(unit @ pivots.T, -1, 1)
    angle = np.arccos(cos)
    away = np.maximum(angle - high, low - angle)
    own = np.take_along_axis(cos, home[:, None], axis=1)
    # |p - r| from their product, a row at a time of the home pivots
    apart = np.sqrt(np.maximum(2 - 2 * (pivots[home] @ pivots.T), 1e-12))
    plane = np.arcsin(np.clip((own - cos) / apart, -1, 1))
    plane[apart < 1e-5] = 0.0  # pivots in one place part nothing
    return np.cos(np.clip(np.maximum(away, plane), 0, np.pi))


def cell_visits(best: DataFrame, key: str, vector: str, pivots: np.ndarray, bounds: dict[int, tuple[float, float]]) -> DataFrame:
    """(key, vector, _cell) for the cells besides its own that may hold a better neighbour of a query.

    ``best`` has a query's ``_cell`` and ``_floor``, the similarity that its k-th neighbour so far reaches.
    ``bounds``: the angles to its pivot between which a cell of the corpus lies, at most ``MAX_PIVOTS`` + 1 entries.
    """
    cells = np.array(sorted(bounds), dtype=np.int64)
    real = cells[cells < len(pivots)]
    low, high = (np.array([bounds[c][i] for c in real]) for i in (0, 1))
    schema = T.StructType([best.schema[key], best.schema[vector], T.StructField("_cell", T.IntegerType())])

    def visits(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            home, floor = pdf["_cell"].to_numpy(), pdf["_floor"].to_numpy()
            for at in range(0, len(pdf), SLICE):  # SLICE x pivots numbers at a time
                part = slice(at, at + SLICE)
                unit, short = _directions(_matrix(pdf[vector].iloc[part]))
                go = np.ones((len(unit), len(cells)), dtype=bool)  # the cell of short vectors is always met
                if len(real):
                    # a cell's members lie nearer to its pivot than to any other, also those without members
                    cos = _highest_similarity(unit, np.where(short, 0, np.minimum(home[part], len(pivots) - 1)), pivots,
                                              *_spread(real, low, high, len(pivots)))[:, real]
                    go[:, :len(real)] = (cos >= floor[part][:, None] - SIM_SLACK) | short[:, None]
                go &= cells[None, :] != home[part][:, None]
                q, c = np.nonzero(go)
                keys, vectors = pdf[key].iloc[part].to_numpy(), pdf[vector].iloc[part].to_numpy()
                for i in range(0, len(q), HANDED):  # a query may visit every cell, each time with its vector
                    rows = q[i:i + HANDED]
                    yield pd.DataFrame({key: keys[rows], vector: vectors[rows], "_cell": cells[c[i:i + HANDED]].astype(np.int32)})

    return best.select(key, vector, "_cell", "_floor").mapInPandas(visits, schema)


def _spread(real: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all n pivots, open ones where a cell has no members."""
    out = np.zeros(n), np.full(n, np.pi)
    out[0][real], out[1][real] = low, high
    return out


def pivot_knn(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, min_sim: float | None = None,
              exclude_self: bool = True, chunk: int = CHUNK, pivots: int | None = None) -> DataFrame:
    """(query, neighbour, similarity): as ``knn``, but a query meets only the cells that can hold a neighbour.

    Exact. Every vector belongs to the cell of its nearest pivot. A query first meets its own cell; the k-th similarity
    found there (or ``min_sim``, which drops less similar neighbours) says which other cells it must visit. Cells of any
    size are cut into a grid of chunks. Null vectors have no neighbours; short ones meet all cells.
    """
    q, c = (df.where(F.col(vector).isNotNull()).select(key, vector) for df in (queries, corpus))
    at = pivot_rows(c, key, vector, pivots)
    q, c = cut(with_cell(q, vector, at), "queries"), cut(with_cell(c, vector, at), "cells")
    bounds = {r[0]: (r[1], r[2]) for r in c.groupBy("_cell").agg(F.min("_angle"), F.max("_angle")).collect()}  # a row per pivot
    floor = -2.0 if min_sim is None else min_sim

    first = cut(_meet(q, c, key, vector, k, exclude_self, chunk, floor), "own-cell")
    kth = first.groupBy("query").agg(F.count(F.lit(1)).alias("_n"), F.min("similarity").alias("_kth"))
    best = q.join(kth, q[key] == kth["query"], "left").withColumn(
        "_floor", F.greatest(F.when(F.col("_n") >= k, F.col("_kth")), F.lit(floor)))
    visits = cut(cell_visits(best, key, vector, at, bounds), "visits")
    more = _meet(visits, c, key, vector, k, exclude_self, chunk, floor)
    return top_k_per_group(first.unionByName(more), ["query"], [F.desc("similarity"), "neighbour"], k)


def _meet(q: DataFrame, c: DataFrame, key: str, vector: str, k: int, exclude_self: bool, chunk: int, floor: float) -> DataFrame:
    """The k best of every query among the corpus rows of the cells it is listed for."""
    sizes = lambda df, n: df.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias(n))
    grid = cut(sizes(q, "_nq").join(sizes(c, "_nc"), "_cell"), "grid")  # a row per cell
    slot = lambda n: F.pmod(F.xxhash64(key), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(grid, "_cell").select("_cell", key, vector, slot(F.col("_nq")).alias("_qb"), all_of("_nc").alias("_cb"))
    c = c.join(grid, "_cell").select("_cell", key, vector, slot(F.col("_nc")).alias("_cb"), all_of("_nq").alias("_qb"))
    keys = ["_cell", "_qb", "_cb"]
    best = q.groupBy(*keys).cogroup(c.toDF(*c.columns).groupBy(*keys)).applyInPandas(
        _best_of(key, vector, k, exclude_self, floor), _neighbour_schema(q, key))
    return top_k_per_group(best, ["query"], [F.desc("similarity"), "neighbour"], k)


def _neighbour_schema(df: DataFrame, key: str) -> T.StructType:
    id_type = df.schema[key].dataType
    return T.StructType([T.StructField("query", id_type), T.StructField("neighbour", id_type),
                         T.StructField("similarity", T.DoubleType())])


#: Rows of a chunk's similarities that are ranked at a time.
ROWS = 128


def _best_in_rows(sims: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the k largest values of each row, of equal ones those in the first columns.

    Only values that reach a row's k-th largest are sorted.
    """
    n = min(k, sims.shape[1])
    kth = np.partition(sims, sims.shape[1] - n, axis=1)[:, sims.shape[1] - n]
    row, col = np.nonzero((sims >= np.maximum(kth, floor)[:, None]) & (sims > -np.inf))
    vals = sims[row, col]
    order = np.lexsort((col, -vals, row))
    row, col, vals = row[order], col[order], vals[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[keep], col[keep], vals[keep]


def _best_of(key: str, vector: str, k: int, exclude_self: bool, floor: float = -np.inf):
    """The k best of a chunk of queries in a chunk of the corpus, one matrix product."""
    def unit_rows(column):
        m = _matrix(column)
        return m / (np.linalg.norm(m, axis=1, keepdims=True) + vec.NORM_EPSILON)

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query": [], "neighbour": [], "similarity": []})
        right = right.sort_values(key, kind="stable")
        qids, cids = left[key].to_numpy(), right[key].to_numpy()
        sims = unit_rows(left[vector]) @ unit_rows(right[vector]).T
        if exclude_self:
            sims[qids[:, None] == cids[None, :]] = -np.inf
        sims[np.isnan(sims)] = -np.inf
        found = [_best_in_rows(sims[at:at + ROWS], k, floor) for at in range(0, len(sims), ROWS)]
        q = np.concatenate([r + i * ROWS for i, (r, _, _) in enumerate(found)])
        c, vals = (np.concatenate([f[i] for f in found]) for i in (1, 2))
        return pd.DataFrame({"query": qids[q], "neighbour": cids[c], "similarity": vals})

    return cell


def support(members: DataFrame, corpus: DataFrame, entities: DataFrame, key: str = "case_id", vector: str = "embedding",
            entity: str = "person_key", k: int = 12, min_sim: float = 0.75) -> DataFrame:
    """Summed similarity per entity over the entities of the members' near neighbours."""
    near = pivot_knn(members, corpus, key, vector, k, min_sim=min_sim - 0.001).withColumn("similarity", python_round("similarity", 3))
    near = near.where(F.col("similarity") >= min_sim).select(F.col("neighbour").alias(key), "similarity")
    # a neighbour reached from many members is summed before it meets its entities
    per_case = near.groupBy(key).agg(F.sum("similarity").alias("_s"))
    return per_case.join(entities.select(key, entity), key).groupBy(entity).agg(F.sum("_s").alias("support"))
