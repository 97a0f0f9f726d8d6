"""Connected components by alternating stars, and thinning of edges inside tasks."""
from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..plans.lineage import Rounds

#: Edges that a task reads before it thins them again.
THIN_EDGES = 1 << 20


def _forest_rows(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Rows of the spanning forest of edges between nodes 0 to n - 1 that keeps the earliest rows (Boruvka)."""
    part, live, kept = np.arange(n), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        x, y = part[a[live]], part[b[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            return np.sort(np.concatenate(kept))
        first = np.full((2, n), len(a))
        first[0, x[::-1]], first[1, y[::-1]] = live[::-1], live[::-1]  # the last to be written is a part's earliest row
        first = first.min(0)
        own = np.flatnonzero(first < len(a))
        pick = first[own]
        up = np.arange(n)
        up[own] = part[a[pick]] + part[b[pick]] - own  # the other end
        root = (up[up[own]] == own) & (own < up[own])
        up[own[root]] = own[root]
        while True:
            top = up[up]
            if np.array_equal(top, up):
                break
            up = top
        part = up[part]
        kept.append(np.unique(pick))


def _thin(rows: pa.Table, src: str, dst: str, order: str | None) -> pa.Table:
    a, b = (rows.column(c).to_numpy() for c in (src, dst))
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.minimum(*np.split(code, 2)), np.maximum(*np.split(code, 2))
    at = np.lexsort((b, a, rows.column(order).to_numpy())) if order else np.arange(len(a))
    return rows.take(pa.array(at[_forest_rows(a[at], b[at], len(ids))]))


def thinned(edges: DataFrame, src: str = "a", dst: str = "b", order: str | None = None, every: int = THIN_EDGES) -> DataFrame:
    """``edges`` without those that close a circle with other edges of the same task.

    Of a circle the edge that comes last by (``order``, ends) goes, so what stays holds the
    whole minimum spanning forest, and with it every node's nearest edge. A task keeps at most
    an edge less than it has nodes and nothing is shuffled, so edges grow with the nodes
    however many pairs there are. A task that holds more than ``every`` edges of a forest
    hands them on and starts again, which bounds its memory. Rows without ends or order stay.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            whole = np.ones(batch.num_rows, bool)
            for c in (src, dst, *([order] if order else [])):
                whole &= batch.column(c).is_valid().to_numpy(zero_copy_only=False)
            if not whole.all():
                yield batch.filter(pa.array(~whole))
                batch = batch.filter(pa.array(whole))
            held.append(batch)
            size += batch.num_rows
            if size >= 2 * every:
                rows = _thin(pa.Table.from_batches(held), src, dst, order)
                held, size = rows.to_batches(), rows.num_rows
                if size > every:
                    yield from held
                    held, size = [], 0
        if size:
            yield from _thin(pa.Table.from_batches(held), src, dst, order).to_batches()

    return edges.mapInArrow(run, edges.schema)


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        e.select(F.col("v").alias("x"), F.col("u").alias("y")))
    low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.where(F.col("y") > F.col("x")).join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    tied = e.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, src: str = "a", dst: str = "b", nodes: DataFrame | None = None,
               node: str = "node", component: str = "component") -> DataFrame:
    """(node, component): the component is named by its smallest node.

    Rounds grow with the logarithm of the graph. Minima are taken with partial aggregation
    and joined back, so a hub's edges are spread over tasks (adaptive skew join) and never
    gathered. ``nodes`` adds isolated nodes.
    """
    e = edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    rounds = Rounds(edges.sparkSession, "components")
    e = rounds.cut(e)
    state = None
    while True:
        e = rounds.cut(_small_star(_large_star(e)))
        seen = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state:
            break
        state = seen
    out = e.select(F.col("u").alias(node), F.col("v").alias(component)).unionByName(
        e.select(F.col("v").alias(node), F.col("v").alias(component)).distinct())
    if nodes is None:
        return out
    return nodes.select(node).distinct().join(out, node, "left").select(
        node, F.coalesce(component, node).alias(component))


def of_size(members: DataFrame, component: str = "component", min_size: int = 4) -> DataFrame:
    """Members of components with at least ``min_size`` nodes."""
    big = members.groupBy(component).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size)
    return members.join(big.select(component), component, "left_semi")


# Tasks receive this module by value, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
