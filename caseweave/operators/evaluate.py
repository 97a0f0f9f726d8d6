"""Result-set equality, accuracy reports, cluster quality, key and integrity reports."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys as K
from .ranking import serial_within


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Float columns rounded, all columns named by position, integers widened."""
    cols = []
    for i, f in enumerate(df.schema.fields):
        c, t = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if t in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        elif t in ("tinyint", "smallint", "int"):
            c = c.cast("bigint")
        cols.append(c.alias(f"c{i}"))
    return df.select(*cols)


def difference(a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """Rows whose multiplicities differ, with both counts. One pass: union, count, compare."""
    left, right = rounded(a, digits), rounded(b, digits)
    both = left.withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(
        right.withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    return (both.groupBy(*left.columns).agg(F.sum("_a").alias("in_a"), F.sum("_b").alias("in_b"))
            .where(F.col("in_a") != F.col("in_b")))


def same_rows(a: DataFrame, b: DataFrame, digits: int = 6) -> bool:
    """Order-insensitive bag equality with floats compared at ``digits`` places."""
    if len(a.columns) != len(b.columns):
        return False
    return difference(a, b, digits).isEmpty()


def accuracy(results: DataFrame, by: str, ok: str = "ok") -> DataFrame:
    """passed / total / accuracy per group, and overall in the row whose group is NULL."""
    return results.rollup(by).agg(
        F.count_if(F.col(ok)).alias("passed"), F.count(F.lit(1)).alias("total"),
        F.avg(F.col(ok).cast("double")).alias("accuracy"))


def failures(results: DataFrame, ok: str = "ok") -> DataFrame:
    return results.where(~F.coalesce(F.col(ok), F.lit(False)))


def _overlap(pred: DataFrame, truth: DataFrame, member: str, cluster: str, label: str) -> DataFrame:
    """Contingency table n(cluster, label): one join on the member, one partial aggregation."""
    return (pred.select(member, cluster).join(truth.select(member, label), member)
            .groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n")))


def cluster_pr(pred: DataFrame, truth: DataFrame, member: str, cluster: str = "cluster", label: str = "label",
               level: str = "pair") -> DataFrame:
    """Precision and recall of a clustering.

    pair: over unordered member pairs, from the contingency counts (no pair is formed).
    member: per truth group, against the cluster that shares most members with it.
    """
    over = _overlap(pred, truth, member, cluster, label)
    if level == "pair":
        pairs = lambda c: F.coalesce(F.sum(F.expr(f"{c} * ({c} - 1) / 2")), F.lit(0.0)).cast("double")
        size = lambda df, g: df.groupBy(g).agg(F.count(F.lit(1)).alias("n"))
        tp = over.agg(pairs("n").alias("tp"))
        pp = size(pred, cluster).agg(pairs("n").alias("predicted"))
        tt = size(truth, label).agg(pairs("n").alias("actual"))
        one = tp.withColumn("_k", F.lit(1)).join(pp.withColumn("_k", F.lit(1)), "_k").join(
            tt.withColumn("_k", F.lit(1)), "_k")  # three one-row frames
        return one.select("tp", "predicted", "actual",
                          F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).alias("precision"),
                          F.when(F.col("actual") > 0, F.col("tp") / F.col("actual")).alias("recall"))
    sizes_p = pred.groupBy(cluster).agg(F.count(F.lit(1)).alias("_size_p"))
    sizes_t = truth.groupBy(label).agg(F.count(F.lit(1)).alias("_size_t"))
    best = over.groupBy(label).agg(F.max_by(F.struct(F.col(cluster).alias("c"), F.col("n").alias("n")),
                                            F.struct(F.col("n"), -F.col(cluster))).alias("_best"))
    joined = sizes_t.join(best, label, "left").withColumn(cluster, F.col("_best.c"))
    return joined.join(sizes_p, cluster, "left").select(
        label, F.col(cluster).alias("best_cluster"), F.coalesce(F.col("_best.n"), F.lit(0)).alias("shared"),
        F.coalesce(F.col("_best.n") / F.col("_size_p"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.col("_best.n") / F.col("_size_t"), F.lit(0.0)).alias("recall"))


def overlapping_clusters(a: DataFrame, b: DataFrame, member: str, ca: str, cb: str) -> DataFrame:
    """Cluster pairs that share members, with the number shared; absent pairs are disjoint."""
    return (a.select(member, ca).join(b.select(member, cb), member).groupBy(ca, cb)
            .agg(F.count(F.lit(1)).alias("shared")))


def rule_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations) for row rules; a row violates a rule whose column is not true.
    All rules are counted in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def key_rules(key: str, number: str, category: str) -> dict[str, Column]:
    return {
        "key_format": K.valid_case_key(key),
        "number_is_key_tail": K.number_matches_key(number, key),
        "category_matches_key": K.parse_case_key(key)["category"] == F.col(category),
    }


def serial_gaps(df: DataFrame, group: Sequence[str], serial: str, order: str,
                bucket: Column | None = None) -> DataFrame:
    """Groups whose serials are not 1..n in creation order, with their row counts.

    The expected serial is recomputed in creation order and compared row by row.
    """
    expected = serial_within(df, group, [order], "_expected", bucket)
    return (expected.groupBy(*group).agg(F.count(F.lit(1)).alias("n"),
                                         F.count_if(F.col(serial) != F.col("_expected")).alias("wrong"))
            .where(F.col("wrong") > 0))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(F.col(parent_key).alias("_pk")), F.col(child_key) == F.col("_pk"), "left_anti")
