"""Analyst views as functions from DataFrames to DataFrames."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.temporal import month_start


@dataclass(frozen=True)
class Lookup:
    """A dimension joined with a left outer join: names[out] = column of the dimension."""
    table: DataFrame
    fact_key: str
    key: str
    names: Mapping[str, str]


@dataclass(frozen=True)
class Rollup:
    """A child table reduced to one row per fact: values[out] = aggregate column."""
    table: DataFrame
    key: str
    values: Mapping[str, Column]
    zero: Sequence[str] = field(default_factory=tuple)


def case_360(cases: DataFrame, case_id: str, lookups: Sequence[Lookup], rollups: Sequence[Rollup],
             columns: Sequence[str] | None = None) -> DataFrame:
    """Fact with its looked-up names and per-case counts.

    Each child table is aggregated once on its case key and then joined, so there is one
    shuffle per child. If ``columns`` is given, joins that supply none of them are left out.
    """
    wanted_columns = None if columns is None else set(columns)
    kept = []
    for lk in reversed(lookups):
        if wanted_columns is None or wanted_columns & set(lk.names):
            kept.insert(0, lk)
            if wanted_columns is not None:
                wanted_columns.add(lk.fact_key)  # may come from an earlier lookup

    out = cases
    for lk in kept:
        dim = lk.table.select(F.col(lk.key).alias("_key"), *[F.col(c).alias(n) for n, c in lk.names.items()])
        out = out.join(dim, out[lk.fact_key] == dim["_key"], "left").drop("_key")
    for ru in rollups:
        wanted = {n: v for n, v in ru.values.items() if columns is None or n in columns}
        if not wanted:
            continue
        per_case = ru.table.groupBy(F.col(ru.key).alias("_case")).agg(*[v.alias(n) for n, v in wanted.items()])
        out = out.join(per_case, out[case_id] == per_case["_case"], "left").drop("_case")
        out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in wanted if n in ru.zero}) \
            if any(n in ru.zero for n in wanted) else out
    return out if columns is None else out.select(*columns)


def entity_history(accused: DataFrame, registry: DataFrame, cases: DataFrame, mapping: DataFrame | None = None,
                   accused_id: str = "accused_id", person: str = "person_key", case_id: str = "case_id") -> DataFrame:
    """One row per accused record with the person behind it and the case's names.

    ``mapping`` (accused_id, person) is left out where the record already names the person.
    """
    records = accused if mapping is None else accused.join(mapping, accused_id)
    return records.join(registry, person).join(cases, case_id)


def monthly_counts(df: DataFrame, dims: Sequence[str], ts: str, name: str = "case_count") -> DataFrame:
    return df.groupBy(*dims, month_start(ts).alias("month")).agg(F.count(F.lit(1)).alias(name))


def co_occurrence(rows: DataFrame, case: str, entity: str, order: str,
                  a: str = "person_a", b: str = "person_b", directed: bool = True) -> DataFrame:
    """Distinct (a, b, case) with some record of a before some record of b in ``order``.

    If not ``directed``, a pair of two entities comes once per case, as a < b, whichever is first.

    That holds exactly if the first record of a comes before the last record of b. So the
    records are first reduced to one row per (case, entity); the self-join then meets every
    entity pair of a case once, however often each entity is recorded, and needs no
    DISTINCT. The pair list is the result; nothing beyond it is produced.
    """
    spans = rows.groupBy(F.col(case), F.col(entity)).agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    left = spans.select(F.col(case), F.col(entity).alias(a), F.col("_first").alias("_first_a"), F.col("_last").alias("_last_a"))
    right = spans.select(F.col(case), F.col(entity).alias(b), F.col("_first").alias("_first_b"), F.col("_last").alias("_last_b"))
    found = F.col("_first_a") < F.col("_last_b")
    if not directed:
        found = (F.col(a) < F.col(b)) & (found | (F.col("_first_b") < F.col("_last_a")))
    return left.join(right, case).where(found).select(a, b, case)
