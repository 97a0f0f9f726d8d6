"""Explainable entity scores from recency, frequency, gravity and centrality."""
from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_values import (
    DENIED_FEATURES, SCORE_EXPLANATION, SCORE_NO_HISTORY, SCORE_SATURATION, SCORE_TAU_DAYS, SCORE_WEIGHTS)
from ..functions.rounding import python_round


def refuse_denied(columns: Iterable[str], denied: Iterable[str] = DENIED_FEATURES) -> None:
    """Raise if a feature column is a protected attribute."""
    hit = sorted({c for c in columns for d in denied if d in c.lower()})
    if hit:
        raise ValueError(f"protected attributes must not be used: {hit}")


def entity_score(history: DataFrame, entity: str, as_of: dt.date, ts: str = "registered", serious: Column | None = None,
                 centrality: DataFrame | None = None, all_entities: DataFrame | None = None,
                 weights: Mapping[str, float] = SCORE_WEIGHTS, tau: float = SCORE_TAU_DAYS,
                 saturation: float = SCORE_SATURATION, features: Iterable[str] = ("registered", "gravity")) -> DataFrame:
    """Score of every entity in one aggregation.

    ``centrality`` is (entity, centrality); ``all_entities`` adds entities without rows,
    which score 0. Components are rounded to 3 places before they are weighted.
    """
    refuse_denied(features)
    grave = F.count_if(serious if serious is not None else F.col("gravity") == "Heinous")
    agg = history.groupBy(entity).agg(F.count(F.lit(1)).alias("n_cases"), F.max(ts).alias("last_seen"), grave.alias("n_serious"))
    if all_entities is not None:
        agg = all_entities.select(entity).join(agg, entity, "left")
    if centrality is not None:
        agg = agg.join(centrality.select(entity, F.col("centrality").alias("_central")), entity, "left")
    else:
        agg = agg.withColumn("_central", F.lit(0.0))
    known = F.coalesce(F.col("n_cases"), F.lit(0)) > 0
    days = F.datediff(F.lit(as_of.isoformat()).cast("date"), F.col("last_seen"))
    zero = F.lit(0.0)
    part = lambda c: F.when(known, python_round(c, 3)).otherwise(zero)
    out = agg.withColumns({
        "n_cases": F.coalesce(F.col("n_cases"), F.lit(0)), "n_serious": F.coalesce(F.col("n_serious"), F.lit(0)),
        "days_since": days,
        "recency": part(F.exp(-days / F.lit(tau))),
        "frequency": part(F.least(F.lit(1.0), F.col("n_cases") / F.lit(saturation))),
        "gravity": part(F.when(F.col("n_serious") > 0, 1.0).otherwise(0.5)),
        "centrality": part(F.coalesce(F.col("_central"), zero)),
    })
    total = sum((F.lit(weights[k]) * F.col(k) for k in ("recency", "frequency", "gravity", "centrality")), F.lit(0.0))
    return out.withColumn("score", python_round(total, 3)).select(
        entity, "score", "recency", "frequency", "gravity", "centrality", "n_cases", "n_serious", "days_since")


def explain(scores: DataFrame) -> DataFrame:
    """A sentence per scored entity."""
    return scores.withColumn("explanation", F.when(F.col("n_cases") == 0, F.lit(SCORE_NO_HISTORY)).otherwise(
        F.format_string(SCORE_EXPLANATION, "n_cases", "days_since", "n_serious", "centrality")))


def rank(scores: DataFrame, entity: str, k: int = 10, min_rows: int = 2, prefilter: int | None = None) -> DataFrame:
    """The k highest scores among entities with enough rows. ``prefilter`` first keeps the
    entities with most rows; None scores all."""
    pool = scores.where(F.col("n_cases") >= min_rows)
    if prefilter is not None:
        pool = pool.orderBy(F.desc("n_cases"), entity).limit(prefilter)
    return pool.orderBy(F.desc("score"), entity).limit(k)


def rank_pool(history: DataFrame, scores: DataFrame, entity: str, where: Column | None = None, k: int = 10, min_rows: int = 2,
              prefilter: int | None = 40) -> DataFrame:
    """The k highest scores among the entities with most rows in a part of the history, such as one district.

    ``where`` chooses the rows that count for the pool; the score itself is over an
    entity's whole history. ``pool_rows`` is the number of rows in that part; id breaks ties.
    """
    part = history if where is None else history.where(where)
    pool = part.groupBy(entity).agg(F.count(F.lit(1)).alias("pool_rows")).where(F.col("pool_rows") >= min_rows)
    if prefilter is not None:
        pool = pool.orderBy(F.desc("pool_rows"), entity).limit(prefilter)
    return scores.join(pool, entity).orderBy(F.desc("score"), entity).limit(k)


def history_rows(ranked: DataFrame, history: DataFrame, entity: str, case: str = "case_id") -> DataFrame:
    """(entity, case): the distinct records behind each ranked entity, as a child table."""
    return history.join(ranked.select(entity), entity, "left_semi").select(entity, case).distinct()
