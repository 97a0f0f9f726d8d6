"""The case pack of a series as tables: timeline, suspects, leads, legal check, outlook."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fx
from ..functions.rounding import python_round
from .ranking import numbered


def timeline(members: DataFrame, cases: DataFrame, case: str = "case_id", ts: str = "registered",
             place: Sequence[str] = ("police_station", "district")) -> DataFrame:
    """(date, case, event) of a series in order of registration."""
    event = F.concat(F.lit(fx.PACK_EVENT), F.concat_ws(", ", *place))
    return (cases.join(members.select(case).distinct(), case, "left_semi")
            .select(F.col(ts).alias("date"), case, event.alias("event")).orderBy("date", case))


def suspects(support: DataFrame, scores: DataFrame, names: DataFrame, person: str = "person_key", name: str = "full_name", top: int = 8) -> DataFrame:
    """Entities by support (2 places), then score, then id."""
    ranked = (support.select(person, python_round("support", 2).alias("support"))
              .join(scores.select(person, "score"), person, "left").join(names.select(person, name), person, "left")
              .withColumn("score", F.coalesce("score", F.lit(0.0))))
    best = ranked.orderBy(F.desc("support"), F.desc("score"), person).limit(top)
    return numbered(best, [F.desc("support"), F.desc("score"), person], "%d", "_t", "rank").select("rank", person, name, "support", "score")


def sections_invoked(members: DataFrame, act_sections: DataFrame, elements: DataFrame, case: str = "case_id") -> DataFrame:
    """Distinct sections of the series' cases with their description (empty if unknown)."""
    known = elements.select("section", "description").distinct()
    used = act_sections.join(members.select(case).distinct(), case, "left_semi").select("section").distinct()
    return used.join(F.broadcast(known), "section", "left").withColumn("description", F.coalesce("description", F.lit("")))


def elements_check(invoked: DataFrame, elements: DataFrame) -> DataFrame:
    """Checklist of the invoked sections; the last element of each is an open gap.

    ``elements`` is the fixed dictionary (section, pos, element, n_elements).
    """
    gap = F.col("pos") == F.col("n_elements") - 1
    return invoked.select("section").join(F.broadcast(elements), "section").select(
        "section", "element", F.when(gap, "missing").otherwise("present").alias("status"),
        F.when(gap, fx.PACK_MISSING_SOURCE).otherwise(fx.PACK_PRESENT_SOURCE).alias("source"))


def leads(suspect_rows: DataFrame, similar_rows: DataFrame, person: str = "person_key", name: str = "full_name", key: str = "case_id") -> DataFrame:
    """Numbered leads: first the top suspect, then the similar history (if any)."""
    first = suspect_rows.where(F.col("rank") == 1).select(
        F.lit(0).alias("_o"), F.concat(F.lit(fx.PACK_SUSPECT_LEAD), F.coalesce(name, F.col(person).cast("string")), F.lit(" ("),
                                       F.col(person).cast("string"), F.lit(")")).alias("lead"),
        F.format_string(fx.PACK_SUSPECT_REASON, "score").alias("rationale"))
    near = similar_rows.agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("best")).where(F.col("n") > 0)
    second = near.select(
        F.lit(1).alias("_o"), F.lit(fx.PACK_SIMILAR_LEAD).alias("lead"),
        F.format_string(fx.PACK_SIMILAR_REASON, "n", "best").alias("rationale"))
    return numbered(first.unionByName(second), ["_o"], "%d", "_t", "rank").select("rank", "lead", "rationale")


def outlook(forecast_rows: DataFrame, areas: DataFrame) -> DataFrame:
    """Next window (first forecast week, or a default) beside each likely area."""
    week = forecast_rows.where((F.col("status") == "ok") & (F.col("step") == 1)).agg(F.min("week").cast("string")).scalar()
    return areas.select(F.coalesce(week, F.lit(fx.PACK_DEFAULT_WINDOW)).alias("next_window"), "cell", "prob")


def summary(series: DataFrame, suspect_rows: DataFrame, next_window: DataFrame | None = None) -> DataFrame:
    """One sentence per series row: what links it, how far it reaches, who leads the list."""
    prime = suspect_rows.where(F.col("rank") == 1).select(
        F.concat(F.lit("Prime suspect: "), "full_name", F.lit(" (risk "), F.format_string("%.3f", "score"), F.lit("). "))).scalar()
    window = (next_window.agg(F.min("next_window")).scalar() if next_window is not None else F.lit(None).cast("string"))
    text = F.concat(F.lit("Series "), "series_id", F.lit(": "), "summary", F.lit(". "), F.col("size").cast("string"), F.lit(" linked cases across "),
                    F.array_join("districts", ", "), F.lit(" (confidence "), F.format_string("%.3f", "confidence"), F.lit("). "),
                    F.coalesce(prime, F.lit("")), F.lit("Projected next activity window: "), F.coalesce(window, F.lit(fx.PACK_DEFAULT_WINDOW)), F.lit("."))
    return series.select("series_id", text.alias("summary"))

