"""Row scope by role and masking of personal data."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

STATEWIDE = "statewide"


def scope(df: DataFrame, user: str, scopes: DataFrame, levels: Iterable[str] = ("police_station", "district")) -> DataFrame:
    """Rows a user may see. ``scopes`` holds (user_id, level, value); level 'statewide'
    opens every row, a missing user sees nothing. Evaluated in the plan, as semi-joins on
    the user's own few scope rows."""
    own = scopes.where(F.col("user_id") == user).select("level", "value")
    everything = own.where(F.col("level") == STATEWIDE).agg(F.count(F.lit(1)) > 0).scalar()
    visible = everything
    for level in levels:
        values = own.where(F.col("level") == level).agg(F.collect_set("value")).scalar()
        visible = visible | F.coalesce(F.array_contains(values, F.col(level)), F.lit(False))
    return df.where(visible)


def initials(name: Column | str) -> Column:
    """'Ravi K' -> 'R. K.'"""
    c = F.col(name) if isinstance(name, str) else name
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: F.length(w) > 0)
    return F.array_join(F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), F.lit("."))), " ")


def age_band(age: Column | str, width: int = 10) -> Column:
    """37 -> '30-39'"""
    c = F.col(age) if isinstance(age, str) else age
    low = (F.floor(c / width) * width).cast("int")
    return F.when(c.isNotNull(), F.concat_ws("-", low.cast("string"), (low + width - 1).cast("string")))


def mask(df: DataFrame, names: Iterable[str] = (), ages: Iterable[str] = ()) -> DataFrame:
    return df.withColumns({**{n: initials(n) for n in names}, **{a: age_band(a) for a in ages}})
