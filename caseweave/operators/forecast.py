"""Per-series weekly forecasts: SARIMA(1,1,1)(1,0,1) with season 52 and a backtest.

A series is bounded by its number of weeks, whatever the number of rows behind it. Spark
distributes the series; inside a task one is fitted by conditional sum of squares.
"""
from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from . import timeseries as ts

SEASON = 52
Z80 = 1.2815515655446004  # 90th percentile of the normal law: an 80 % interval


def residuals(w: np.ndarray, p: np.ndarray, season: int = SEASON) -> np.ndarray:
    """One-step errors of the differenced series; values before the start count as 0."""
    ar, ma, sar, sma = p
    padded = np.concatenate([np.zeros(season + 1), w])
    n = len(w)
    lag = lambda k: padded[season + 1 - k: season + 1 - k + n]
    v = (w - ar * lag(1) - sar * lag(season) + ar * sar * lag(season + 1)).tolist()
    prev = 0.0
    for t in range(n):
        prev = v[t] - ma * prev
        v[t] = prev
    e = np.asarray(v)
    for start in range(season, n, season):
        stop = min(start + season, n)
        e[start:stop] -= sma * e[start - season: stop - season]
    return e


def _simplex(f, x0: np.ndarray, step: float = 0.3, iterations: int = 250, tolerance: float = 1e-6) -> np.ndarray:
    """Downhill simplex search."""
    n = len(x0)
    points = [x0] + [x0 + step * np.eye(n)[i] for i in range(n)]
    ranked = sorted(((f(p), i, p) for i, p in enumerate(points)), key=lambda r: r[:2])
    values, points = [r[0] for r in ranked], [r[2] for r in ranked]
    for _ in range(iterations):
        if values[-1] - values[0] <= tolerance * (abs(values[0]) + tolerance):
            break
        centre = np.mean(points[:-1], axis=0)
        away = centre - points[-1]
        trial = centre + away
        value = f(trial)
        if value < values[0]:
            far = centre + 2 * away
            far_value = f(far)
            if far_value < value:
                trial, value = far, far_value
        elif value >= values[-2]:
            near = centre + (0.5 if value < values[-1] else -0.5) * away
            near_value = f(near)
            if near_value < min(value, values[-1]):
                trial, value = near, near_value
            elif value >= values[-1]:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
                order = np.argsort(values, kind="stable")
                values, points = [values[i] for i in order], [points[i] for i in order]
                continue
        at = int(np.searchsorted(values[:-1], value, side="right"))
        values, points = values[:at] + [value] + values[at:-1], points[:at] + [trial] + points[at:-1]
    return points[0]


def fit(y: np.ndarray, season: int = SEASON) -> tuple[np.ndarray, np.ndarray, float]:
    """Parameters (ar, ma, seasonal ar, seasonal ma), errors and error variance."""
    w = np.diff(y)
    inside = lambda x: 0.98 * np.tanh(x)  # noqa: E731 - keeps the recursions stable
    loss = lambda x: float(np.mean(residuals(w, inside(x), season) ** 2))
    p = inside(_simplex(loss, np.array([0.1, -0.5, 0.2, -0.1])))
    e = residuals(w, p, season)
    return p, e, float(np.mean(e[min(season, len(e) // 2):] ** 2))


def predict(y: np.ndarray, horizon: int, season: int = SEASON) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard error of the next values."""
    p, e, variance = fit(y, season)
    ar, ma, sar, sma = p
    w = np.concatenate([np.zeros(season + 1), np.diff(y), np.zeros(horizon)])
    errors = np.concatenate([np.zeros(season + 1), e, np.zeros(horizon)])
    start = len(w) - horizon
    for t in range(start, len(w)):
        w[t] = (ar * w[t - 1] + sar * w[t - season] - ar * sar * w[t - season - 1] + errors[t]
                + ma * errors[t - 1] + sma * errors[t - season] + ma * sma * errors[t - season - 1])
    mean = y[-1] + np.cumsum(w[start:])
    # response of the level to a unit shock
    shock, psi = np.zeros(season + 1 + horizon), np.zeros(season + 1 + horizon)
    shock[season + 1] = 1.0
    for t in range(season + 1, len(psi)):
        psi[t] = (ar * psi[t - 1] + sar * psi[t - season] - ar * sar * psi[t - season - 1] + shock[t]
                  + ma * shock[t - 1] + sma * shock[t - season] + ma * sma * shock[t - season - 1])
    weights = np.cumsum(psi[season + 1:])
    return mean, np.sqrt(variance * np.cumsum(weights ** 2))


def _schema(series: DataFrame, by: Sequence[str], tail: str) -> T.StructType:
    keys = T.StructType([series.schema[c] for c in by])
    return T.StructType(keys.fields + T._parse_datatype_string(tail).fields)


def forecast(series: DataFrame, by: Sequence[str], name: str = "n", horizon: int = 8, min_weeks: int = ts.MIN_WEEKS,
             min_total: int = ts.MIN_TOTAL) -> DataFrame:
    """(by, step, week, mean, lo, hi, status): the next weeks of every series.

    Thin histories and failed fits give one row with a status and no numbers.
    """
    by = list(by)
    tail = "step int, week date, mean double, lo double, hi double, status string"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week")
        y = pdf[name].to_numpy(dtype=float)
        if len(y) < min_weeks or y.sum() < min_total:
            return pd.DataFrame([[*key, None, None, None, None, None, "insufficient history"]], columns=[*by, *COLUMNS])
        try:
            mean, error = predict(y, horizon)
        except (FloatingPointError, np.linalg.LinAlgError, ValueError) as exc:
            return pd.DataFrame([[*key, None, None, None, None, None, f"model fit failed: {exc}"]], columns=[*by, *COLUMNS])
        last = pd.Timestamp(pdf["week"].iloc[-1])
        rows = [[*key, i + 1, (last + pd.Timedelta(weeks=i + 1)).date(), round(float(mean[i]), 2),
                 round(max(0.0, float(mean[i] - Z80 * error[i])), 2), round(float(mean[i] + Z80 * error[i]), 2), "ok"]
                for i in range(horizon)]
        return pd.DataFrame(rows, columns=[*by, *COLUMNS])

    COLUMNS = ["step", "week", "mean", "lo", "hi", "status"]
    return series.select(*by, "week", name).groupBy(*by).applyInPandas(one, _schema(series, by, tail))


def backtest(series: DataFrame, by: Sequence[str], name: str = "n", holdout: int = 8, min_weeks: int = ts.MIN_WEEKS,
             min_total: int = ts.MIN_TOTAL) -> DataFrame:
    """(by, weeks, status, backtest_mae, baseline_mae): model and seasonal-naive errors over
    the last weeks, side by side."""
    by = list(by)
    tail = "week date, predicted double"

    def held_out(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week")
        y = pdf[name].to_numpy(dtype=float)
        empty = pd.DataFrame(columns=[*by, "week", "predicted"])
        if len(y) < min_weeks or y.sum() < min_total:
            return empty
        try:
            mean, _ = predict(y[:-holdout], holdout)
        except (FloatingPointError, np.linalg.LinAlgError, ValueError):
            return empty
        return pd.DataFrame([[*key, w, float(v)] for w, v in zip(pdf["week"].iloc[-holdout:], mean, strict=True)],
                            columns=[*by, "week", "predicted"])

    predicted = series.select(*by, "week", name).groupBy(*by).applyInPandas(held_out, _schema(series, by, tail))
    errors = predicted.join(series, [*by, "week"]).groupBy(*by).agg(F.avg(F.abs(F.col(name) - F.col("predicted"))).alias("backtest_mae"))
    gate = ts.history_gate(series, by, name, min_weeks, min_total).drop("total")
    out = gate.join(errors, by, "left").join(ts.seasonal_naive(series, by, name, holdout=holdout).drop("weeks"), by, "left")
    return out.withColumn("status", F.when((F.col("status") == "ok") & F.col("backtest_mae").isNull(), "model fit failed").otherwise(F.col("status")))


# Tasks receive this module by value, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
