"""Strongest links of a crowded cell: pairs are scored as matrices and thinned at once.

A task has the late records of one cell and the early ones that may lie near them, and gives
the forest of the strongest links among them, which holds every record's strongest link. The
late records form a forest first, a few at a time. From then on a pair is left out when it
closes a circle whose other links are all stronger: its record has a stronger link into a part
of the forest that hangs together by stronger links. Only pairs that may stay get their exact
score, so a pair costs a few nanoseconds and none is stored.
"""
from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from ..functions.fixed_values import EARTH_RADIUS_KM
from .clusters import _forest_rows

#: Pairs that are scored at a time, and late records that are added to the forest at a time.
TILE, WIDTH, BLOCK = 1 << 16, 1024, 128
#: From so many pairs of a cell on links are left out before they get their exact score.
MANY = 1 << 16
#: Part of the late records that the strongest connected part must hold.
MOST = 0.9
SCHEMA = "a long, b long, score double"


@dataclass(frozen=True)
class Scoring:
    """How a pair is scored: score = cosine + geo + features that agree; ``base`` is the weight of those all pairs share."""
    cosine: float
    geo: float
    scale_km: float
    base: float
    features: dict[str, float]
    differ: Sequence[str]
    km: float
    days: int
    threshold: float | None
    clipped: bool


class _Side:
    """The columns of one side as arrays; ``flat`` multiplies to the score without its geo part, ``near`` and ``far`` to squared kilometres."""

    def __init__(self, rows: pa.Table, codes: dict[str, np.ndarray], sizes: dict[str, int], how: Scoring):
        self.id, self.day, self.bucket = (rows.column(c).to_numpy() for c in ("id", "day", "bucket"))
        self.lat, self.lon = rows.column("lat").to_numpy(), rows.column("lon").to_numpy()
        v = rows.column("_v").combine_chunks()
        self.v = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 0))
        hot = []
        for f, w in how.features.items():
            block = np.zeros((len(self.id), sizes[f]))
            known = codes[f] >= 0
            block[np.flatnonzero(known), codes[f][known]] = np.sqrt(w)
            hot.append(block)
        self.flat = np.hstack([np.sqrt(how.cosine) * self.v, *hot]).astype(np.float32)
        self.codes = codes

    def placed(self, middle: np.ndarray | None = None) -> np.ndarray:
        """Single precision is enough near the middle of the cell."""
        la, lo = np.radians(self.lat), np.radians(self.lon)
        place = EARTH_RADIUS_KM * np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)
        middle = place.mean(0) if middle is None else middle
        place -= middle
        size, one = (place * place).sum(1, keepdims=True), np.ones((len(place), 1))
        self.near = np.hstack([place, size, one]).astype(np.float32)
        self.far = np.hstack([-2 * place, one, size]).astype(np.float32)
        return middle


def _codes(tables: Sequence[pa.Table], f: str) -> tuple[list[np.ndarray], int]:
    """Numbers of a feature's values, the same in all tables; -1 where it has none."""
    columns = [t.column(f).combine_chunks() for t in tables]
    whole = pc.dictionary_encode(pa.concat_arrays(columns))
    at = pc.fill_null(whole.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(at, np.cumsum([len(c) for c in columns])[:-1]), len(whole.dictionary)


def _exact(x: _Side, i: np.ndarray, y: _Side, j: np.ndarray, how: Scoring) -> tuple[np.ndarray, np.ndarray]:
    """(kilometres, score), as ``score_pairs`` has them."""
    p1, p2 = np.radians(x.lat[i]), np.radians(y.lat[j])
    dp, dl = np.radians(y.lat[j] - x.lat[i]), np.radians(y.lon[j] - x.lon[i])
    a = np.sin(dp / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(dl / 2) ** 2
    km = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(a, 0.0, 1.0)))
    part = how.geo * (1 - np.minimum(km, how.scale_km) / how.scale_km) + how.base
    for f, w in how.features.items():
        part = part + w * ((x.codes[f][i] == y.codes[f][j]) & (x.codes[f][i] >= 0))
    cosine = np.zeros(len(i))
    for c in range(x.v.shape[1]):
        cosine = cosine + x.v[i, c] * y.v[j, c]
    return km, how.cosine * cosine + part


def _slack(how: Scoring) -> float:
    """The matrix score differs by less from the exact one: single precision, and a chord for an arc."""
    return 1e-5 + how.geo * how.km / how.scale_km * (5e-3 + (how.km / EARTH_RADIUS_KM) ** 2 / 12)


def _tile(x: _Side, rows: np.ndarray, y: _Side, cols: np.ndarray, allowed, how: Scoring, level: float | None):
    """(row, column, score) of the pairs that may stay; with a ``level`` the columns hang together above it."""
    slack = _slack(how)
    far = x.near[rows] @ y.far[cols].T
    stays = far <= np.float32((how.km * 1.01) ** 2 + 1e-3)
    np.sqrt(np.maximum(far, 0, out=far), out=far)
    score = x.flat[rows] @ y.flat[cols].T
    if how.km > how.scale_km:
        np.minimum(far, how.scale_km, out=far)
    far *= np.float32(how.geo / how.scale_km)
    score -= far
    shift = how.base + how.geo
    if allowed is not None:
        stays &= allowed
    for f in how.differ:
        mine, other = x.codes[f][rows][:, None], y.codes[f][cols][None, :]
        stays &= (mine != other) | (mine < 0)
    if how.threshold is not None:
        stays &= score >= np.float32(how.threshold - slack - shift)
    floor = None
    if level is not None:
        np.copyto(score, -np.inf, where=~stays)
        floor = np.minimum(score.max(1), level - shift)
        stays = score >= np.where(floor > -np.inf, floor - 2 * slack, np.inf)[:, None]
    at = np.flatnonzero(stays)
    i, j = np.divmod(at, stays.shape[1])
    km, exact = _exact(x, rows[i], y, cols[j], how)
    good = km <= how.km
    if how.threshold is not None:
        good &= exact >= how.threshold
    i, j, exact = i[good], j[good], exact[good]
    if level is None:
        return rows[i], cols[j], exact
    # what left out the others must itself be a link
    best = np.full(len(rows), -np.inf)
    np.maximum.at(best, i, exact)
    again = np.flatnonzero((floor > -np.inf) & (best < floor + shift - slack))
    if not len(again):
        return rows[i], cols[j], exact
    rest = ~np.isin(i, again)
    more = _tile(x, rows[again], y, cols, None if allowed is None else allowed[again], how, None)
    return tuple(np.concatenate([p, q]) for p, q in zip((rows[i[rest]], cols[j[rest]], exact[rest]), more))


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's connected part."""
    low = np.arange(n)
    while True:
        x, y = low[a], low[b]
        if np.array_equal(x, y):
            return low
        least = np.minimum(x, y)
        np.minimum.at(low, x, least)
        np.minimum.at(low, y, least)
        while not np.array_equal(low, low[low]):
            low = low[low]


def strongest(late: pa.Table, early: pa.Table, how: Scoring) -> pa.Table:
    """(a, b, score): the forest of the strongest links of late records among themselves and with early ones."""
    codes, sizes = {}, {}
    for f in dict.fromkeys([*how.features, *how.differ]):
        codes[f], sizes[f] = _codes([late, early], f)
    y, x = (_Side(t, {f: c[k] for f, c in codes.items()}, sizes, how) for k, t in enumerate((late, early)))
    x.placed(y.placed())
    ids, code = np.unique(np.concatenate([y.id, x.id]), return_inverse=True)
    own, others = code[:len(y.id)], code[len(y.id):]
    kept: list[list[np.ndarray]] = [[], [], []]

    def add(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> None:
        for to, c in zip(kept, (np.minimum(a, b), np.maximum(a, b), score)):
            to.append(c)

    def thin() -> None:
        a, b, score = (np.concatenate(c) if c else np.zeros(0) for c in kept)
        if len(a):
            d = np.minimum(1.0, np.maximum(0.0, 1.0 - score)) if how.clipped else -score
            at = np.lexsort((b, a, d))
            at = at[_forest_rows(a[at].astype(np.int64), b[at].astype(np.int64), len(ids))]
            kept[:] = [[a[at]], [b[at]], [score[at]]]

    def together(n: int) -> tuple[float, np.ndarray]:
        """(level, which late records hang together by links above it): of the first n, most do."""
        a, b, score = kept[0][0], kept[1][0], kept[2][0]
        inside = np.zeros(len(ids), bool)
        inside[own[:n]] = True
        for part in (0.5, 0.75, 0.9, 0.97, 1.0):
            level = np.quantile(score, 1 - part)
            strong = score >= level
            low = _parts(len(ids), a[strong].astype(np.int64), b[strong].astype(np.int64))
            count = np.bincount(low[inside], minlength=len(ids))
            if count.max() >= MOST * inside.sum():
                break
        return min(level, 1 - 3 * _slack(how)), (low[own] == count.argmax()) & inside[own]

    n, level, held, since = len(y.id), None, np.zeros(len(y.id), bool), 0
    many = n * (n + len(x.id)) > MANY

    def sides(chosen: np.ndarray):
        """The columns that hang together, with their level, and the others, a tile at a time."""
        part = held[chosen]
        for cols, above in ((chosen[part], level), (chosen[~part], None)):
            for c in range(0, len(cols), WIDTH):
                yield cols[c:c + WIDTH], above

    for at in range(0, n, BLOCK):  # late records join those before them; all lie within the days
        rows = np.arange(at, min(at + BLOCK, n))
        for cols, above in sides(np.arange(at)):
            i, j, score = _tile(y, rows, y, cols, None, how, above)
            add(own[i], own[j], score)
        i, j, score = _tile(y, rows, y, rows, rows[:, None] > rows[None, :], how, None)
        add(own[i], own[j], score)
        since += len(rows)
        if many and (at + len(rows) == n or since >= max(BLOCK, at // 4)):
            thin()
            since = 0
            if len(kept[0]) and len(kept[0][0]):
                level, held = together(at + len(rows))
    if n and len(x.id):
        same, past = (np.flatnonzero(f) for f in (x.bucket == y.bucket[0], x.bucket != y.bucket[0]))
        past = past[np.argsort(x.day[past], kind="stable")]
        by_day = np.argsort(y.day, kind="stable")
        days = y.day[by_day]
        mine, theirs, last = others.astype(np.int32), own.astype(np.int32), x.day + how.days
        pending, height = 0, max(1, TILE // min(n, WIDTH))
        for group, recent in ((same, False), (past, True)):
            for k in range(0, len(group), height):
                rows = group[k:k + height]
                # an earlier bucket has earlier days
                chosen = by_day[:np.searchsorted(days, last[rows].max(), "right")] if recent else np.arange(n)
                for cols, above in sides(chosen):
                    allowed = y.day[cols][None, :] <= last[rows][:, None] if recent else mine[rows][:, None] < theirs[cols][None, :]
                    i, j, score = _tile(x, rows, y, cols, allowed, how, above)
                    add(others[i], own[j], score)
                    pending += len(i)
                if pending > 8 * TILE:
                    thin()
                    pending = 0
    thin()
    a, b, score = (np.concatenate(c) if c else np.zeros(0) for c in kept)
    a, b = a.astype(np.int64), b.astype(np.int64)
    apart = a != b
    return pa.table({"a": pa.array(ids[a[apart]], pa.int64()), "b": pa.array(ids[b[apart]], pa.int64()), "score": pa.array(score[apart], pa.float64())})


# Tasks receive this module by value, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
