"""Document quality by a regularised quadratic discriminant.

Statistics of a text are counted in bytes with numpy and brought to a log scale. Each class
has a mean and a covariance, shrunk towards the diagonal of the pooled one; sums for them
are taken over all labelled training rows by Spark. A text's margin is the difference of the
two log densities, from Mahalanobis distances by Cholesky factors that are computed once. A
score is the probability of label 1 by Platt's line through the margins of the training rows,
fitted by Newton steps whose sums Spark takes, so that 0.5 parts likelier from less likely.

Defined cases: null counts as empty, whose statistics are all zero; without training rows of
both classes every score is 0.5; repeated rows are scored one by one; labels without a
document or a value are ignored, repeated ones count as often as they are there; an empty
table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import cut
from .arrow_text import chunks, shingles, word_hashes, words

NAMES = ["words", "mean_word", "spread_word", "letters", "upper", "digits", "marks", "points", "exclaims", "lines", "distinct_words",
         "top_word", "echo", "repeated_runs", "repeated_lines"]
SHRINKAGE = 0.2
RIDGE = 1e-2
#: Margins are taken as at most FAR * tanh(margin / FAR) in the line, so that single rows far out do not rule it.
FAR = 40.0
TURNS = 12
#: Ridge of the line's slope, in rows.
LINE_RIDGE = 1.0
_EPS = 1e-3


def _bytes(*groups) -> np.ndarray:
    out = np.zeros(256, bool)
    for g in groups:
        out[list(g)] = True
    return out


_UPPER = _bytes(range(65, 91))
_LETTER = _bytes(range(65, 91), range(97, 123), range(128, 256))
_DIGIT = _bytes(range(48, 58))
_MARK = _bytes(b"#*$%&|<>=_~^{}[]\\@/+")
_POINT = _bytes(b".,;:?'\"()-")
_EXCLAIM = _bytes(b"!")
_LINE = _bytes(b"\n")


def _distinct(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, count of the most frequent one) per row."""
    if not len(h):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
    most = np.zeros(rows)
    np.maximum.at(most, row[first], np.diff(np.concatenate((first, [len(h)]))))
    return np.bincount(row[first], minlength=rows).astype(float), most


def statistics(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """row x statistic of one slice of texts."""
    n = len(at) - 1

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask[buf]))).astype(float)
        return total[at[1:]] - total[at[:-1]]

    start, end, row = words(buf, at)
    h = word_hashes(buf, start, end)
    size = (end - start).astype(float)
    n_words = np.bincount(row, minlength=n).astype(float)
    chars = np.bincount(row, size, n)
    per_word, per_char = np.maximum(n_words, 1), np.maximum(chars, 1)
    mean = chars / per_word
    spread = np.sqrt(np.maximum(np.bincount(row, size * size, n) / per_word - mean * mean, 0))
    kinds, most = _distinct(h, row, n)
    same = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=n) if len(h) > 1 else np.zeros(n)
    runs, of = shingles(h, row, n, 3)
    run_kinds, _ = _distinct(runs, of, n)
    n_runs = np.maximum(np.bincount(of, minlength=n), 1)
    breaks = np.union1d(np.flatnonzero(_LINE[buf]) + 1, at)
    a, b = breaks[:-1], breaks[1:]
    full = b - a > 1
    a, b = a[full], b[full]
    line_row = np.searchsorted(at, a, "right") - 1
    line_kinds, _ = _distinct(word_hashes(buf, a, b), line_row, n)
    n_lines = np.bincount(line_row, minlength=n)
    share = lambda x, of: np.log(x / of + _EPS) - np.log(_EPS)
    out = np.stack([np.log1p(n_words), mean / 4, np.log1p(spread), share(count(_LETTER), per_char), share(count(_UPPER), per_char),
                    share(count(_DIGIT), per_char), share(count(_MARK), per_char), share(count(_POINT), per_char),
                    share(count(_EXCLAIM), per_char), np.log1p(n_lines), share(kinds, per_word), share(most, per_word),
                    share(same, per_word), share(1 - run_kinds / n_runs, 1), share(1 - line_kinds / np.maximum(n_lines, 1), 1)], 1)
    out[n_words == 0] = 0
    return out


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, len(NAMES)))
            for a, b, buf, at in chunks(batch.column(1)):
                x[a:b] = statistics(buf, at)
            ends = np.arange(0, x.size + 1, len(NAMES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))],
                                             names=["doc_id", "x"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    means: np.ndarray
    factors: np.ndarray  # inverse Cholesky factors of the two covariances
    constants: np.ndarray  # log prior - log determinant / 2
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        logs = [c - ((x - m) @ f.T).__pow__(2).sum(1) / 2 for m, f, c in zip(self.means, self.factors, self.constants)]
        return FAR * np.tanh((logs[1] - logs[0]) / FAR)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -36, 36)))


def fit(measured: DataFrame, labels: DataFrame, use: Column, label: str = "quality") -> Discriminant | None:
    """Sums over all training rows by class, then the line; rows of sums reach the driver."""
    d = len(NAMES)
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("y"))
    x = [F.col("x")[i] for i in range(d)]
    rows = cut(measured.where(use).join(known, "doc_id").select("x", "y"), "training")
    sums = rows.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)],
        *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i + 1)]).collect()
    by = {r["y"]: r for r in sums}
    if set(by) != {0, 1}:
        return None
    n = np.array([by[c]["n"] for c in (0, 1)], float)
    means = np.array([[by[c][f"s{i}"] for i in range(d)] for c in (0, 1)]) / n[:, None]
    spread = np.array([[[by[c][f"s{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)] for c in (0, 1)])
    spread = spread / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = np.diag((spread * n[:, None, None]).sum(0).diagonal() / n.sum())
    factors, constants = [], []
    for c in (0, 1):
        weight = SHRINKAGE + (1 - SHRINKAGE) * d / (d + n[c])  # few rows lean more on the pooled diagonal
        low = np.linalg.cholesky((1 - weight) * spread[c] + weight * pooled + RIDGE * np.eye(d))
        factors.append(np.linalg.inv(low))
        constants.append(np.log(n[c] / n.sum()) - np.log(low.diagonal()).sum())
    return calibrate(rows, Discriminant(means, np.array(factors), np.array(constants)), n)


def calibrate(rows: DataFrame, model: Discriminant, n: np.ndarray) -> Discriminant:
    """Platt's line: a logistic fit of label on margin over ``rows`` (x, y) with ``n`` of each class; targets are smoothed as Platt's are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([pa.array(model.margin(x)), batch.column(1).cast(pa.int32())], names=["m", "y"])

    margins = cut(rows.mapInArrow(run, "m double, y int"), "margins")
    low, high = 1 / (n[0] + 2), (n[1] + 1) / (n[1] + 2)
    line = np.array([1.0, 0.0])

    def loss_and_sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = F.col("m") * float(at[0]) + F.lit(float(at[1]))
        t = F.when(F.col("y") == 1, F.lit(float(high))).otherwise(F.lit(float(low)))
        p = 1 / (1 + F.exp(-z))
        r, w = t - p, p * (1 - p)
        m = F.col("m")
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - t * z
        s = margins.select(loss.alias("l"), (r * m).alias("a"), r.alias("b"), (w * m * m).alias("c"), (w * m).alias("d"), w.alias("e")).agg(
            *[F.sum(k).alias(k) for k in "labcde"]).first()
        gradient = np.array([s["a"] - LINE_RIDGE * (at[0] - 1.0), s["b"]])
        return s["l"] + LINE_RIDGE * (at[0] - 1.0) ** 2 / 2, gradient, np.array([[s["c"] + LINE_RIDGE, s["d"]], [s["d"], s["e"] + 1e-6]])

    loss, gradient, curve = loss_and_sums(line)
    for _ in range(TURNS):
        step = np.linalg.solve(curve, gradient)
        while True:  # halved until the loss falls
            new = line + step
            new_loss, new_gradient, new_curve = loss_and_sums(new)
            if new_loss <= loss or np.abs(step).max() < 1e-6:
                break
            step = step / 2
        done = loss - new_loss < 1e-4
        if new_loss <= loss:
            line, loss, gradient, curve = new, new_loss, new_gradient, new_curve
        if done:
            break
    model.slope, model.offset = float(max(line[0], 1e-6)), float(line[1])
    return model


def with_score(measured: DataFrame, model: Discriminant | None) -> DataFrame:
    """(doc_id, score) for every measured row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
            score = np.full(len(x), 0.5) if model is None else model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return measured.mapInArrow(run, "doc_id long, score double")
