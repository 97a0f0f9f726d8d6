"""Language identification with error-correcting output codes.

Every language has a codeword of +1/-1 bits. A bit's binary classifier is a table of log
odds of hashed byte n-grams; its margin is the mean log odds of a text's n-grams, in units
of its typical size. Decoding adds up, for each codeword, the exponential losses of its
bits, weighted by each bit's reliability, and takes the nearest codeword.

Defined cases: null text or text without a letter is ``und`` with score 0 (not flagged);
a table without learned languages gives ``und``; with one learned language every text with
letters gets it; ties go to the language that sorts first. Rows are predicted one by one.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .arrow_text import chunks, free_name, mix, struct_of, with_text_function

NGRAM = 3
BUCKETS = 1 << 15
#: Up to so many languages have every split of the languages as a bit; more get random codes.
EXHAUSTIVE = 5
BITS_PER_DOUBLING = 15
#: Training documents on which the bits' margins are scaled and their reliability measured.
SCALE_DOCS = 2000
AMBIGUOUS_GAP = 0.1
_LETTER = r"\p{L}"

RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("ambiguous", T.BooleanType())])


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, n-gram bucket, row) over slices of the lower-cased texts."""
    for a, b, buf, at in chunks(pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))):
        n = len(buf) - NGRAM + 1
        if n <= 0:
            yield a, b, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        code = np.zeros(n, np.uint32)
        for k in range(NGRAM):
            code = code * np.uint32(257) + buf[k:k + n]
        bucket = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
        inside = np.arange(n) + NGRAM <= at[row + 1]
        yield a, b, bucket[inside], row[inside]


def count_ngrams(train: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n): each task adds up its texts first; at most languages x buckets rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(1).to_pylist()
            names = sorted(set(labels))
            code = np.array([names.index(x) for x in labels], np.int64)
            for a, _, bucket, row in features(batch.column(0)):
                got = np.bincount(code[a + row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for i, name in enumerate(names):
                    totals[name] = totals.get(name, 0) + got[i]
        for name, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])],
                                             names=["lang", "bucket", "n"])

    pairs = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    return pairs.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(k: int) -> np.ndarray:
    """k rows of +1/-1; columns differ from each other and from their opposites."""
    if k <= 1:
        return np.zeros((k, 0))
    if k <= EXHAUSTIVE:
        return np.array([[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for b in range(1, 2 ** (k - 1))] for i in range(k)])
    want, seen, columns, draw = min(BITS_PER_DOUBLING * int(np.ceil(np.log2(k))), 2 ** (k - 1) - 1), set(), [], 0
    while len(columns) < want or len({tuple(r) for r in np.array(columns).T}) < k:
        bits = np.where(mix(np.arange(k, dtype=np.uint64) + np.uint64(draw * k + 1)) >> np.uint64(63), 1, -1)
        draw += 1
        bits = bits * bits[0]
        if abs(bits.sum()) < k and tuple(bits) not in seen:
            seen.add(tuple(bits))
            columns.append(bits)
    return np.array(columns).T


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # language x bit
    odds: np.ndarray  # bucket x bit
    scale: np.ndarray
    weight: np.ndarray

    def margins(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), self.code.shape[1]), np.float32)
        for a, b, bucket, row in features(column):
            if len(row):
                n = np.bincount(row, minlength=b - a)
                some = np.flatnonzero(n)
                first = np.cumsum(n)[some] - n[some]
                out[a + some] = np.add.reduceat(self.odds[bucket], first, axis=0) / n[some, None]
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, score, ambiguous)."""
        known = pc.match_substring_regex(column, _LETTER).fill_null(False).to_numpy(zero_copy_only=False)
        if not self.langs:
            return np.full(len(column), -1), np.zeros(len(column)), np.zeros(len(column), bool)
        if len(self.langs) == 1:
            return np.where(known, 0, -1), known.astype(float), np.zeros(len(column), bool)
        m = self.margins(column) / self.scale
        loss = np.exp(-np.clip(m, -8, 8)) @ (self.weight[:, None] * (self.code.T > 0)) + \
            np.exp(np.clip(m, -8, 8)) @ (self.weight[:, None] * (self.code.T < 0))
        p = np.exp(4 * (loss.min(1, keepdims=True) - loss))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        near = top[:, -1] - top[:, -2] < AMBIGUOUS_GAP
        return np.where(known, best, -1), np.where(known, top[:, -1], 0.0), near & known


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on all ``rows`` with a language; only the counts, of fixed size per language, reach the driver."""
    counted = count_ngrams(rows, text, lang).toPandas()
    langs = sorted(counted["lang"].unique())
    code = codewords(len(langs))
    if code.shape[1] == 0:
        return Model(langs, code, np.zeros((BUCKETS, 0), np.float32), np.ones(0), np.ones(0))
    n = np.zeros((len(langs), BUCKETS))
    n[[langs.index(x) for x in counted["lang"]], counted["bucket"]] = counted["n"]
    share = (n + 0.5) / (n + 0.5).sum(1, keepdims=True)
    side = lambda sign: np.array([share[code[:, b] == sign].mean(0) for b in range(code.shape[1])])
    odds = (np.log(side(1)) - np.log(side(-1))).T.astype(np.float32)
    model = Model(langs, code, odds, np.ones(code.shape[1]), np.ones(code.shape[1]))
    known = rows.where(F.col(lang).isNotNull() & F.col(text).rlike(_LETTER)).select(text, lang, F.xxhash64(text).alias("_h"))
    least = known.select("_h").distinct().orderBy("_h").limit(SCALE_DOCS).agg(F.max("_h")).first()[0]  # numbers first, then few texts
    some = known.where(F.col("_h") <= (least if least is not None else 0)).dropDuplicates(["_h"]).toPandas()
    m = model.margins(pa.array(some[text], pa.large_string()))
    truth = code[[langs.index(x) for x in some[lang]]]
    model.scale = np.maximum(np.abs(m).mean(0), 1e-6)
    right = ((m * truth > 0).mean(0) * len(m) + 1) / (len(m) + 2)
    model.weight = np.maximum(np.log(right / (1 - right)), 0.05)
    model.weight /= model.weight.sum()
    return model


def with_language(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct column ``name``: lang, score (0 to 1), ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets at most

    def make():
        m = shared.value
        names = pa.array([*m.langs, "und"], pa.string())

        def of(column: pa.Array) -> pa.StructArray:
            column = column.cast(pa.large_string())
            best, score, near = m.predict(column)
            return struct_of(["lang", "score", "ambiguous"],
                             [names.take(pa.array(np.where(best < 0, len(m.langs), best))), score.astype(float), near])
        return of

    return with_text_function(docs, text, name, RESULT, make)


def filter_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose language is found without ambiguity, unchanged."""
    name = free_name(docs, "language")
    return with_language(docs, model, text, name).where(
        (F.col(f"{name}.lang") != "und") & ~F.col(f"{name}.ambiguous")).select(*[F.col(f"`{c}`") for c in docs.columns])
