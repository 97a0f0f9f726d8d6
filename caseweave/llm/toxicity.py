"""Toxicity by a support vector machine on a gap-weighted subsequence kernel.

The kernel of two words sums, over all common subsequences of three characters, decay to
the power of the spans they take up; the word's start counts as a character. It is
normalised and raised to the fourth power, so one inserted or missing character lowers it a
little and unrelated words are near zero. The kernel of a
sentence with a landmark adds up its words. Landmarks are words of labelled sentences,
chosen by pivoted Cholesky steps among the words that tell the classes apart best; the
Nystrom map turns kernel values with them into features, on which a linear machine is
trained. As its decision is a sum over words, a task computes each distinct word once.

A document is as toxic as its worst sentence. Labels are of documents: training starts with
the sentences of toxic documents that hold a telling word, or where there is none with the
most suspicious sentence, and in each turn takes those it finds toxic: with a telling word,
or the worst of their document.

Defined cases: null, empty and wordless texts have the score of an empty sentence; words
of over 24 characters are cut into overlapping windows; runs of single characters are
also read as one word; without both classes every score is 0; repeated rows are scored one by
one; an empty table gives an empty result.
"""
from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Most labelled training documents taken of each class; those with the smallest hash of the id.
TRAIN_DOCS = 800
CANDIDATES = 400
#: Landmarks of telling and of ordinary words; more telling ones are taken, up to MOST, while some telling word is
#: less than half explained by those picked.
TELLING, ORDINARY, MOST = 48, 16, 256
DECAY = 0.8
SPAN = 8
LONGEST = 24
TURNS = 3
#: A telling word is at least so many times as common in toxic documents as elsewhere, after smoothing. How sure that is
#: (log-odds less its standard error) must reach the level at which, with the classes swapped, at most this share of
#: words as would pass for telling of clean documents: those are as many as chance alone gives.
MIN_LIFT, CHANCE_SHARE = 8.0, 0.1
SENTENCE_WORDS = 24
SVM_COST = 1.0
#: Decisions are taken as at most so far from zero when they are turned into scores.
FAR = 4.0

_ORDER = 3
_CODES = 40
_START = "\x02\x02"  # twice, so that beginnings weigh more
_CACHE = 400_000
#: Subsequences looked up at once, so that their rows stay in the processor's cache.
_BLOCK = 8_192
_WORDS = 16_384
_PLACE_BITS = 10
# "[.!?]+(?:\s+|$)|\n+" with the first character in front, by which the search passes over others fast
_SENTENCE = re.compile(r"[.!?\n](?:(?<=\n)\n*|(?<!\n)[.!?]*(?:\s+|$))")
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
_INNER = re.compile(r"[^\w\s](?<=\w[^\w\s])[^\w\s]*\w")  # a mark first, so that the search passes over letters fast
_MARK = re.compile(r"\W")
_EDGE = "\"'“”„«»()[]{}<>,;:.!?¡¿-–—*_#|"


def sentences(text: str) -> list[list[str]]:
    """Distinct lower-case words by sentence, long ones in parts of SENTENCE_WORDS.

    Words spelled with spaces or marks between the letters are also added without those.
    """
    out = []
    for s in _SENTENCE.split(text.lower()):
        words = s.split()
        if words:
            if list(map(len, words)).count(1) > 2:
                words += [re.sub(r"\s", "", m) for m in _SPACED.findall(s)]
            if _INNER.search(s):
                words += [_MARK.sub("", w) for w in words if _INNER.search(w)]
            words = list(dict.fromkeys(words))
            out += [words[i:i + SENTENCE_WORDS] for i in range(0, len(words), SENTENCE_WORDS)]
    return out


def _code(ch: str) -> int:
    """0 for the word's start, 1..26 for plain Latin letters, 27..38 for other letters, 39 for everything else."""
    if "a" <= ch <= "z":
        return ord(ch) - 96
    if ch == _START[0]:
        return 0
    return 27 + ord(ch) % 12 if ch.isalpha() else 39


_UNSEEN = 255
_codes = np.full(0x110000, _UNSEEN, np.uint8)  # of each code point, once met


def _coded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _codes[points]
    if (out == _UNSEEN).any():
        for point in np.unique(points[out == _UNSEEN]).tolist():
            _codes[point] = _code(chr(point))
        out = _codes[points]
    return out


def _pieces(word: str) -> list[str]:
    word = word.strip(_EDGE)
    if len(word) <= LONGEST:
        return [word]
    return [word[i:i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def subsequences(length: int) -> tuple[np.ndarray, np.ndarray]:
    """(index triples, weights) of a word of ``length``, its start marks included; spans beyond SPAN weigh nearly nothing and are left out."""
    weight: dict[tuple[int, ...], float] = {}
    for c in itertools.combinations(range(length), _ORDER):
        if c[-1] - c[0] < SPAN:
            same = c if c[0] or c[1] == 1 else (1, *c[1:])  # both start marks with the same two characters
            weight[same] = weight.get(same, 0.0) + DECAY ** (c[-1] - c[0] + 1.0)
    return np.array(list(weight), np.int64).reshape(-1, _ORDER), np.array(list(weight.values()))


_PLANS = {n: subsequences(n) for n in range(LONGEST + len(_START) + 1)}


def word_features(words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word numbers, bucket of each subsequence, weights) per word length."""
    by: dict[int, list[int]] = {}
    words = [_START + w for w in words]
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, which in by.items():
        at, weight = _PLANS[n]
        if len(at):
            code = _coded("".join([words[i] for i in which])).astype(np.int32).reshape(-1, n)
            yield np.array(which), (code[:, at[:, 0]] * _CODES + code[:, at[:, 1]]) * _CODES + code[:, at[:, 2]], weight


def dense(words: Sequence[str]) -> np.ndarray:
    """Unit vectors in subsequence space, one row per word (zero rows for words under three characters)."""
    out = np.zeros((len(words), _CODES ** _ORDER), np.float32)
    for which, bucket, weight in word_features(words):
        np.add.at(out, (which[:, None], bucket), weight)
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out))[:, None], 1e-12)
    return out


def _merged(bucket: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket, weight) of the words' distinct subsequences; equal ones at several places add up."""
    key = bucket << _PLACE_BITS | np.arange(bucket.shape[1], dtype=np.int32)
    key.sort(1)
    b = key >> _PLACE_BITS
    new = np.ones(b.shape, bool)
    np.not_equal(b[:, 1:], b[:, :-1], out=new[:, 1:])
    first = np.flatnonzero(new)
    return first // b.shape[1], b.ravel()[first], np.add.reduceat(weight[key & (1 << _PLACE_BITS) - 1].ravel(), first)


def kernel(words: Sequence[str], table: Landmarks) -> np.ndarray:
    """word x landmark."""
    out = np.zeros((len(words), table.rows.shape[1]), np.float32)
    for which, buckets, weights in word_features(words):
        step = max(1, _BLOCK // buckets.shape[1])
        w32 = weights.astype(np.float32)
        for i in range(0, len(which), step):
            n = len(buckets[i:i + step])
            word, bucket, weight = _merged(buckets[i:i + step], w32)
            norm = np.sqrt(np.bincount(word, weight * weight, n))
            row = table.row_of[bucket]
            met = np.flatnonzero(row)  # subsequences that some landmark has; those of a word side by side, filled up with row 0
            word, row, weight = word[met], row[met], weight[met]
            count = np.bincount(word, minlength=n)
            place = np.arange(len(word)) - (np.cumsum(count) - count)[word]
            rows = np.zeros((n, int(count.max())), np.int32)
            rows[word, place] = row
            given = np.zeros(rows.shape, np.float32)
            given[word, place] = weight
            out[which[i:i + step]] = np.matmul(given[:, None, :], table.rows[rows])[:, 0] / norm[:, None]
    return np.square(np.square(out, out=out), out=out)


@dataclass
class Landmarks:
    """The landmarks' unit vectors by the buckets that any of them has; row 0 is zero."""
    row_of: np.ndarray  # bucket -> row
    rows: np.ndarray  # row x landmark

    @classmethod
    def of(cls, vectors: np.ndarray) -> Landmarks:
        used = np.flatnonzero(vectors.any(0))
        row_of = np.zeros(vectors.shape[1], np.int32)
        row_of[used] = np.arange(1, len(used) + 1)
        return cls(row_of, np.concatenate((np.zeros((1, len(vectors)), np.float32), vectors[:, used].T)))


@dataclass
class Machine:
    table: Landmarks
    beta: np.ndarray  # landmark weights of the decision
    bias: float
    slope: float
    offset: float
    picked: list[str]

    def word_values(self, words: Sequence[str]) -> np.ndarray:
        parts = [_pieces(w) for w in words]
        number = {p: i for i, p in enumerate(dict.fromkeys(p for x in parts for p in x))}  # words differ in their edges only, often
        value = (kernel(list(number), self.table) @ self.beta).astype(float)
        flat = np.fromiter((number[p] for x in parts for p in x), np.int64)
        return np.bincount(np.repeat(np.arange(len(words)), [len(x) for x in parts]), value[flat], len(words))

    def decide(self, docs: Sequence[str | None], cache: dict[str, float]) -> np.ndarray:
        split = [sentences(t or "") for t in docs]
        flat = [w for d in split for s in d for w in s]
        if len(cache) > _CACHE:
            cache.clear()
        found = list(map(cache.get, flat))
        new = list(dict.fromkeys(w for w, v in zip(flat, found) if v is None)) if None in found else []
        if new:
            cache.update(zip(new, self.word_values(new).tolist()))
            found = [cache[w] if v is None else v for w, v in zip(flat, found)]
        out = np.full(len(docs), self.bias)
        lengths = [len(s) for d in split for s in d]
        if lengths:
            value = np.array(found)
            first = np.cumsum(lengths) - lengths
            per = np.add.reduceat(value, first) + self.bias
            n = np.array([len(d) for d in split])
            some = np.flatnonzero(n)
            out[some] = np.maximum.reduceat(per, (np.cumsum(n) - n)[some])
        return out

    def score(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * FAR * np.tanh(decision / FAR) + self.offset)))


def _linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Squared hinge loss by Newton steps on the active rows."""
    z = np.concatenate((x, np.ones((len(x), 1))), 1)
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        on = y * (z @ w) < 1
        a = z[on] * weight[on, None]
        new = np.linalg.solve(ridge + SVM_COST * a.T @ z[on], SVM_COST * a.T @ y[on])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine | None:
    """Fit on at most TRAIN_DOCS documents of each class; ``labels`` holds the training rows only."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("y"))
    few = [r for c in (0, 1) for r in known.where(F.col("y") == c).orderBy(F.xxhash64("doc_id")).limit(TRAIN_DOCS).collect()]
    if not few:
        return None
    chosen = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in few], "doc_id long, y int"))  # bounded above
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(chosen, "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    split = [(sentences(r["text"] or ""), r["y"]) for r in rows]
    split = [(s, y) for s, y in split if s]
    if {y for _, y in split} != {0, 1}:
        return None
    return fit(split)


def surest_level(found: np.ndarray, chance: np.ndarray) -> float:
    """The lowest level that ``chance`` never reaches, or which ``found`` reaches so often that the times ``chance`` does, and one
    more, are CHANCE_SHARE of that at most."""
    levels = np.unique(found[np.isfinite(found)])
    above = len(found) - np.searchsorted(np.sort(found), levels)
    below = len(chance) - np.searchsorted(np.sort(chance), levels)
    good = levels[(below == 0) | (below + 1 <= CHANCE_SHARE * above)]
    return float(good.min()) if len(good) else np.inf


def fit(split: list[tuple[list[list[str]], int]]) -> Machine:
    """From documents as lists of sentences of words."""
    clean = {tuple(x) for s, y in split if y == 0 for x in s}
    met: set[tuple[str, ...]] = set()
    distinct = []
    for s, y in split:  # copies bring each sentence once; a sentence of a clean document is clean
        own = list(dict.fromkeys(t for t in map(tuple, s) if t not in met and not (y and t in clean)))
        met.update(own)
        if own:
            distinct.append((own, y))
    split = distinct
    n = np.array([sum(y == c for _, y in split) for c in (0, 1)], float) + 1
    # documents of each class that have a word, each between other neighbours than the documents before it
    seen: dict[str, list[int]] = {}
    places: set[tuple] = set()
    for s, y in split:
        own = set()
        for x in s:
            for i, word in enumerate(x):
                place = (word, x[i - 1] if i else "", x[i + 1] if i + 1 < len(x) else "", y)
                if place not in places:
                    places.add(place)
                    own.update(w for w in _pieces(word) if len(w) > 2)
        for w in own:
            seen.setdefault(w, [0, 0])[y] += 1
    every = list(seen)
    del places
    counts = np.array([seen[w] for w in every], float).reshape(-1, 2) + 0.5
    odds = np.log(counts[:, 1] / n[1] * n[0] / counts[:, 0])
    error = np.sqrt((1 / counts).sum(1))
    toxic_side, clean_side = (np.where(side >= np.log(MIN_LIFT), side - error, -np.inf) for side in (odds, -odds))
    level = surest_level(toxic_side, clean_side)
    gain = {every[i]: max(toxic_side[i], 0.01) * seen[every[i]][1] for i in np.flatnonzero(toxic_side >= level)}
    odds_of = dict(zip(every, odds.tolist()))
    telling = sorted(gain, key=lambda w: (-gain[w], w))[:CANDIDATES]
    usual = sorted(seen, key=lambda w: (-seen[w][0], w))[:CANDIDATES // 4]
    pool = list(dict.fromkeys([*telling, *usual]))
    vectors = dense(pool)
    gram = (vectors @ vectors.T).astype(float) ** 4
    worth = np.array([np.sqrt(max(gain.get(w, 0), 0)) + 1 for w in pool])
    rest, picked, low = gram.diagonal().copy(), [], np.zeros((len(pool), 0))
    told = np.array([w in gain for w in pool])
    ordinary = 0
    while len(picked) < len(pool):
        if ordinary == 0 and (len(picked) >= MOST - ORDINARY or len(picked) >= TELLING and not (told & (rest > 0.5)).any()):
            worth, ordinary = (~told).astype(float), len(picked) + ORDINARY  # the last ones stand for ordinary words
        if len(picked) == ordinary > 0:
            break
        i = int(np.argmax(rest * worth))
        if rest[i] * worth[i] < 1e-4:
            break
        col = (gram[:, i] - low @ low[i]) / np.sqrt(rest[i])
        low = np.concatenate((low, col[:, None]), 1)
        rest = np.maximum(rest - col ** 2, 0)
        picked.append(i)
    table = Landmarks.of(vectors[picked])
    del vectors
    values, turn = np.linalg.eigh(gram[np.ix_(picked, picked)] + 1e-6 * np.eye(len(picked)))
    nystrom = turn / np.sqrt(np.maximum(values, 1e-9)) @ turn.T

    every = sorted({w for s, _ in split for x in s for w in x})
    number = {w: i for i, w in enumerate(every)}
    per_word = np.zeros((len(every), len(picked)), np.float32)
    for i in range(0, len(every), _WORDS):  # a bounded number of words at a time
        parts = [_pieces(w) for w in every[i:i + _WORDS]]
        k = kernel([p for x in parts for p in x], table)
        per_word[i:i + _WORDS] = np.add.reduceat(k, np.cumsum([len(x) for x in parts]) - [len(x) for x in parts])
    rows = [x for s, _ in split for x in s]
    sizes = np.array([len(x) for x in rows])
    features = np.zeros((len(rows), len(picked)), np.float32)
    for i in range(0, len(rows), _WORDS // 8):
        some, size = rows[i:i + _WORDS // 8], sizes[i:i + _WORDS // 8]
        sums = np.add.reduceat(per_word[[number[w] for x in some for w in x]], np.cumsum(size) - size)
        features[i:i + len(some)] = sums @ nystrom
    del per_word
    of_doc = np.repeat(np.arange(len(split)), [len(s) for s, _ in split])
    y_doc = np.array([y for _, y in split])
    toxic = y_doc[of_doc] == 1
    hot = set(telling)
    mark = np.array([any(p in hot for w in x for p in _pieces(w)) for x in rows])
    # every toxic document starts with its marked sentences, or else with the one whose words have the highest log-odds
    worst = np.array([max((odds_of.get(p, 0.0) for w in x for p in _pieces(w)), default=0.0) for x in rows])
    top, marked = np.full(len(split), -np.inf), np.zeros(len(split), bool)
    np.maximum.at(top, of_doc, worst)
    np.logical_or.at(marked, of_doc, mark)
    positive = toxic & (mark | ~marked[of_doc] & (worst >= top[of_doc]))
    for _ in range(TURNS):
        use = positive | ~toxic
        y = np.where(positive[use], 1.0, -1.0)
        share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
        w, bias = _linear_svm(features[use], y, np.minimum(share, 20.0))
        f = features @ w + bias
        best = np.full(len(split), -np.inf)
        np.maximum.at(best, of_doc, f)
        positive = toxic & (f > 0) & ((f >= best[of_doc]) | mark)
    beta = nystrom @ w
    # Platt's line through the documents' decisions: a ridge-penalised logistic fit by Newton steps
    z = np.stack((np.clip(best, -FAR, FAR), np.ones(len(best))), 1)
    weight = np.where(y_doc == 1, 0.5 / max(1, (y_doc == 1).sum()), 0.5 / max(1, (y_doc == 0).sum())) * 200
    line = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ line)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (weight * (y_doc - p)) - 0.1 * line)
        line = line + step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
    return Machine(table, beta.astype(np.float32), bias, float(max(line[0], 1e-3)), float(line[1]), [pool[i] for i in picked])


def with_score(docs: DataFrame, model: Machine | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the landmarks' own subsequences, and a row number for each of 40^3 buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, {}
        for batch in batches:
            step = 200
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                score = np.zeros(part.num_rows) if m is None else m.score(m.decide(part.column(1).to_pylist(), cache))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
