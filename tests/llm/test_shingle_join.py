"""Operator 12 against all pairs of sets."""
from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.llm import shingle_join as sj


def plain_sets(texts, width=5):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def plain(rows, percent=80, width=5):
    sets = plain_sets([t for _, t in rows], width)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                c = len(sets[i] & sets[j])
                if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                    up[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def chains(seed):
    """Texts that differ from the one before by a few words, among texts that share long passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    texts = []
    for _ in range(14):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([6, 9, 14, 40, 150]))]
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(w))
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                k = rng.randrange(len(w))
                w = w[:k] + [rng.choice(vocabulary)] * rng.randint(0, 2) + w[k + 1:]
    for _ in range(60):  # mostly the passage: many keys in common, few links
        texts.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(2, 22))]))
    for _ in range(25):  # assembled from shared parts, so that no shingle is rare
        parts = [passage[i:i + 14] for i in range(0, 70, 14)]
        rng.shuffle(parts)
        texts.append(" ".join(sum(parts, [])))
    rng.shuffle(texts)
    return list(enumerate(texts))


def result(spark, rows, **kw):
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, node int, n int, h string").repartition(3)
    out, links = sj.join_documents(docs, **kw)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, out.collect()), key=str), links


@pytest.mark.parametrize("percent,tile", [(80, 512), (80, 2), (60, 7), (95, 3)])
def test_components_equal_all_pairs(spark, percent, tile):
    rows = chains(percent + tile)
    got, _ = result(spark, rows, percent=percent, tile=tile)
    assert got == sorted(plain(rows, percent), key=str)


def test_odd_rows_and_empty_tables(spark):
    odd = [None, "", " \n\t ", "one", "ONE", "öne", "Öne", "one two three four", "One two THREE four", "a b c d e f g h", "a b c d e f g h",
           "a\tb\x0bc d  e f g h", "x" * 50_000, "ab " * 3000, "AB " * 2999, "日本語 \U0001F600 ok."]
    rows = [*enumerate(odd), (5, "one"), (5, "one"), (None, "one"), (None, "nobody else"), (None, "nobody ELSE"), (None, None)]
    got, _ = result(spark, rows)
    assert got == sorted(plain(rows), key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sj.join_documents(empty)[0].count() == 0


def test_links_are_exact_and_keys_stay_few_for_copies(spark):
    rows = chains(3)
    _, links = result(spark, rows)
    sets = {frozenset(s) for s in plain_sets([t for _, t in rows])}
    sizes = sorted((len(a & b), len(a | b)) for a in sets for b in sets if a is not b and a and 100 * len(a & b) >= 80 * len(a | b))
    got = [(r["common"], r["together"]) for r in links.collect()]
    assert got and all(p in sizes for p in got)
    crowd = [(i, " ".join(f"q{j}" for j in range(200) if j not in (i % 190, i % 7))) for i in range(400)]
    out, links = result(spark, crowd)
    assert {c for _, _, c in out} == {0} and links.count() < 6 * len(crowd)


def test_bitmaps_never_lose_a_link():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(3, 900)).astype(np.uint64) * np.uint64(3))
        cut = rng.integers(0, max(1, len(a) // 6) + 1)
        b = np.unique(np.concatenate((a[cut:], rng.integers(0, 1 << 62, rng.integers(0, max(1, len(a) // 8) + 1)).astype(np.uint64))))
        c = len(np.intersect1d(a, b))
        masks = [sj.bitmap(x, np.array([0, len(x)]), sj.bits_for(len(x))) for x in (a, b)]
        may = sj.may_link(np.array([len(a)]), masks[0], np.array([len(b)]), masks[1], 80)[0, 0]
        assert may or 100 * c < 80 * (len(a) + len(b) - c)


def test_bands(spark):
    n = [r["b"] for r in spark.range(1, 3000).select(sj.band_of(F.col("id"), 80).alias("b")).collect()]
    for small in (1, 4, 5, 17, 99, 100, 640):
        for large in range(small, 2999):
            if 100 * small >= 80 * large:
                assert n[large - 1] - n[small - 1] in (0, 1)
