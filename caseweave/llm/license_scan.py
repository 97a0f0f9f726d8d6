"""License notices in documents: MinHash bands over overlapping windows, then exact containment.

DataFrame functions only. Words are runs of letters and digits in lower case; shingles are
five words (a template of fewer words is one shingle of all its words). Templates are put
into classes by length. A class has windows of twice its longest template, starting every
half window, so each notice lies whole in some window, and window and template have
similarity of at least 0.19 if four fifths of the template are there. Forty bands of one
minimum each then collide with probability above 0.9997. Windows without any template
shingle have containment zero and need no minima.

A template may share most shingles with a relative (GPL of two versions, LGPL, AGPL). ``notices``
therefore asks, beside the containment, for a shingle of each phrase that tells a template from its
relatives, and drops a template at a window where another one explains all that it matches, and more.

Defined cases: null and empty texts have no notice; a notice met several times counts once,
with its best containment and, of equal ones, its first window; rows with equal ids count
as one document; an empty table gives an empty result.
"""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.lineage import cut
from .license_texts import TELLING, TEMPLATES
from .quality_rules import let

WIDTH = 5
CONTAINMENT = 0.8
BANDS = 40


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), "")


def _shingles(words: Column, width: int) -> Column:
    return F.when(F.size(words) < width, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])))


def _minima(window: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda j: F.array_min(F.transform(window, lambda x: F.xxhash64(x, j))))


def _told(body: str, phrases: tuple[str, ...]) -> list[list[int]]:
    """For each phrase the positions of the shingles that hold it."""
    w = re.sub(r"[\W_]+", " ", body.lower()).split()
    k = min(len(w), WIDTH)
    out = []
    for phrase in phrases:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        out.append(sorted({j for i in at for j in range(max(0, i + len(p) - k), min(i, len(w) - k) + 1)}))
        if not out[-1]:
            raise ValueError(f"no shingle of {body[:60]!r} holds {phrase!r}")
    return out


def templates(spark: SparkSession, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """(license, width, half, shingles, told): half is the class, a power of two of shingles; told holds the shingles of each telling phrase."""
    rows = [(k, v, _told(v, TELLING.get(k, ()) if TEMPLATES.get(k) == v else ())) for k, v in texts.items()]
    rows = spark.createDataFrame(rows, "license string, body string, at array<array<int>>")
    rows = rows.withColumn("w", _words(F.col("body"))).withColumn("width", F.least(F.size("w"), F.lit(WIDTH)))
    widths = [r[0] for r in rows.select("width").distinct().collect()]
    rows = rows.withColumn("all", F.coalesce(*[F.when(F.col("width") == k, _shingles(F.col("w"), k)) for k in widths]))
    return rows.withColumn("shingles", F.array_distinct("all")).withColumn(
        "half", F.pow(F.lit(2.0), F.ceil(F.log2(F.size("shingles").cast("double")))).cast("int")).select(
        "license", "width", "half", "shingles", F.transform("at", lambda g: F.transform(g, lambda j: F.get("all", j))).alias("told"))


def _needed(fixed: list, containment: float) -> dict[str, list[int]]:
    """For each template so many shingles, the rarest ones, that a window without any of them cannot reach ``containment``."""
    common = Counter((r["width"], h) for r in fixed for h in r["shingles"])
    return {r["license"]: sorted(r["shingles"], key=lambda h: (common[r["width"], h], h))[:int((1 - containment) * len(r["shingles"]) + 1e-9) + 1]
            for r in fixed}


def _literal(values: set[int]) -> Column:
    return F.lit(np.array(sorted(values), np.int64))


def hits(docs: DataFrame, texts: dict[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text",
         containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, word, half, width, containment, matched, told) of the windows that hold a template; rows may repeat."""
    known = cut(templates(docs.sparkSession, texts), "templates")
    fixed = known.collect()  # the dictionary, of fixed size
    needed = _needed(fixed, containment)
    of: dict[tuple[int, int], set[int]] = {}
    for r in fixed:
        of.setdefault((r["width"], r["half"]), set()).update(needed[r["license"]])
    widths = sorted({k for k, _ in of})
    found = docs.select(F.col(doc_id).alias("doc_id"), let(_words(F.col(text)), lambda w: F.struct(
        *[_shingles(w, k).alias(f"s{k}") for k in widths])).alias("s"))
    any_of = F.lit(False)
    for k in widths:
        any_of = any_of | F.arrays_overlap(F.col(f"s.s{k}"), _literal({h for (width, _), v in of.items() if width == k for h in v}))
    found = cut(found.where(any_of), "noticed")  # few documents; each class of windows reads them again
    windows = None
    for (width, half), values in sorted(of.items()):
        s = F.col(f"s.s{width}")
        cuts = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1, F.lit(half)))
        own = found.where(F.arrays_overlap(s, _literal(values))).select("doc_id", s.alias("s"), F.explode(cuts).alias("word")).select(
            "doc_id", "word", F.lit(width).alias("width"), F.lit(half).alias("half"),
            F.slice("s", F.col("word") + 1, F.lit(2 * half)).alias("window")).where(F.arrays_overlap("window", _literal(values)))
        windows = own if windows is None else windows.unionByName(own)
    bands = windows.select("doc_id", "word", "width", "half", "window", F.posexplode(_minima(F.col("window"))).alias("band", "least"))
    wanted = F.broadcast(known.select("license", "width", "half", F.posexplode(_minima(F.col("shingles"))).alias("band", "least")))
    # a window meets a template once, however many bands they share
    pairs = bands.join(wanted, ["width", "half", "band", "least"]).groupBy("doc_id", "word", "width", "half", "license").agg(
        F.first("window").alias("window"))
    pairs = pairs.join(F.broadcast(known.select("license", "shingles", "told")), "license")
    return pairs.withColumn("matched", F.array_intersect("shingles", "window")).select(
        "doc_id", "license", "word", "width", "half", (F.size("matched") / F.size("shingles")).alias("containment"), "matched",
        F.forall("told", lambda g: F.arrays_overlap(g, F.col("window"))).alias("told")).where(F.col("containment") >= containment)


def _best(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), F.max_by("word", F.struct("containment", -F.col("word"))).alias("word"))


def scan(docs: DataFrame, texts: dict[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text",
         containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, word) of every template that is held; word is the start of the window, counted from 0."""
    return _best(hits(docs, texts, doc_id, text, containment))


def notices(docs: DataFrame, texts: dict[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text",
            containment: float = CONTAINMENT) -> DataFrame:
    """As ``scan``, without templates that lack a telling phrase or of which another one on overlapping windows explains all and more."""
    found = cut(hits(docs, texts, doc_id, text, containment).where("told").drop("told"), "hits")
    known = {r["license"]: (r["width"], set(r["shingles"])) for r in templates(docs.sparkSession, texts).collect()}
    rivals = [(a, b) for a, (wa, x) in known.items() for b, (wb, y) in known.items()
              if a != b and wa == wb and len(y) > containment * len(x) and len(x & y) >= containment * len(x)]
    if not rivals:
        return _best(found)
    rivals = F.broadcast(docs.sparkSession.createDataFrame(rivals, "license string, by string"))
    other = found.select(F.col("doc_id").alias("d"), F.col("license").alias("by"), F.col("word").alias("w"), F.col("half").alias("h"),
                         F.col("matched").alias("all"))
    beaten = found.join(rivals, "license").join(other, "by").where(
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("word") < F.col("w") + 2 * F.col("h")) & (F.col("w") < F.col("word") + 2 * F.col("half"))
        & (F.size("all") > F.size("matched")) & (F.size(F.array_except("matched", "all")) == 0)).select(
        F.col("doc_id").alias("d"), F.col("license").alias("l"), F.col("word").alias("w")).distinct()
    return _best(found.join(beaten, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("license") == F.col("l")) & (F.col("word") == F.col("w")), "left_anti"))
