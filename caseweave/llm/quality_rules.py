"""Quality rules whose limits come from mergeable quantile sketches per language and source.

DataFrame functions only. Defined cases: null text has no words and fails; an empty table
gives an empty result; null languages and sources form groups of their own; repeated rows
are judged one by one; extra columns, whatever their names, pass through ``filter_documents``.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import cut
from .arrow_text import free_name

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
_BREAKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SKETCH_K = 400
#: A group's own limits weigh n / (n + SHRINK); the rest is its language's, which lean on all documents in the same way.
SHRINK = 20
#: Chance deviations of a count, in its standard errors.
ERRORS = 3
SPREAD = 4.0


@dataclass(frozen=True)
class Fence:
    """How the limits of a ratio follow from the sketch of its group.

    Without ``counts``: quartile -/+ SPREAD * interquartile range. With it the ratio is a share of that measure, and
    junk only raises it: the limit is the upper quartile of the lower half mirrored at the median plus SPREAD times
    its width, which junk in under half of a group cannot move, and a document gets ERRORS standard errors of a
    count of that size more, where one event of chance makes ``unit`` of the counted. Long texts repeat themselves
    more than by chance, so beyond ``long`` the error gets no smaller.
    """
    counts: str | None = None
    unit: int = 1
    long: int = 4 * MIN_WORDS


#: A repeated window of three words is one event; 25 lines of eight words make 200 words.
FENCES: Mapping[str, Fence] = {
    "mean_word": Fence(),
    "symbol_ratio": Fence("n_words"),
    "dup_line_ratio": Fence("n_lines", long=25),
    "repeat_ratio": Fence("n_words", unit=3),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also if it is read inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words which the text holds twice or more.

    Windows are sorted by hash, so equal ones are neighbours; then their positions are
    sorted and the lengths they newly cover are summed: n log n steps for any text.
    """
    def hashes(w: Column) -> Column:
        return F.when(F.size(w) >= width, F.transform(
            F.sequence(F.lit(0), F.size(w) - width),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))

    def repeated(s: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        return F.sort_array(F.transform(
            F.filter(s, lambda e, i: same(e, F.get(s, i - 1)) | same(e, F.get(s, i + 1))), lambda e: e["p"]))

    def total(p: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-width).cast("bigint").alias("end"))
        return F.aggregate(p, zero, lambda acc, x: F.struct(
            (acc["n"] + F.least(F.lit(width).cast("bigint"), x + width - acc["end"])).alias("n"),
            (x + width).cast("bigint").alias("end")), lambda acc: acc["n"])

    def of(h: Column) -> Column:
        marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(
            total(let(marked, repeated)))

    return let(hashes(words), of)


def measures(text: Column) -> Column:
    """The counts of one text as a struct; null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)),
                lambda v: F.struct(F.size(v).cast("bigint").alias("n"),
                                   (F.size(v) - F.size(F.array_distinct(v))).cast("bigint").alias("dup")))
    words = let(F.array_remove(F.split(t, GAP), ""),
                lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _covered(w).alias("repeat")))
    long = lambda c: c.cast("bigint")
    return let(F.struct(words.alias("w"), lines.alias("l")), lambda m: F.struct(
        m["w"]["n"].alias("n_words"), long(F.length(F.translate(t, _BREAKS, ""))).alias("word_chars"),
        long(F.length(t) - F.length(F.translate(t, _SYMBOLS, ""))).alias("n_symbols"), m["l"]["dup"].alias("n_dup_lines"),
        m["w"]["repeat"].alias("n_repeat_words"), m["l"]["n"].alias("n_lines")))


def _ratios(m: str) -> dict[str, Column]:
    n = F.greatest(F.col(f"{m}.n_words"), F.lit(1))
    return {"mean_word": F.col(f"{m}.word_chars") / n, "symbol_ratio": F.col(f"{m}.n_symbols") / n,
            "dup_line_ratio": F.col(f"{m}.n_dup_lines") / F.greatest(F.col(f"{m}.n_lines"), F.lit(1)),
            "repeat_ratio": F.col(f"{m}.n_repeat_words") / n}


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (
        100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}.n_words"))


def sketches(measured: DataFrame, m: str, lang: str, source: str) -> DataFrame:
    """(lang, source, n, one sketch per ratio) of the documents that pass the base rules.

    Sketches merge: tables of several days can be united with ``kll_merge_agg_double``.
    """
    ratios = _ratios(m)
    return measured.where(~base_failed(m)).groupBy(F.col(lang).alias("lang"), F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.kll_sketch_agg_double(v.cast("double"), SKETCH_K).alias(k) for k, v in ratios.items()])


def limits(by_group: DataFrame) -> DataFrame:
    """(lang, source, limits), each group's own drawn towards those of its language and of all documents.

    ``by_group`` should be a table. The limits over all documents, one row of numbers, pass as literals.
    """
    def merged(*keys: str) -> DataFrame:
        return by_group.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(k).alias(k) for k in FENCES])

    def fences(df: DataFrame, name: str, *keys: str) -> DataFrame:
        q = lambda k, at: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(F.col(k), F.lit(at)))
        parts = []
        for k, f in FENCES.items():
            if f.counts:
                half = q(k, 0.5) - q(k, 0.25)
                low, high = F.lit(None).cast("double"), q(k, 0.5) + half + 2 * SPREAD * half
            else:
                wide = SPREAD * (q(k, 0.75) - q(k, 0.25))
                low, high = q(k, 0.25) - wide, q(k, 0.75) + wide
            parts += [high.alias(f"{k}_high"), low.alias(f"{k}_low")]
        return df.select(*keys, F.col("n").alias(f"{name}_n"), F.struct(*parts).alias(name))

    def drawn(name: str, wider: Column) -> Column:
        share = F.col(f"{name}_n") / (F.col(f"{name}_n") + SHRINK)
        return F.struct(*[(share * F.col(f"{name}.{k}") + (1 - share) * wider[k]).alias(k)
                          for k in (f"{r}_{side}" for r in FENCES for side in ("high", "low"))])

    own = fences(by_group, "own", "lang", "source")
    per_lang = fences(merged("lang"), "per_lang", F.col("lang").alias("lang2"))
    row = fences(merged(), "every").select("every.*").first()  # nulls if no document passes the base rules
    every = F.struct(*[F.lit(v).cast("double").alias(k) for k, v in row.asDict().items()])
    joined = own.join(per_lang, F.col("lang").eqNullSafe(F.col("lang2"))).withColumn("per_lang", drawn("per_lang", every))
    return joined.select("lang", "source", drawn("own", F.col("per_lang")).alias("limits"))


def verdicts(m: str, limit: str) -> dict[str, Column]:
    """Per ratio, whether a document's lies within the limits of its group; null without limits."""
    out = {}
    for k, v in _ratios(m).items():
        f, high = FENCES[k], F.col(f"{limit}.{k}_high")
        if f.counts:
            each = f.unit / F.least(F.greatest(F.col(f"{m}.{f.counts}"), F.lit(1)), F.lit(f.long))
            out[k] = v <= high + ERRORS * F.sqrt(high * each) + ERRORS * ERRORS * each
        else:
            out[k] = (v <= high) & (v >= F.col(f"{limit}.{k}_low"))
    return out


def judge(measured: DataFrame, m: str = "m", lang: str = "lang", source: str = "source",
          failed: str = "base_failed", kept: str = "kept") -> DataFrame:
    """``measured`` with ``failed`` and ``kept``. ``measured`` should be a table: it is read twice.

    The limits (a row per group) are written first, so Spark joins them by their real size.
    """
    table = cut(limits(cut(sketches(measured, m, lang, source), "sketches")), "limits").select(
        F.col("lang").alias("_l_lang"), F.col("source").alias("_l_source"), F.col("limits").alias("_l"))
    inside = reduce(lambda a, b: a & b, verdicts(m, "_l").values())
    joined = measured.join(table, measured[lang].eqNullSafe(F.col("_l_lang")) & measured[source].eqNullSafe(F.col("_l_source")), "left")
    return joined.withColumns({failed: base_failed(m), kept: ~base_failed(m) & F.coalesce(inside, F.lit(False))}).drop(
        "_l", "_l_lang", "_l_source")


def measure_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                      source: str = "source") -> DataFrame:
    """(doc_id, lang, source, m) as a written table."""
    return cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"),
                           measures(F.col(text)).alias("m")), "quality")


def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged.

    Rows are written once beside their counts, so texts are neither counted twice nor shuffled.
    """
    row = free_name(docs, "row")
    measured = cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(lang).alias("lang"),
                               F.col(source).alias("source"), measures(F.col(text)).alias("m")), "quality")
    return judge(measured).where("kept").select(f"{row}.*")
