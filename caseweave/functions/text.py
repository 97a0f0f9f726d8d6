"""Text expressions: cues, tokens, bigrams, shared phrases, identifiers, numbers."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .fixed_values import IDENTIFIER_PATTERN, STOP_PHRASES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def contains_any(text: Column | str, cues: Sequence[str]) -> Column:
    """True if the lower-cased text holds any cue as a substring; NULL text is empty."""
    return let(F.lower(F.coalesce(_col(text), F.lit(""))), lambda low: _holds(low, cues))


def _holds(low: Column, cues: Sequence[str]) -> Column:
    hit = F.lit(False)
    for cue in cues:
        hit = hit | low.contains(cue.lower())
    return hit


def cue_label(text: Column | str, table: Mapping[str, Sequence[str]]) -> Column:
    """Label of the first entry of ``table`` with a cue in the text, else NULL."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))  # once for all entries: texts may be long
    return let(low, lambda t: F.coalesce(*[F.when(_holds(t, cues), F.lit(label)) for label, cues in table.items()]))


def longest_contained(text: Column | str, options: Sequence[str]) -> Column:
    """The longest of a fixed list of options that occurs in the text, else NULL."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    ranked = sorted(options, key=len, reverse=True)
    return F.coalesce(*[F.when(low.contains(o.lower()), F.lit(o)) for o in ranked])


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def bigrams_of(words: Column) -> Column:
    """Distinct 'w1 w2' pairs of neighbouring words."""
    return let(words, lambda w: F.when(
        F.size(w) >= 2,
        F.array_distinct(F.zip_with(
            F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1),
            lambda a, b: F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>")))


def bigrams(text: Column | str) -> Column:
    return bigrams_of(tokens(text))


def shared_phrases(a: Column | str, b: Column | str, k: int = 3,
                   stop: Sequence[str] = STOP_PHRASES) -> Column:
    """Common bigrams without the stop phrases, longest first (text breaks ties), top k."""
    common = F.array_except(F.array_intersect(bigrams(a), bigrams(b)),
                            F.array(*[F.lit(s) for s in stop]))
    keyed = F.array_sort(F.transform(common, lambda p: F.struct((-F.length(p)).alias("k"), p.alias("p"))))
    return F.slice(F.transform(keyed, lambda s: s["p"]), 1, k)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct elements."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.when(
        F.size(a) + F.size(b) > 0, n / (F.size(a) + F.size(b) - n)).otherwise(F.lit(0.0)))


def identifiers(text: Column | str, pattern: str = IDENTIFIER_PATTERN) -> Column:
    """All identifiers in a text (digits and word borders are Unicode-aware)."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def numbers(text: Column | str) -> Column:
    """Numeric tokens of a text with the thousands separators removed."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"(?U)\d[\d,]*"), F.lit(0))
    return F.transform(found, lambda t: F.replace(t, F.lit(","), F.lit("")))


def grounded(answer: Column | str, value: Column | str, question: Column | str) -> Column:
    """True if every number in the answer is the value or occurs in the question."""
    allowed = F.concat(F.array(F.replace(_col(value).cast("string"), F.lit(","), F.lit(""))), numbers(question))
    return F.size(F.array_except(numbers(answer), allowed)) == 0


def clip(text: Column | str, length: int = 160) -> Column:
    """First ``length`` characters, NULL becomes empty."""
    return F.substring(F.coalesce(_col(text), F.lit("")), 1, length)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def extract_sql(message: Column | str) -> Column:
    """SQL inside a message: the first code fence if any, from the first WITH/SELECT on."""
    text = _strip(F.coalesce(_col(message), F.lit("")))
    fenced = F.regexp_extract(text, r"(?is)```(?:sql)?\s*(.+?)```", 1)
    body = F.when(F.length(fenced) > 0, _strip(fenced)).otherwise(text)
    start = F.regexp_extract(body, r"(?is)\b(?:WITH|SELECT)\b.*", 0)
    return F.regexp_replace(F.when(F.length(start) > 0, start).otherwise(body), r"\s*;*\s*$", "")
