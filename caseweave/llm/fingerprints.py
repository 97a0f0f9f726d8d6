"""Winnowed document fingerprints, and the likeness of each document to its neighbour.

DataFrame functions only. Every run of sixteen code points is hashed, read at its place in
the text's fixed-width form, so spaces play no part and any script is treated alike; each
window of 32 such hashes keeps its smallest, of equal ones the rightmost, with its position.
Texts that share 47 code points in a row share a print.

Defined cases: null counts as empty; an empty text has no print, and two such texts have
likeness 1; a text of fewer than 16 code points has one hash, of fewer than 32 hashes
one print; equal ids are ordered by text; null ids come last; the last document's neighbour
is the first; a single document is its own; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.lineage import cut
from .quality_rules import let

GRAM = 16
WINDOW = 32
#: Bytes of a code point in UTF-32.
_WIDTH = 4
#: Ids are cut at so many quantiles, each of those evenly into buckets of about so many rows.
QUANTILES = 256
BUCKET_ROWS = 4096
#: Buckets are put in order within spans of so many numbers, then the spans among themselves.
SPAN = 4096

_POSITION_BITS = 31
_LAST = (1 << _POSITION_BITS) - 1


def _minima(values: Column, width: int) -> Column:
    """Minimum of every ``width`` (a power of two) neighbours; fewer values than that have one.

    Each step combines the values with themselves moved left. The shorter array is filled up
    with nulls, which are not smaller, so the last windows are cut short and go at the end.
    """
    def with_moved(by: int):
        return lambda v: F.zip_with(v, F.slice(v, F.lit(by + 1), F.size(v)), lambda a, b: F.when(b < a, b).otherwise(a))

    step = 1
    while step < width:
        values = let(values, with_moved(step))
        step *= 2
    return let(values, lambda v: F.slice(v, F.lit(1), F.greatest(F.size(v) - (width - 1), F.lit(1))))


def prints(text: Column) -> Column:
    """array<bigint> of 32 bits of hash above the code point's position counted down from 2^31 - 1."""
    def packed(points: Column) -> Column:
        n = F.octet_length(points)
        starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(
            F.sequence(F.lit(1), F.greatest(n - (GRAM * _WIDTH - 1), F.lit(1)), F.lit(_WIDTH)))
        return F.transform(starts, lambda at, i: F.shiftleft(
            F.xxhash64(F.substring(points, at, F.lit(GRAM * _WIDTH))).bitwiseAND(F.lit(0xFFFFFFFF)),
            _POSITION_BITS).bitwiseOR(F.lit(_LAST) - i))

    return let(F.encode(F.coalesce(text, F.lit("")), "UTF-32"), lambda points: F.array_distinct(_minima(packed(points), WINDOW)))


def hash_of(p: Column) -> Column:
    return F.shiftright(p, _POSITION_BITS)


def position_of(p: Column) -> Column:
    return F.lit(_LAST) - p.bitwiseAND(F.lit(_LAST))


def hashes(chosen: Column) -> Column:
    """The distinct hashes of prints, as 32-bit numbers."""
    return F.array_distinct(F.transform(chosen, lambda p: (hash_of(p) - F.lit(1 << 31)).cast("int")))


def digest(chosen: Column) -> Column:
    """Prints with their positions as 32 hex digits."""
    half = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), chosen))), 16, "0")
    return F.concat(half(1), half(2))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    return let(F.struct(F.size(F.array_intersect(a, b)).alias("both"), (F.size(a) + F.size(b)).alias("sum")), lambda n: F.when(
        n["sum"] == 0, F.lit(1.0)).otherwise(n["both"] / F.greatest(n["sum"] - n["both"], F.lit(1))))


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, prints): prints as array of (hash, position), in text order."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.transform(prints(F.col(text)), lambda p: F.struct(
        hash_of(p).alias("hash"), position_of(p).alias("position"))).alias("prints"))


def _bucket(rows: DataFrame) -> Column:
    """A number that rises with the id; about BUCKET_ROWS ids share one. Null ids have the least."""
    got = rows.agg(F.count("doc_id").alias("n"), F.percentile_approx(
        "doc_id", [i / QUANTILES for i in range(QUANTILES)], 10 * QUANTILES).alias("q"), F.max("doc_id").alias("top")).first()
    if not got["n"]:
        return F.lit(-1).cast("bigint")
    bounds = sorted(set(got["q"]))
    parts = max(1, -(-got["n"] // (QUANTILES * BUCKET_ROWS)))
    place = F.size(F.filter(F.array(*[F.lit(b).cast("bigint") for b in bounds]), lambda b: b <= F.col("doc_id"))).cast("bigint")
    if parts > 1:
        edges = F.array(*[F.lit(b).cast("double") for b in [bounds[0], *bounds, got["top"] + 1]])
        lo, hi = F.get(edges, (place).cast("int")), F.get(edges, (place + 1).cast("int"))
        share = F.floor((F.col("doc_id") - lo) / F.greatest(hi - lo, F.lit(1.0)) * parts)
        place = place * parts + F.least(F.greatest(share, F.lit(0)), F.lit(parts - 1))
    return F.when(F.col("doc_id").isNull(), F.lit(-1).cast("bigint")).otherwise(place)


def _following(heads: DataFrame) -> DataFrame:
    """(head, to): the bucket after each head's own, and after the last the first.

    Only the first bucket of each span, one row in up to SPAN, is put in one order.
    """
    spans = heads.withColumn("span", F.floor(F.col("bucket") / SPAN))
    along = Window.orderBy("span")
    first = spans.groupBy("span").agg(F.min("bucket").alias("first"))
    after = first.select("span", F.coalesce(F.lead("first").over(along), F.min("first").over(Window.partitionBy())).alias("after"))
    inside = spans.withColumn("to", F.lead("bucket").over(Window.partitionBy("span").orderBy("bucket")))
    return inside.join(after, "span").select("head", F.coalesce("to", "after").alias("to"))


def with_next(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows (doc_id, text) with ``columns`` and, under next, those of the row that follows by falling id.

    Rows are bucketed by id, so one shuffle sorts them. Each bucket also gets a copy of the
    first row of the following bucket; those few rows are found by their ids.
    """
    rows = rows.withColumn("bucket", _bucket(rows))
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    guests = cut(_following(cut(heads, "heads")), "guests")
    moved = rows.join(guests, rows["doc_id"].eqNullSafe(guests["head"])).select(
        "doc_id", "text", F.col("to").alias("bucket"), F.lit(1).alias("guest"))
    every = rows.select("doc_id", "text", "bucket", F.lit(0).alias("guest")).unionByName(moved).withColumns(columns)
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in ["text", *columns]]
    return every.select("*", *following).where("guest = 0").drop("bucket", "guest")


def neighbour_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its prints' digest, those of its edited text, and the likenesses.

    The edited text keeps the first half (rounded up) and goes on with the following document.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = let(prints(F.col("text")), lambda p: F.struct(digest(p).alias("digest"), hashes(p).alias("hashes")))
    both = with_next(rows, {"print": made})
    n = F.length("text").cast("bigint")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n.cast("int") - half), F.substring("next_text", F.lit(1), half))
    out = both.select("doc_id", n.alias("n_chars"), edited.alias("edited"), "print", F.col("next_print.hashes").alias("next_hashes"))
    second = let(F.col("edited"), lambda e: let(prints(e), lambda p: F.struct(
        F.sha2(e, 256).alias("sha"), digest(p).alias("digest"), hashes(p).alias("hashes"))))
    return out.select("doc_id", "n_chars", "print", "next_hashes", second.alias("e")).select(
        "doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), F.col("print.digest").alias("fingerprint"),
        F.col("e.digest").alias("edited_fingerprint"), likeness(F.col("print.hashes"), F.col("e.hashes")).alias("near_edited"),
        likeness(F.col("print.hashes"), F.col("next_hashes")).alias("near_next"))
