"""Record linkage: features, candidate pairs, scores, series and their evidence.

Pairs are proposed by equality only: block, features, a date bucket and a place cell. The
score threshold says which sets of features may differ and how far apart a pair may then
lie; each such pattern is one join on all other features, and no pair fits two patterns.
All keys are exact consequences of the limits and the threshold, so no candidate is lost
and no block is compared all against all. Rows of a crowded cell are dealt over a grid.
"""
from __future__ import annotations

import collections
import functools
import hashlib
import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import fixed_values as fx, geo, temporal as tm, text as tx, vectors as vec
from ..functions.rounding import python_round
from ..plans.lineage import cut
from ..sources import snapshots
from . import dense_links
from .clusters import thinned
from .neighbours import knn
from .ranking import numbered, top_k_per_group
from .score import refuse_denied


@dataclass(frozen=True)
class Fields:
    """Column names of a linkable table."""
    key: str = "case_id"
    block: str = "crime_sub_head"
    date: str = "registered"
    lat: str = "latitude"
    lon: str = "longitude"
    vector: str = "embedding"
    features: Sequence[str] = ("vehicle", "target", "tod", "dow")


@dataclass(frozen=True)
class Rules:
    weights: Mapping[str, float] = field(default_factory=lambda: dict(fx.LINK_WEIGHTS))
    max_days: int = fx.LINK_MAX_DAYS
    max_km: float = fx.LINK_MAX_KM
    scale_km: float = fx.LINK_GEO_SCALE_KM
    min_block: int = fx.CLUSTER_MIN_SIZE


def extract_features(df: DataFrame, text: str, ts: str, lat: str, lon: str, resolution: int = 8,
                     name: str = "features") -> DataFrame:
    """Structured features of a narrative as one struct column."""
    return df.withColumn(name, F.struct(
        tm.tod_bucket(tm.hour_or_zero(ts)).alias("tod_bucket"), tm.weekday_or_zero(ts).alias("dow"),
        geo.hex_cell(lat, lon, resolution).alias("cell"), tx.cue_label(text, fx.WEAPON_CUES).alias("weapon"),
        tx.cue_label(text, fx.VEHICLE_CUES).alias("vehicle"), tx.cue_label(text, fx.ENTRY_CUES).alias("entry"),
        tx.cue_label(text, fx.TARGET_CUES).alias("target")))


#: Grams whose buckets a task keeps, some 50 MB.
KNOWN_GRAMS = 1 << 18


def gram_counts(text: Column | str, dim: int, n: int) -> Column:
    """Array of (bucket, count) of a text's lower-case character n-grams; empty for null or shorter texts.

    The bucket is the first eight hex digits of the md5 of a gram modulo ``dim``, which any
    engine can repeat. Grams of a text are counted first and each distinct one is hashed once;
    a task remembers the buckets of its last ``KNOWN_GRAMS`` grams.
    """
    known = KNOWN_GRAMS

    @F.arrow_udf("array<struct<bucket:int,count:int>>")
    def counted(texts: pa.Array) -> pa.Array:
        @functools.lru_cache(known)
        def bucket(gram: tuple[str, ...]) -> int:
            return int(hashlib.md5("".join(gram).encode()).hexdigest()[:8], 16) % dim

        ends, buckets, counts = [0], [], []
        for text in texts:
            value, found = text.as_py(), collections.Counter()
            for gram, times in collections.Counter(zip(*[value[k:] for k in range(n)])).items():
                found[bucket(gram)] += times
            for b in sorted(found):
                buckets.append(b)
                counts.append(found[b])
            ends.append(len(buckets))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(buckets, pa.int32()), pa.array(counts, pa.int32())], ["bucket", "count"]))

    return counted(F.lower(F.coalesce(tx._col(text), F.lit(""))))


def text_vectors(df: DataFrame, text: str, dim: int = 256, n: int = 3, name: str = "embedding") -> DataFrame:
    """Unit vectors of hashed character n-grams weighted by inverse document frequency.

    Stands in for a sentence model: any column of equal-length arrays serves the operators.
    A count is weighted by ln((rows + 1) / (rows with the bucket + 1)); a text without grams,
    or with none but those of every text, has the zero vector. Vectors stay sparse until
    the last step; the frequencies are one row of at most ``dim`` entries.
    """
    staged = cut(df.withColumn("_grams", gram_counts(text, dim, n)), "term-counts")  # read twice: for the frequencies and for the weights
    rows = staged.agg(F.count(F.lit(1))).scalar()
    found = staged.select(F.explode("_grams.bucket").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("df"))
    idf = found.select("b", F.log((rows + 1) / (F.col("df") + 1)).alias("w"))
    listed = idf.agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"))
    table = listed.select(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)))).scalar()
    zeros = lambda count: F.array_repeat(F.lit(0.0), count)

    def unit(w: Column) -> Column:
        length = F.sqrt(F.aggregate(w, F.lit(0.0), lambda acc, g: acc + g["w"] * g["w"]))
        return tx.let(length, lambda n: F.transform(w, lambda g: F.struct(g["bucket"].alias("bucket"), F.when(n > 0, g["w"] / n).otherwise(0.0).alias("w"))))

    def filled(w: Column) -> Column:
        """Buckets are in order, so the zeros between two of them are a run."""
        before = lambda j: F.coalesce(F.get(w, j)["bucket"], F.lit(-1))
        parts = F.transform(w, lambda g, j: F.concat(zeros(g["bucket"] - before(j - 1) - 1), F.array(g["w"])))
        return F.concat(F.flatten(parts), zeros(dim - 1 - before(F.size(w) - 1)))

    weighted = tx.let(F.col("_idf"), lambda idf: F.transform("_grams", lambda g: F.struct(g["bucket"].alias("bucket"), (g["count"] * idf[g["bucket"]]).alias("w"))))
    return staged.withColumn("_idf", table).select(*df.columns, tx.let(tx.let(weighted, unit), filled).alias(name))


def blocks_of_size(df: DataFrame, block: str, low: int) -> DataFrame:
    """Rows of blocks with at least ``low`` rows."""
    sizes = df.groupBy(block).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(sizes.where(F.col("_n") >= low).select(block), block, "left_semi")


def _present(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def _match(a: Column, b: Column) -> Column:
    return F.coalesce((_present(a) == _present(b)).cast("double"), F.lit(0.0))


@dataclass(frozen=True)
class Pattern:
    """Features in which a pair agrees and differs, and the distance up to which it can reach the threshold then."""
    same: tuple[str, ...]
    differ: tuple[str, ...]
    km: float


def mismatch_patterns(rules: Rules, features: Sequence[str], threshold: float) -> list[Pattern]:
    """The disjoint patterns that together hold every pair that can reach the threshold.

    A feature without weight decides nothing and is in no pattern. Two patterns of one
    distance that differ in a single feature become one that does not look at it, so where
    the threshold rules out nothing one pattern without features remains.
    """
    weighed = [f for f in features if rules.weights.get(f, 0.0) > 0]
    total = sum(rules.weights.values())
    found = []
    for n in range(len(weighed) + 1):
        for differ in itertools.combinations(weighed, n):
            lost = sum(rules.weights[f] for f in differ)
            if total - lost >= threshold - 1e-9:
                found.append(Pattern(tuple(f for f in weighed if f not in differ), differ, _reach_km(rules, threshold + lost)))
    for f in weighed:
        merged = []
        for p in found:
            twin = next((x for x in found if x.km == p.km and set(x.differ) ^ set(p.differ) == {f} and set(x.same) ^ set(p.same) == {f}), None)
            p = p if twin is None else Pattern(tuple(x for x in p.same if x != f), tuple(x for x in p.differ if x != f), p.km)
            if p not in merged:
                merged.append(p)
        found = merged
    return found


def _reach_km(rules: Rules, threshold: float) -> float:
    """The largest distance at which the threshold can still be met."""
    w = rules.weights.get("geo", 0.0)
    if w <= 0:
        return rules.max_km
    slack = (sum(rules.weights.values()) - threshold) / w
    return rules.max_km if slack >= 1 else min(rules.max_km, max(0.001, slack * rules.scale_km * (1 + 1e-9)))


#: Rows of one cell that one task of a join takes.
CELL_ROWS = 16384
#: Cells are this many times as wide as a pattern's distance, and at least this many kilometres.
CELL_WIDTHS, CELL_KM = 2.0, 0.1


def _gridded(early: DataFrame, late: DataFrame, early_key: Sequence[str], late_key: Sequence[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``part``: late rows of a cell with more than ``rows`` are dealt over parts of about that
    many, and its early rows go to each part.

    Only crowded cells are listed, at most one in ``rows`` of the rows, so the list is sent to the tasks and no side is
    shuffled for it.
    """
    crowded = late.groupBy(*late_key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)
    crowded = cut(crowded.select(*late_key, F.ceil(F.col("n") / rows).cast("int").alias("parts")), "crowded")
    if crowded.isEmpty():
        return early.withColumn("part", F.lit(0)), late.withColumn("part", F.lit(0))
    there = crowded.select(*[F.col(c).alias(e) for c, e in zip(late_key, early_key)], "parts")
    parts = F.coalesce("parts", F.lit(1))
    dealt = late.join(F.broadcast(crowded), list(late_key), "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")
    copied = early.join(F.broadcast(there), list(early_key), "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return copied, dealt


def _pattern_pairs(rows: DataFrame, pattern: Pattern, features: Sequence[str], rules: Rules, cell_rows: int) -> DataFrame:
    """Pairs of one pattern: both records carry block, shared features, date bucket (as wide as the day limit) and cell (twice
    as wide as the pattern's distance); the earlier one looks into its own and the next bucket and into the cells its circle touches."""
    early, late, shared = _sides(rows, pattern)
    early, late = _gridded(early, late, [*shared, "look"], [*shared, "bucket"], cell_rows)
    return _joined(early, late, [*shared, "part"], pattern, features, rules, "_v" in rows.columns)


def _sides(rows: DataFrame, pattern: Pattern) -> tuple[DataFrame, DataFrame, list[str]]:
    """(early, late, columns both must share): ``home`` tells an early record in its own bucket and cell."""
    for f in pattern.same:
        rows = rows.where(_present(F.col(f)).isNotNull())
    wide = max(CELL_WIDTHS, CELL_KM / pattern.km) if pattern.km > 0 else CELL_WIDTHS
    late = rows.withColumn("cell", geo.tile_key("lat", "lon", pattern.km, wide))
    early = (late.withColumnRenamed("cell", "_own").withColumn("cell", F.explode(geo.tile_probe_keys("lat", "lon", pattern.km, wide)))
             .withColumn("look", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
             .withColumn("home", (F.col("cell") == F.col("_own")) & (F.col("look") == F.col("bucket"))).drop("_own"))
    return early, late, ["block", "cell", *pattern.same]


def _joined(early: DataFrame, late: DataFrame, shared: Sequence[str], pattern: Pattern, features: Sequence[str], rules: Rules, vectors: bool) -> DataFrame:
    cond = (F.col("l.look") == F.col("r.bucket")) & ((F.col("l.bucket") < F.col("r.bucket")) | (F.col("l.id") < F.col("r.id")))
    for c in shared:
        cond = cond & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    for f in pattern.differ:
        cond = cond & (_match(F.col(f"l.{f}"), F.col(f"r.{f}")) == 0.0)
    cond = cond & (F.abs(F.col("l.lat") - F.col("r.lat")) <= geo.lat_reach(pattern.km))  # before the dearer distance
    gap = F.abs(F.datediff("l.day", "r.day"))
    # few input bytes can make very many pairs: both sides are always dealt out by key, never broadcast
    joined = early.alias("l").join(late.alias("r").hint("merge"), cond & (gap <= rules.max_days))
    carried = []
    if vectors:
        swap = F.col("l.id") > F.col("r.id")
        carried = [F.when(swap, F.col("r._v")).otherwise(F.col("l._v")).alias("_va"), F.when(swap, F.col("l._v")).otherwise(F.col("r._v")).alias("_vb")]
    out = joined.select(
        F.col("l.block").alias("block"), F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"),
        gap.alias("days"), geo.haversine_km("l.lat", "l.lon", "r.lat", "r.lon").alias("km"),
        *[_match(F.col(f"l.{f}"), F.col(f"r.{f}")).alias(f"same_{f}") for f in features], *carried)
    return out.where(F.col("km") <= pattern.km)


def _linkable(df: DataFrame, fields: Fields, rules: Rules, vectors: bool) -> DataFrame:
    refuse_denied(fields.features)
    rows = blocks_of_size(df, fields.block, rules.min_block).where(
        F.col(fields.date).isNotNull() & F.col(fields.lat).isNotNull() & F.col(fields.lon).isNotNull())
    rows = rows.select(
        F.col(fields.key).alias("id"), F.col(fields.block).alias("block"), F.col(fields.date).cast("date").alias("day"),
        F.col(fields.lat).alias("lat"), F.col(fields.lon).alias("lon"), *[F.col(f) for f in fields.features],
        F.floor(F.unix_date(F.col(fields.date).cast("date")) / (rules.max_days + 1)).cast("long").alias("bucket"))
    if vectors:
        rows = rows.join(df.select(F.col(fields.key).alias("id"), vec.unit(fields.vector).alias("_v")), "id")
    return cut(rows, "linkable")


def candidate_pairs(df: DataFrame, fields: Fields = Fields(), rules: Rules = Rules(), threshold: float = 0.0,
                    cell_rows: int = CELL_ROWS, vectors: bool = False) -> DataFrame:
    """Feasible pairs a < b of one block with their day and km gaps and feature matches, each once.

    One join per mismatch pattern. Where records of one block, bucket, cell and shared
    features number more than ``cell_rows``, they are dealt over a grid of parts. With ``vectors`` the
    records bring their unit vectors to that join (columns ``_va`` and ``_vb``, which
    ``score_pairs`` takes): a record is then sent once for each cell it looks into, where
    fetching vectors for pairs sends every pair twice. Right for short vectors and dense cells.
    """
    rows = _linkable(df, fields, rules, vectors)
    patterns = mismatch_patterns(rules, fields.features, threshold)
    parts = [_pattern_pairs(rows, p, fields.features, rules, cell_rows) for p in patterns] or [
        _pattern_pairs(rows.where("false"), Pattern((), (), rules.max_km), fields.features, rules, cell_rows)]
    return functools.reduce(DataFrame.unionByName, parts)


def score_pairs(pairs: DataFrame, df: DataFrame, fields: Fields = Fields(), rules: Rules = Rules(),
                threshold: float | None = None) -> DataFrame:
    """Adds cosine and score; with a threshold only pairs that reach it.

    The structured part is summed first. Only pairs that could still reach the threshold
    with a cosine of one fetch their vectors, unless the pairs carry them already.
    """
    w = rules.weights
    part = F.lit(w.get("geo", 0.0)) * geo.geo_similarity(F.col("km"), rules.scale_km)
    for f in fields.features:
        part = part + F.lit(w.get(f, 0.0)) * F.col(f"same_{f}")
    open_pairs = pairs.withColumn("_part", part)
    if threshold is not None:
        open_pairs = open_pairs.where(F.col("_part") + F.lit(w.get("cosine", 0.0)) >= threshold - 1e-9)
    if "_va" not in pairs.columns:
        vectors = df.select(F.col(fields.key).alias("_id"), vec.unit(fields.vector).alias("_v"))
        va, vb = vectors.select(F.col("_id").alias("a"), F.col("_v").alias("_va")), vectors.select(F.col("_id").alias("b"), F.col("_v").alias("_vb"))
        open_pairs = open_pairs.join(va, "a").join(vb, "b")
    scored = (open_pairs.withColumn("cosine", vec.dot("_va", "_vb"))
              .withColumn("score", F.lit(w.get("cosine", 0.0)) * F.col("cosine") + F.col("_part")))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.select(*[c for c in pairs.columns if c not in ("_va", "_vb")], "cosine", "score")


#: Pairs of a cell on average from which they are scored as matrices; below, a join is dearer by less than a call.
DENSE_PAIRS = 4096
#: Late rows of one cell that a task scores as matrices.
DENSE_ROWS = 8192
#: Rows of both sides for each task of such a step.
DENSE_TASK_ROWS = 1 << 18


def strongest_pairs(df: DataFrame, fields: Fields = Fields(), rules: Rules = Rules(), threshold: float | None = None, clipped: bool = False,
                    dense_pairs: int = DENSE_PAIRS, cell_rows: int = DENSE_ROWS) -> DataFrame:
    """(a, b, score): the scored pairs (at or above a threshold) without some that close a circle of stronger ones.

    What stays holds the forest of the strongest links, and so every record's strongest link and
    all that links connect, at any level. ``clipped`` orders links by ``hierarchy.distance``, else
    by score. Where cells are crowded, pairs are scored as matrices and thinned at once, so
    none is written or shuffled (``dense_links``); otherwise they are joined and then thinned. Records
    whose vector or place is not all numbers are always joined.
    """
    key = df.schema[fields.key].dataType
    plain = isinstance(key, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    rows = _linkable(df, fields, rules, True)
    dims = rows.agg(F.max(F.size("_v"))).first()[0] or 0
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    fine = number(F.col("lat")) & number(F.col("lon")) & F.coalesce((F.size("_v") == dims) & F.forall("_v", number), F.lit(False))
    odd = rows.where(~fine)
    whole = not plain or min(rules.weights.values(), default=0.0) < 0 or dims == 0
    some_odd = not whole and not odd.isEmpty()
    found = []
    for p in mismatch_patterns(rules, fields.features, threshold or 0.0):
        early, late, shared = _sides(rows, p)
        crowd = None if whole else _crowd(early, late, shared, cell_rows)
        if crowd is None or crowd[0] < dense_pairs:
            pairs = _pattern_pairs(rows, p, fields.features, rules, CELL_ROWS)
        else:
            found.append(_dense(early.where(fine), late.where(fine), shared, p, rules, fields, threshold, clipped, crowd))
            if not some_odd:
                continue
            with_odd = [(early.where(~fine), late), (early.where(fine), late.where(~fine))]
            pairs = functools.reduce(DataFrame.unionByName, [_joined(e, x, shared, p, fields.features, rules, True) for e, x in with_odd])
        found.append(_thinned_by(score_pairs(pairs, df, fields, rules, threshold), clipped))
    if not found:
        none = _pattern_pairs(rows.where("false"), Pattern((), (), rules.max_km), fields.features, rules, CELL_ROWS)
        found.append(score_pairs(none, df, fields, rules, threshold).select("a", "b", "score"))
    return functools.reduce(DataFrame.unionByName, found)


def _thinned_by(pairs: DataFrame, clipped: bool) -> DataFrame:
    strongest_first = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(-F.col("score"))  # NaN is the highest score
    by = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.col("score"))) if clipped else strongest_first
    return thinned(pairs.select("a", "b", "score", by.alias("_by")), order="_by").drop("_by")


def _crowd(early: DataFrame, late: DataFrame, shared: Sequence[str], cell_rows: int) -> tuple[float, DataFrame, int] | None:
    """(pairs of a cell on average, its numbers of parts, rows of both sides); None without any."""
    ends = late.groupBy(*shared, "bucket").agg(F.count(F.lit(1)).alias("_late"))
    starts = early.groupBy(*shared, F.col("look").alias("bucket")).agg(F.count(F.lit(1)).alias("_early"))
    cells = cut(ends.join(starts, [*shared, "bucket"]), "cells")
    row = cells.agg(F.sum(F.col("_late").cast("double") * F.col("_early")).alias("pairs"), F.count(F.lit(1)).alias("n"),
                    F.sum(F.col("_late") + F.col("_early") * F.ceil(F.col("_late") / cell_rows)).alias("rows")).first()
    if not row["n"]:
        return None
    crowded = cells.where(F.col("_late") > cell_rows).select(*shared, "bucket", F.ceil(F.col("_late") / cell_rows).cast("int").alias("parts"))
    return row["pairs"] / row["n"], crowded, row["rows"]


def _dense(early: DataFrame, late: DataFrame, shared: Sequence[str], pattern: Pattern, rules: Rules, fields: Fields, threshold: float | None,
           clipped: bool, crowd: tuple[float, DataFrame, int]) -> DataFrame:
    """The strongest links of one pattern: each cell, or part of one, is scored in one task."""
    _, crowded, size = crowd
    w = rules.weights
    open_ = [f for f in fields.features if f not in pattern.same]
    columns = ["id", F.unix_date("day").alias("day"), "bucket", "lat", "lon", "_v", *[_present(F.col(f)).alias(f) for f in open_]]
    places = [F.col(c).alias(f"_{c}") for c in shared]
    parts = F.coalesce("parts", F.lit(1))
    if crowded.isEmpty():
        late, early = late.withColumn("part", F.lit(0)), early.where("NOT home").withColumn("part", F.lit(0))
    else:
        place = F.pmod(F.xxhash64("id"), parts).cast("int")
        late = late.join(F.broadcast(crowded), [*shared, "bucket"], "left").withColumn("part", place)
        early = (early.join(F.broadcast(crowded.withColumnRenamed("bucket", "look")), [*shared, "look"], "left")
                 .withColumn("_home", F.when(F.col("home"), place)).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
                 .where(F.col("_home").isNull() | (F.col("_home") != F.col("part"))))
    keys = [f"_{c}" for c in shared] + ["_bucket", "part"]
    late = late.select(*places, F.col("bucket").alias("_bucket"), "part", *columns)
    early = early.select(*places, F.col("look").alias("_bucket"), "part", *columns)
    early = early.toDF(*early.columns)  # own column identities, as both sides come from one table
    tasks = max(4 * late.sparkSession.sparkContext.defaultParallelism, math.ceil(size / DENSE_TASK_ROWS))
    how = dense_links.Scoring(w.get("cosine", 0.0), w.get("geo", 0.0), rules.scale_km, sum(w.get(f, 0.0) for f in pattern.same),
                              {f: w[f] for f in open_ if w.get(f, 0.0) > 0 and f not in pattern.differ}, pattern.differ, pattern.km, rules.max_days, threshold, clipped)
    strongest = dense_links.strongest

    def cell(ends: pa.Table, starts: pa.Table) -> pa.Table:
        if "id" not in ends.column_names or not ends.num_rows:  # a side without rows comes without columns
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return strongest(ends, starts if "id" in starts.column_names else ends.slice(0, 0), how)

    return late.repartition(tasks, *keys).groupBy(*keys).cogroup(early.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(cell, dense_links.SCHEMA)


def confidence(members: DataFrame, pairs: DataFrame, key: str = "case_id", series: str = "component",
               floor: float = fx.CONFIDENCE_FLOOR, min_size: int = fx.CLUSTER_MIN_SIZE) -> DataFrame:
    """(series, size, confidence): mean over the members of each one's strongest link inside."""
    ma = members.select(F.col(key).alias("a"), F.col(series).alias("_sa"))
    mb = members.select(F.col(key).alias("b"), F.col(series).alias("_sb"))
    inside = pairs.select("a", "b", "score").join(ma, "a").join(mb, "b").where(F.col("_sa") == F.col("_sb"))
    both = inside.select(F.col("_sa").alias(series), F.explode(F.array("a", "b")).alias(key), "score")
    best = both.groupBy(series, key).agg(F.max("score").alias("_best"))
    out = best.groupBy(series).agg(F.count(F.lit(1)).alias("size"), F.avg("_best").alias("confidence"))
    return out.where((F.col("confidence") >= floor) & (F.col("size") >= min_size))


def member_pairs(members: DataFrame, df: DataFrame, fields: Fields = Fields(), series: str = "component", k: int = 12) -> DataFrame:
    """(series, a, b, cosine) that hold the k most similar pairs of every series.

    A pair among the k best of its series is among the k nearest of its members, so k
    neighbours per member suffice and no series is compared pair by pair in one place.
    """
    own = members.select(fields.key, series).join(df.select(fields.key, fields.vector), fields.key)
    near = knn(own, own, fields.key, fields.vector, k, within=series)
    pairs = near.select(F.least("query", "neighbour").alias("a"), F.greatest("query", "neighbour").alias("b"),
                        F.col("similarity").alias("cosine"))
    pairs = pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    return pairs.join(members.select(F.col(fields.key).alias("a"), series), "a").select(series, "a", "b", "cosine")


def evidence_links(pairs: DataFrame, df: DataFrame, fields: Fields = Fields(), series: str = "component", top: int = 12,
                   text: str | None = None, shown: Sequence[str] = ("vehicle", "target", "tod")) -> DataFrame:
    """The ``top`` most similar pairs per series with the features and phrases they share."""
    best = top_k_per_group(pairs.select(series, "a", "b", "cosine"), [series], [F.desc("cosine"), "a", "b"], top)
    cols = list(shown) + ([text] if text else [])
    side = lambda end: df.select(F.col(fields.key).alias(end), *[F.col(c).alias(f"{end}_{c}") for c in cols])
    both = best.join(side("a"), "a").join(side("b"), "b")
    shared = F.array_compact(F.array(*[
        F.when(_match(F.col(f"a_{f}"), F.col(f"b_{f}")) == 1.0, F.concat(F.lit(f"{f}:"), F.col(f"a_{f}").cast("string")))
        for f in shown]))
    out = [series, "a", "b", python_round("cosine", 3).alias("cosine"), shared.alias("shared_features")]
    if text:
        out.append(tx.shared_phrases(f"a_{text}", f"b_{text}").alias("phrases"))
    return both.select(*out)


def summarise(members: DataFrame, df: DataFrame, fields: Fields = Fields(), series: str = "component",
              district: str = "district", shown: Sequence[str] = ("vehicle", "target", "tod")) -> DataFrame:
    """One row per series: block, districts, dates and the commonest value of each feature."""
    rows = members.select(fields.key, series).join(df, fields.key)
    stats = rows.groupBy(series).agg(
        F.count(F.lit(1)).alias("size"), F.min(fields.block).alias(fields.block),
        F.sort_array(F.collect_set(district)).alias("districts"), F.min(fields.date).alias("first_date"),
        F.max(fields.date).alias("last_date"), *[F.mode(_present(F.col(f)), True).alias(f) for f in shown])
    label = {"tod": "time"}
    parts = [F.when(F.col(f).isNotNull(), F.concat(F.lit(label.get(f, f) + "="), F.col(f))) for f in shown]
    text = F.concat_ws("; ", *parts)
    return stats.withColumn("summary", F.when(text == "", F.lit(fx.NO_COMMON_FEATURE)).otherwise(text))


def assign_ids(series: DataFrame, key: str = "component", block: str = "crime_sub_head", pin: Column | None = None,
               pin_id: str | None = None) -> DataFrame:
    """SH-01, SH-02 … by falling confidence, and a name from block and first districts.

    ``pin``/``pin_id`` reserve an id for the largest series that satisfies a condition.
    """
    pinned = F.lit(False)
    if pin is not None:
        chosen = series.where(pin).orderBy(F.desc("size"), key).limit(1).select(key).scalar()
        pinned = F.coalesce(F.col(key) == chosen, F.lit(False))
    out = numbered(series.withColumn("_pinned", pinned).withColumn("_slow", (-F.floor(F.col("confidence") * 1000)).cast("long")),
                   ["_pinned", F.desc("confidence"), key], "%d", "_text", "_rank",
                   bucket=F.struct("_pinned", "_slow"))
    number = F.col("_rank")
    if pin_id is not None:
        taken = int(pin_id.split("-")[1])
        exists = series.where(pin).agg(F.count(F.lit(1)) > 0).scalar()
        number = F.when(exists & (number >= taken), number + 1).otherwise(number)
    named = F.when(F.col("_pinned"), F.lit(pin_id)).otherwise(F.format_string("SH-%02d", number))
    name = F.concat(F.col(block), F.lit(" series — "), F.array_join(F.slice("districts", 1, 3), ", "))
    return out.select(named.alias("series_id"), name.alias("name"), *series.columns)


def containing(members: DataFrame, record, key: str = "case_id", series: str = "component") -> DataFrame:
    """Series that hold a record."""
    return members.where(F.col(key) == F.lit(record)).select(series).distinct()


def apply_feedback(series: DataFrame, feedback: DataFrame, key: str = "series_id") -> DataFrame:
    """Status from the latest verdict in an append-only feedback table (key, verdict, ts)."""
    latest = feedback.groupBy(key).agg(F.max_by("verdict", "ts").alias("_v"), F.count(F.lit(1)).alias("n_feedback"))
    status = F.when(F.col("_v").isNull(), "open").when(F.col("_v") == "confirm", "confirmed").otherwise("rejected")
    return series.join(latest, key, "left").withColumn("status", status).withColumn(
        "n_feedback", F.coalesce("n_feedback", F.lit(0))).drop("_v")


def save_series(series: DataFrame, path: str, keep: int = 3) -> int:
    """Rescan: store a new version of the series; readers see the old one until it is complete."""
    return snapshots.save(series, path, keep)


def stored_series(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The series of the last rescan that succeeded, or of a given one."""
    return snapshots.load(spark, path, version)
