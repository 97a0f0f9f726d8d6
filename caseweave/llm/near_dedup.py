"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

Shingles are runs of five words (bytes outside space and 09-0D); a shingle that a text has
c times weighs 1 + ln c. A register's winner is the element whose exponential arrival, of
rate equal to its weight, comes first; two texts agree in a register with their probability
Jaccard similarity. Elements draw arrivals of a Poisson process, each for one register, and
stop once an arrival comes after the text's last register.

Repeats can hide that two texts have the same shingles, so a text with repeated shingles
gets a second set of bands, in which every distinct shingle weighs one; there a register
agrees with the plain Jaccard similarity. Without repeats both sets are the same bands.

Two texts are linked if they share a band and the exact probability Jaccard similarity of
their weighted shingles, or the exact Jaccard similarity of their shingle sets, reaches the
threshold. Classes are the connected components of the links (built by the library's
general components operator).

Defined cases: equal texts share a class, also empty ones; null counts as empty; a text of
one to four words is one shingle; a class is named by its smallest non-null id (null if it
has none); repeated rows stay rows; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.clusters import components
from ..plans.lineage import cut
from .arrow_text import chunks, free_name, mix, shingles, word_hashes, words

WIDTH = 5
SIMILARITY = 0.8
BANDS = 20
MASK_LONGS = 32
ROWS = 4  # at a similarity of 0.8 a pair shares none of 20 bands of 4 with probability 3e-5

_STEP = np.uint64(0x9FB21C651E98DF25)
_UNIT = 2.0 ** -53


def weighted_shingles(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, weight) of the distinct shingles of each row, by row and hash."""
    start, end, row = words(buf, at)
    h, of = shingles(word_hashes(buf, start, end), row, len(at) - 1, WIDTH)
    if not len(h):
        return h, of, np.zeros(0)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1]))))
    return h[new], of[new], 1.0 + np.log(np.diff(np.concatenate((new, [len(h)]))))


def prob_min_hash(h: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """Winning element per row and register; 0 where a row has no element."""
    owner = np.zeros(rows * m, np.uint64)
    best = np.full(rows * m, np.inf)
    last = np.full(rows, np.inf)  # arrival of a row's latest register
    active, time, turn = np.arange(len(h)), np.zeros(len(h)), 0
    while len(active):
        turn += 1
        with np.errstate(over="ignore"):
            draw = mix(h[active] + np.uint64(turn) * _STEP)
        time[active] -= np.log1p(-((draw >> np.uint64(11)).astype(float) * _UNIT)) / weight[active]
        of = row[active]
        alive = time[active] < last[of]  # later arrivals of the others come too late as well
        active, of, draw = active[alive], of[alive], draw[alive]
        cell = of * m + (mix(draw) % np.uint64(m)).astype(np.int64)
        wins = time[active] < best[cell]
        cell, won = cell[wins], active[wins]
        order = np.argsort(-time[won], kind="stable")  # the earliest is written last
        best[cell[order]], owner[cell[order]] = time[won[order]], h[won[order]]
        touched = np.unique(of[wins])
        last[touched] = best.reshape(rows, m)[touched].max(1)
    return owner.reshape(rows, m)


def _keys(h: np.ndarray, of: np.ndarray, weight: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    sig = prob_min_hash(h, of, weight, n, bands * rows).reshape(n, bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _STEP
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mix(key + sig[:, :, k])
    return key.astype(np.int64)


def band_keys(buf: np.ndarray, at: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[np.ndarray]:
    """Band keys of each row of one slice: those of the weighted shingles, then, if a shingle is repeated, those of the set."""
    n = len(at) - 1
    h, of, weight = weighted_shingles(buf, at)
    keys = _keys(h, of, weight, n, bands, rows)
    has = np.bincount(of, minlength=n) > 0
    repeats = np.zeros(n, bool)
    repeats[of[weight > 1]] = True
    which = np.flatnonzero(repeats)
    mine = repeats[of]
    plain = _keys(h[mine], np.searchsorted(which, of[mine]), np.ones(int(mine.sum())), len(which), bands, rows)
    out = [keys[i] if has[i] else keys[i, :0] for i in range(n)]
    for i, own in zip(which, plain):
        out[i] = np.concatenate((keys[i], own[own != keys[i]]))
    return out


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, bands) as a table; bands is empty for a text without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k for _, _, buf, at in chunks(batch.column(2)) for k in band_keys(buf, at)]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))],
                names=["doc_id", "key", "bands"])

    filled = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.md5(filled.cast("binary")).alias("key"), filled.alias("text"))
    return cut(rows.mapInArrow(run, "doc_id long, key string, bands array<long>"), "signatures")


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two arrays of distinct hashes, sorted, with weights: over the common ones d, the sum of 1 / sum of max(x'/x_d, y'/y_d) over all.

    Sorted by the quotient of their weights, the elements from d on give x' and those before it y'.
    """
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    quotient = x[i] / y[j]
    order = np.argsort(quotient, kind="stable")
    q, xs, ys = quotient[order], x[i][order], y[j][order]
    only_x, only_y = x.sum() - xs.sum(), y.sum() - ys.sum()
    from_x = np.cumsum(xs[::-1])[::-1]  # of equal quotients it does not matter to which side they count
    before_y = np.concatenate(([0.0], np.cumsum(ys)[:-1]))
    return float((xs / (only_x + from_x + q * (only_y + before_y))).sum())


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """The larger of probability Jaccard and plain Jaccard similarity; without repeats they are the same."""
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    plain = common / (len(a) + len(b) - common)
    return plain if (x == 1).all() and (y == 1).all() else max(plain, probability_jaccard(a, x, b, y))


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the ``pairs`` (a, b) that reach ``threshold``; ``texts``: (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_b, own_b = None, None
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sims = np.zeros(len(a))
            for first, end, buf, at in chunks(batch.column(2)):
                h, of, weight = weighted_shingles(buf, at)
                own = np.searchsorted(of, np.arange(end - first + 1))
                for i in range(first, end):
                    if b[i] != last_b:  # rows come sorted by b or nearly so
                        _, _, bb, ba = next(chunks(batch.column(3).slice(i, 1)))
                        last_b, own_b = b[i], weighted_shingles(bb, ba)[::2]
                    mine = slice(own[i - first], own[i - first + 1])
                    sims[i] = similarity(h[mine], weight[mine], *own_b)
            good = np.flatnonzero(sims >= threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good]), pa.array(sims[good])],
                                             names=["a", "b", "similarity"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return cut(both.mapInArrow(run, "a long, b long, similarity double"), "links")


def masks(texts: DataFrame) -> DataFrame:
    """(node, n, w, mask): distinct shingles, their weight, and the bits that they set among MASK_LONGS * 64."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, at in chunks(batch.column(1)):
                h, of, weight = weighted_shingles(buf, at)
                mask = np.zeros((b - a, MASK_LONGS), np.uint64)
                np.bitwise_or.at(mask, (of, ((h >> np.uint64(40)) % np.uint64(MASK_LONGS)).astype(np.int64)), np.uint64(1) << (h & np.uint64(63)))
                ends = np.arange(0, mask.size + 1, MASK_LONGS, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.bincount(of, minlength=b - a)), pa.array(np.bincount(of, weight, b - a).astype(float)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(mask.view(np.int64).ravel()))], names=["node", "n", "w", "mask"])

    return texts.mapInArrow(run, "node long, n long, w double, mask array<long>")


def _can_reach(a: str, b: str, threshold: float) -> Column:
    """Whether a pair may reach the threshold: each bit that only one side sets stands for a shingle the other lacks.

    The share of a side's weight that is common bounds the probability Jaccard similarity, and a lacking shingle weighs
    one at least; where neither side has repeats the bound of the plain similarity holds for both.
    """
    def lacking(x: str, y: str) -> Column:
        return sum((F.bit_count(F.col(f"mask_{x}")[i].bitwiseAND(F.bitwise_not(F.col(f"mask_{y}")[i]))) for i in range(MASK_LONGS)), F.lit(0))

    def decide(only_a: Column, only_b: Column) -> Column:
        most = F.least(F.col(f"n_{a}") - only_a, F.col(f"n_{b}") - only_b)
        plain = most / F.greatest(F.col(f"n_{a}") + F.col(f"n_{b}") - most, F.lit(1)) + 1e-9 >= threshold
        share = F.least(1 - only_a / F.greatest(F.col(f"w_{a}"), F.lit(1.0)), 1 - only_b / F.greatest(F.col(f"w_{b}"), F.lit(1.0)))
        repeats = (F.col(f"w_{a}") > F.col(f"n_{a}") + 1e-6) | (F.col(f"w_{b}") > F.col(f"n_{b}") + 1e-6)
        return plain | (repeats & (share + 1e-9 >= threshold))

    return decide(lacking(a, b), lacking(b, a))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """((doc_id, key, class_id) per row of ``docs``, (key, rep, class_id, leads) per distinct text).

    First every band is a star: its members meet only the one that shares most bands with
    others. Then only bands that still hold several components form the pairs between those,
    and of them only those whose similarity the texts' bit masks do not bound below the
    threshold. So a large group of copies costs comparisons about in proportion to its size,
    and of the pairs that share a band none that could join two classes is dropped.
    """
    rows = signatures(docs, doc_id, text)
    one = cut(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")).withColumn(
        "node", F.monotonically_increasing_id()), "texts")
    slots = one.select("node", F.explode("bands").alias("slot"))
    several = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = cut(slots.join(several, "slot"), "slots")
    nodes = shared.select("node").distinct().join(one.select("node", "key", "rep"), "node")
    filled = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.md5(filled.cast("binary")).alias("key"), F.col(doc_id).cast("long").alias("rep"), filled.alias("text"))
    texts = cut(texts.join(nodes, (texts["key"] == nodes["key"]) & texts["rep"].eqNullSafe(nodes["rep"])).select(
        "node", "text").dropDuplicates(["node"]), "candidates")
    crowd = shared.groupBy("node").agg(F.sum("size").alias("crowd"))
    pivots = shared.join(crowd, "node").groupBy("slot").agg(F.max_by("node", F.struct("crowd", -F.col("node"))).alias("b"))
    stars = shared.join(pivots, "slot").where("node != b").select(F.col("node").alias("a"), "b").distinct()
    stars = cut(stars, "pairs")
    links = verify(stars, texts, threshold)
    parts = components(links)
    state = shared.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    mixed = state.groupBy("slot").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("slot")
    open_ = cut(state.join(mixed, "slot").select("slot", "node", "part"), "open")
    need = open_.select("node").distinct().join(texts, "node")
    open_ = cut(open_.join(masks(need), "node"), "masks")
    x, y = (open_.select("slot", *[F.col(c).alias(f"{c}_{n}") for c in ("part", "n", "w", "mask")], F.col("node").alias(n)) for n in "ab")
    more = x.join(y, (x["slot"] == y["slot"]) & (F.col("part_a") != F.col("part_b")) & (F.col("a") > F.col("b")) & (
        _can_reach("a", "b", threshold))).select("a", "b").distinct()
    tested = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    late = verify(cut(more.join(tested, ["a", "b"], "left_anti"), "pairs"), texts, threshold)
    links = links.unionByName(late)
    parts = cut(components(links), "classes")
    own = one.select("node", "key", "rep").join(parts, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    name = own.groupBy("component").agg(F.min("rep").alias("class_id"))
    members = cut(own.join(name, "component").select("key", "rep", "class_id", (F.col("rep") == F.col("class_id")).alias("leads")), "members")
    return rows.select("doc_id", "key").join(members.select("key", "class_id"), "key"), members


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row of each class, that with the smallest id, unchanged. Rows without any id in their class go by text."""
    _, members = near_classes(docs, doc_id, text, threshold)
    id_, key = free_name(docs, "kept_id"), free_name(docs, "kept_key")
    kept = members.where("leads OR class_id IS NULL").select(F.col("rep").alias(id_), F.col("key").alias(key))
    mine = docs.withColumns({f"{id_}_": F.col(doc_id).cast("long"), f"{key}_": F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))})
    same = (mine[f"{key}_"] == kept[key]) & mine[f"{id_}_"].eqNullSafe(kept[id_])
    return mine.join(kept, same, "left_semi").dropDuplicates([f"{key}_", f"{id_}_"]).drop(f"{key}_", f"{id_}_")
