"""Exact Jaccard join of texts on sets of word n-grams.

A set holds the distinct 64-bit hashes of a text's shingles. Sizes are cut into bands such
that a set can only link with sets of its own and the neighbouring bands. Sets that share a
key and lie in such bands meet in tiles of bounded size: each set brings a bitmap of its
hashes, a bit that only one side sets stands for a shingle that the other lacks, and these
counts bound the overlap from above. Pairs that the bound lets through are decided by exact
intersection of the sorted hash arrays.

Keys are exact consequences of the threshold. A set A that links with B lacks at most
floor((1 - t) |A|) of its shingles in B. So a set with more shingles than that which occur
in no other set is dropped (first by the hashes below a fixed share of the hash range, where
copies count as others, then by all hashes of distinct sets), and of the others the rarest shingles, one more than may be lacking, are its keys.

Equal sets are one node. The members of a key first meet only one of them; then only
members that are still in different components meet in tiles, so a large group of copies
costs work about in proportion to its size, and no link between two components is lost.
Groups of one key are dealt over as many tiles as their size asks for.

Defined cases: null counts as empty text; a text without words has an empty set and links
with nothing; of fewer words than ``width`` the whole sequence is one shingle; null ids
join components but never name one (a component without any id has none); repeated rows
stay rows; an empty table gives an empty result. Equal 64-bit hashes count as equal
shingles.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.clusters import components
from ..plans.lineage import Rounds, cut
from .arrow_text import chunks, mix, shingles, word_hashes, words

WIDTH = 5
PERCENT = 80
SAMPLE = 0.3  # share of the hash range by which sets are first sifted
BROADCAST_ROWS = 500_000  # of 24 bytes each
TILE = 512  # sets of one side of a tile, about
MASK_BITS = (512, 32768)


def lower(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


def shingle_sets(buf: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets): the distinct shingle hashes of each row, sorted within it."""
    buf, rows = lower(buf), len(at) - 1
    start, end, row = words(buf, at)
    h, of = shingles(word_hashes(buf, start, end), row, rows, width)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1]))) if len(h) else np.zeros(0, bool)
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(rows + 1))


def lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def arrays(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    at = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), at - at[0]


def keyed(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    """``more``, text_key (the text's md5) and text."""
    filled = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*more, F.unhex(F.md5(filled.cast("binary"))).alias("text_key"), filled.alias("text"))


def sketches(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, text_key, n, k0, k1, sample, row) per document: set size, 128 bits that name the set, and its lowest hashes."""
    top = np.uint64(int(SAMPLE * 2.0 ** 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, at in chunks(batch.column(2)):
                h, own = shingle_sets(buf, at, width)
                sums = []
                for salt in (0, 1):
                    with np.errstate(over="ignore"):
                        part = np.concatenate(([np.uint64(0)], np.cumsum(mix(h + np.uint64(salt)), dtype=np.uint64)))
                        sums.append((part[own[1:]] - part[own[:-1]]).view(np.int64))
                low = h < top
                ends = np.concatenate(([0], np.cumsum(low)))[own]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(own)), *map(pa.array, sums), lists(h[low], ends)],
                    names=["doc_id", "text_key", "n", "k0", "k1", "sample"])

    made = keyed(docs, text, F.col(doc_id).cast("long").alias("doc_id")).mapInArrow(
        run, "doc_id long, text_key binary, n long, k0 long, k1 long, sample array<long>")
    return made.withColumn("row", F.monotonically_increasing_id())


def full_sets(rows: DataFrame, width: int) -> DataFrame:
    """(node, n, hashes) of (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, at in chunks(batch.column(1)):
                h, own = shingle_sets(buf, at, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(own)), lists(h, own)],
                                                 names=["node", "n", "hashes"])

    return rows.mapInArrow(run, "node long, n long, hashes array<long>")


def lacking(n: Column, percent: int) -> Column:
    """The most shingles of a set of size ``n`` that a linked set may lack."""
    return F.floor((100 - percent) * n / F.lit(100)).cast("long")


def common_hashes(sets: DataFrame, hashes: str) -> DataFrame:
    """(h, node, df) of the hashes that several sets have."""
    each = sets.select("node", F.explode(hashes).alias("h"))
    df = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return each.join(df, "h").select("h", "node", "df")


def sifted(sets: DataFrame, hashes: str, common: DataFrame, percent: int) -> DataFrame:
    """(node, n, alone) of the sets of which few enough ``hashes`` are theirs alone."""
    shared = common.groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    alone = F.col("all") - F.coalesce("shared", F.lit(0))
    few = sets.select("node", "n", F.size(hashes).alias("all")).join(shared, "node", "left").withColumn("alone", alone)
    return few.where(F.col("alone") <= lacking(F.col("n"), percent)).select("node", "n", "alone")


def band_of(n: Column, percent: int) -> Column:
    """The size band: the next one starts at the first size that cannot link with the smallest of this band."""
    starts, low = [], 1
    while low < 1 << 40:
        starts.append(low)
        low = 100 * low // percent + 1
    return F.size(F.filter(F.array(*[F.lit(x) for x in starts]), lambda s: s <= n)) - 1


def bitmap(h: np.ndarray, own: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros((len(own) - 1, bits // 64), np.uint64)
    row = np.repeat(np.arange(len(own) - 1), np.diff(own))
    slot = h & np.uint64(bits - 1)
    np.bitwise_or.at(out, (row, (slot >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (slot & np.uint64(63)))
    return out


def bits_for(n: int) -> int:
    return min(MASK_BITS[1], max(MASK_BITS[0], 1 << int(8 * n - 1).bit_length()))


def folded(mask: np.ndarray, words_: int) -> np.ndarray:
    """A bitmap of fewer bits: halves are laid over each other."""
    while mask.shape[-1] > words_:
        half = mask.shape[-1] // 2
        mask = mask[..., :half] | mask[..., half:]
    return mask


def may_link(na: np.ndarray, ma: np.ndarray, nb: np.ndarray, mb: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair's overlap, bounded by the bits that only one of the two sets, can still reach the threshold (a x b)."""
    width = min(ma.shape[1], mb.shape[1])
    ma, mb = folded(ma, width), folded(mb, width)
    out = np.zeros((len(na), len(nb)), bool)
    step = max(1, (1 << 19) // max(1, len(nb) * width))
    for i in range(0, len(na), step):
        a = ma[i:i + step, None, :]
        only_a = np.bitwise_count(a & ~mb[None]).sum(2, dtype=np.int64)
        only_b = np.bitwise_count(mb[None] & ~a).sum(2, dtype=np.int64)
        n = na[i:i + step, None]
        most = np.minimum(n - only_a, nb[None] - only_b)
        out[i:i + step] = 100 * most >= percent * (n + nb[None] - most)
    return out


def with_masks(sets: DataFrame) -> DataFrame:
    """(node, n, mask): the bitmap has eight to sixteen bits for every hash, as far as MASK_BITS goes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, own = arrays(batch.column(2))
            n = np.diff(own)
            masks = [bitmap(h[a:b], np.array([0, b - a]), bits_for(b - a))[0] for a, b in zip(own[:-1], own[1:])]
            at = np.concatenate(([0], np.cumsum([len(m) for m in masks], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), lists(np.concatenate(masks) if masks else np.zeros(0, np.uint64), at)],
                                             names=["node", "n", "mask"])

    return sets.select("node", "n", "hashes").mapInArrow(run, "node long, n long, mask array<long>")


def tiled(members: DataFrame, tile: int = TILE) -> DataFrame:
    """(tile columns h, ba, ca, bb, cb, side, plus members): every set once for each tile that it takes part in.

    A key's sets of one band are dealt over chunks of about ``tile``; a tile is a pair of
    chunks of one band or of two neighbouring bands. ``members`` has h, band, node.
    """
    sizes = members.groupBy("h", "band").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("chunks"))
    near = (sizes.select("h", F.col("band"), F.col("chunks").alias("own"))
            .join(sizes.select("h", (F.col("band") - 1).alias("band"), F.col("chunks").alias("above")), ["h", "band"], "left")
            .join(sizes.select("h", (F.col("band") + 1).alias("band"), F.col("chunks").alias("below")), ["h", "band"], "left"))
    rows = members.join(near, ["h", "band"]).withColumn("c", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))

    def tiles(count: str, make) -> Column:
        none = F.array().cast("array<struct<ba:int,ca:int,bb:int,cb:int,side:int>>")
        return F.when(F.coalesce(F.col(count), F.lit(0)) < 1, none).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.coalesce(F.col(count), F.lit(1)), F.lit(1)) - 1), make))

    def spot(ba: Column, ca: Column, bb: Column, cb: Column, side: Column) -> Column:
        return F.struct(ba.cast("int").alias("ba"), ca.cast("int").alias("ca"), bb.cast("int").alias("bb"), cb.cast("int").alias("cb"),
                        side.cast("int").alias("side"))

    band, c = F.col("band"), F.col("c")
    inner = tiles("own", lambda o: spot(band, F.least(c, o), band, F.greatest(c, o), F.when(o == c, 2).when(c < o, 0).otherwise(1)))
    up = tiles("above", lambda o: spot(band, c, band + 1, o, F.lit(0)))
    down = tiles("below", lambda o: spot(band - 1, o, band, c, F.lit(1)))
    return rows.withColumn("t", F.explode(F.concat(inner, up, down))).select("h", "t.*", *[x for x in members.columns if x != "h"])


def tile_pairs(members: DataFrame, masks: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """(a, b) with a < b of different parts whose bitmaps let them link; ``members``: (h, node, part, band), several parts per h."""
    def pairs(rows: dict[str, np.ndarray], masks_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        side, out = rows["side"], ([], [])
        wide = np.array([len(m) for m in masks_])
        for wa in np.unique(wide):
            for wb in np.unique(wide):
                x, y = np.flatnonzero((side != 1) & (wide == wa)), np.flatnonzero((side != 0) & (wide == wb))
                if len(x) and len(y):
                    good = may_link(rows["n"][x], np.stack([masks_[i] for i in x]), rows["n"][y], np.stack([masks_[i] for i in y]), percent)
                    i, j = np.nonzero(good & (rows["part"][x][:, None] != rows["part"][y][None]))
                    a, b = rows["node"][x[i]], rows["node"][y[j]]
                    out[0].append(np.minimum(a, b))
                    out[1].append(np.maximum(a, b))
        return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)

    names = ["h", "ba", "ca", "bb", "cb", "side", "node", "part", "n"]

    def meet(rows: dict[str, np.ndarray], masks_: list[np.ndarray], cuts: np.ndarray) -> pa.RecordBatch:
        found = [pairs({c: rows[c][s:e] for c in names}, masks_[s:e]) for s, e in zip(cuts[:-1], cuts[1:]) if e - s > 1]
        both = np.stack([np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1)])
        both = np.unique(both, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, masks_ = {c: np.zeros(0, np.int64) for c in names}, []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: np.concatenate((rows[c], batch.column(i).to_numpy())) for i, c in enumerate(names)}
            values, at = arrays(batch.column(len(names)))
            masks_ += [values[s:e] for s, e in zip(at[:-1], at[1:])]
            place = np.stack([rows[c] for c in names[:5]])
            cuts = np.concatenate(([0], 1 + np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0))))
            yield meet(rows, masks_, cuts)
            rows, masks_ = {c: v[cuts[-1]:] for c, v in rows.items()}, masks_[cuts[-1]:]  # the last tile may go on in the next batch
        if masks_:
            yield meet(rows, masks_, np.array([0, len(masks_)]))

    rows = tiled(members, tile).join(masks, "node")
    place = ["h", "ba", "ca", "bb", "cb"]
    dealt = rows.select(*place, "side", "node", "part", "n", "mask").repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, common, together) as a table: the pairs (a, b) whose sets reach the threshold, by exact intersection."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xs), (y, ys) = arrays(batch.column(2)), arrays(batch.column(3))
            both = np.array([len(np.intersect1d(x[xs[i]:xs[i + 1]], y[ys[i]:ys[i + 1]], assume_unique=True)) for i in range(batch.num_rows)], np.int64)
            together = np.diff(xs) + np.diff(ys) - both
            good = pa.array(100 * both >= percent * together)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both), pa.array(together.astype(np.int64))],
                                             names=["a", "b", "common", "together"]).filter(good)

    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("y"))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    rows = pairs.join(left, "a").join(right, "b").where(fits).select("a", "b", "x", "y")
    return cut(rows.mapInArrow(run, "a long, b long, common long, together long"), "links")


def keys_of(sets: DataFrame, percent: int) -> DataFrame:
    """(h, node, band, size): the keys of the sets that may link; ``size`` sets have the key."""
    common = cut(common_hashes(sets, "hashes"), "common")
    few = sifted(sets, "hashes", common, percent)
    nth = F.row_number().over(Window.partitionBy("node").orderBy("df", "h"))
    keys = common.join(few, "node").withColumn("nth", nth).where(F.col("nth") + F.col("alone") <= lacking(F.col("n"), percent) + 1)
    keys = cut(keys.select("h", "node", band_of(F.col("n"), percent).alias("band")), "keys")
    several = keys.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return cut(keys.join(several, "h"), "keys")


def linked(sets: DataFrame, percent: int = PERCENT, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """((a, b, common, together) links that hold every component together, (node, component) of linked nodes) of (node, n, hashes)."""
    keys = keys_of(sets, percent)
    crowd = keys.groupBy("node").agg(F.sum("size").alias("crowd"))
    pivots = keys.join(crowd, "node").groupBy("h").agg(F.max_by("node", F.struct("crowd", -F.col("node"))).alias("pivot"))
    star = keys.join(pivots, "h").where("node <> pivot").select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    star = cut(star, "pairs")
    links = verified(star, sets, percent)
    parts = cut(components(links), "parts")
    state = keys.select("h", "node", "band").join(parts, "node", "left").select(
        "h", "node", "band", F.coalesce("component", "node").alias("part"))
    open_ = state.groupBy("h").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("h")
    members = cut(state.join(open_, "h"), "open")
    masks = cut(with_masks(sets.join(members.select("node").distinct(), "node", "left_semi")), "masks")
    more = tile_pairs(members, masks, percent, tile).join(star, ["a", "b"], "left_anti")
    links = links.unionByName(verified(cut(more, "pairs"), sets, percent))
    return links, cut(components(links), "components")


def join_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
                   tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n_shingles, component_id) per document, links between representatives of equal sets, see linked)."""
    scratch = Rounds(docs.sparkSession, "sketches")
    rows = scratch.cut(sketches(docs, doc_id, text, width))
    same = rows.where("n > 0").groupBy("k0", "k1", "n").agg(F.min("row").alias("node"))
    own = cut(rows.select("doc_id", "text_key", "row", "n", "k0", "k1").join(same, ["k0", "k1", "n"], "left").select(
        "doc_id", "text_key", "row", "n", "node"), "nodes")
    each = rows.where("n > 0").select(F.col("row").alias("node"), "n", "sample")
    few = sifted(each, "sample", common_hashes(each, "sample"), percent).select("node")
    few = cut(own.where("row = node").select("node", "text_key").join(few, "node", "left_semi"), "few")
    scratch.close()
    # a short list goes to the texts, else both are dealt out by key
    wanted = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    texts = keyed(docs, text).join(wanted, "text_key").select("node", "text").dropDuplicates(["node"])
    sets = cut(full_sets(texts, width), "sets")
    links, parts = linked(sets, percent, tile)
    placed = cut(own.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    name = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(name, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out, links
