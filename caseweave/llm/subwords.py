"""SentencePiece segmentations sampled without replacement, and their decoding.

A text is a lattice over its bytes whose edges are pieces of the model (characters without
a piece fall back to their bytes). No piece reaches from a visible character into a following
space, so runs of spaces with the word after them are lattices of their own, and equal ones
are prepared once. A piece's weight falls with its rank in the model (Zipf's law); backward
sums turn weights into the probability of each edge at its node.

Samples are the k segmentations with the largest Gumbel-perturbed log probabilities, found by
A* search from above: the root holds the maximum; sampling edges down to a leaf finds the
segmentation that has it; the segmentations that leave this path at some node are a set whose
maximum is a Gumbel truncated at the parent's. The set with the largest maximum is opened
next. The (k+1)-th maximum is the threshold for inclusion scores. All numbers come from
hashes of the row's key, so a row gives the same samples anywhere.

Defined cases: null counts as empty; an empty text has one segmentation, without pieces;
a text with fewer segmentations than k gives all of them, with inclusion 1; U+2581 counts as
a space; rows with equal keys and texts give equal samples; an empty table gives no row.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import chunks, mix, word_hashes

SAMPLES = 2
SHARPNESS = 1.0
ZIPF_SHIFT = 10.0
#: Nodes (bytes of distinct units) whose lattices a task keeps; some 65 bytes each.
KNOWN_NODES = 1 << 21
_SPACE = 32
_BASE = np.uint64(0x9FB21C651E98DF25)
_SLOT_BITS, _SLOT_BASE = 19, np.uint64(0x9E3779B97F4A7C15)
#: A set whose log mass lies this far below a Gumbel value cannot exceed it in double precision.
_REACH = 40.0

SCHEMA = "doc_id long, sample int, pieces binary, log_probability double, perturbed double, log_inclusion double, round_trip boolean"


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, self.byte_ids = {}, np.zeros(256, np.int64)
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[p.replace("▁", " ").encode()] = i
        size = model.get_piece_size()
        weight = -SHARPNESS * np.log(np.arange(size) + ZIPF_SHIFT)
        self.weight = weight - np.log(np.exp(weight).sum())
        raw = [b""] * size
        for b, i in pieces.items():
            raw[i] = b
        for b in range(256):
            raw[self.byte_ids[b]] = bytes([b])
        self.lengths = np.array([len(b) for b in raw])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.longest = max(map(len, pieces))
        ids = np.array(list(pieces.values()))
        h = np.zeros(len(ids), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.longest):
                has = self.lengths[ids] > k
                h[has] = h[has] * _BASE + self.bytes[self.starts[ids[has]] + k].astype(np.uint64) + np.uint64(1)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], ids[order]
        self.slot = np.full(1 << _SLOT_BITS, -1, np.int32)  # a place in ``hashes``; of pieces that share a slot, the last
        self.slot[self._slots(self.hashes)] = np.arange(len(ids))

    @staticmethod
    def _slots(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * _SLOT_BASE) >> np.uint64(64 - _SLOT_BITS)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of pieces with these running hashes, -1 for none."""
        flat, out = h.ravel(), np.full(h.size, -1, np.int32)
        at = self.slot[self._slots(flat)]
        taken = np.flatnonzero(at >= 0)
        at, wanted = at[taken], flat[taken]
        same = self.hashes[at] == wanted
        out[taken[same]] = self.ids[at[same]]
        taken, wanted = taken[~same], wanted[~same]
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        same = self.hashes[at] == wanted
        out[taken[same]] = self.ids[at[same]]
        return out.reshape(h.shape)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of pieces in a row, a space for each U+2581."""
        n = self.lengths[ids]
        at = np.cumsum(n) - n
        return self.bytes[np.arange(int(n.sum())) - np.repeat(at - self.starts[ids], n)]


@dataclass
class Lattices:
    """Edges of many units by node: e belongs to node n if edge_first[n] <= e < edge_first[n + 1]; ``upto[e]`` is node + running probability."""
    first: np.ndarray  # start node of each unit
    edge_first: np.ndarray  # node -> first edge, and the end
    target: np.ndarray  # node behind the edge, -1 at the unit's end
    piece: np.ndarray  # piece id, or -1 - row of ``spelled``
    log_p: np.ndarray
    upto: np.ndarray
    spelled: np.ndarray  # piece ids of characters in single bytes, four a row, -1 behind the last


def units(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of runs of spaces with the visible run behind them."""
    space = buf == _SPACE
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[at[:-1][at[:-1] < len(buf)]] = True
    start = np.flatnonzero(begins)
    return start, np.concatenate((start[1:], [len(buf)])), np.searchsorted(at, start, "right") - 1


def build(buf: np.ndarray, start: np.ndarray, size: np.ndarray, vocab: Vocabulary) -> Lattices:
    """Lattices of the units at ``start``; units of one length are prepared together, their nodes ordered by place, then unit."""
    first, parts, nodes = np.empty(len(size), np.int64), [], 0
    spelled, n_spelled = [], 0
    for length in np.unique(size).tolist():
        which = np.flatnonzero(size == length)
        text = buf[start[which] + np.arange(length)[:, None]]
        n, longest = len(which), min(vocab.longest, length)
        h = np.zeros((length, n), np.uint64)
        found = []
        with np.errstate(over="ignore"):
            for k in range(1, longest + 1):
                h = h[:length - k + 1] * _BASE + text[k - 1:].astype(np.uint64) + np.uint64(1)
                ids = vocab.find(h)
                if (ids >= 0).any():
                    found.append((k, ids))
        lead = (text & 0xC0) != 0x80
        width = np.where(text >= 0xF0, 4, np.where(text >= 0xE0, 3, np.where(text >= 0xC0, 2, 1)))
        width = np.minimum(width, (length - np.arange(length))[:, None])
        single = np.zeros((length, n), bool)
        offered = np.full((length, n, len(found) + 1), -1, np.int32)  # last: in single bytes
        for j, (k, ids) in enumerate(found):
            single[:len(ids)] |= (ids >= 0) & (width[:len(ids)] == k)
            offered[:len(ids), :, j] = np.where(lead[:len(ids)], ids, -1)
        alone = lead & ~single
        offered[alone, -1] = 0
        i, u, j = np.nonzero(offered >= 0)
        piece = offered[i, u, j]
        value, k = vocab.weight[piece], np.array([*(k for k, _ in found), 0])[j]
        by_byte = np.flatnonzero(j == len(found))
        if len(by_byte):
            w = width[i[by_byte], u[by_byte]]
            ids = np.full((len(w), 4), -1, np.int64)
            for x in range(4):
                has = w > x
                ids[has, x] = vocab.byte_ids[text[i[by_byte][has] + x, u[by_byte][has]]]
            value[by_byte] = np.where(ids >= 0, vocab.weight[ids], 0.0).sum(1)
            k[by_byte], piece[by_byte] = w, -1 - n_spelled - np.arange(len(w))
            spelled.append(ids)
            n_spelled += len(w)
        beta = np.full((length + 4, n), -np.inf)
        beta[length] = 0.0
        bounds = np.searchsorted(i, np.arange(length + 1))
        total = np.empty(len(u))
        for p in range(length - 1, -1, -1):
            s = slice(bounds[p], bounds[p + 1])
            if s.start == s.stop:
                continue
            total[s] = value[s] + beta[p + k[s], u[s]]
            head = np.flatnonzero(np.concatenate(([True], u[s][1:] != u[s][:-1])))
            top = np.maximum.reduceat(total[s], head)
            count = np.diff(np.concatenate((head, [s.stop - s.start])))
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                summed = safe + np.log(np.add.reduceat(np.exp(total[s] - np.repeat(safe, count)), head))
            beta[p, u[s][head]] = summed
            total[s] -= np.repeat(np.where(np.isfinite(summed), summed, 0), count)
        good = np.isfinite(total)
        i, u, k, piece, total = i[good], u[good], k[good], piece[good], total[good]
        node = nodes + i * n + u
        parts.append((node, np.where(i + k == length, -1, node + k * n), piece, total))
        first[which] = nodes + np.arange(n)
        nodes += length * n
    node, target, piece, log_p = (np.concatenate(x) for x in zip(*parts))
    running = np.cumsum(np.exp(log_p))
    edge_first = np.concatenate(([0], np.cumsum(np.bincount(node, minlength=nodes))))
    before = np.concatenate(([0.0], running))[edge_first[node]]
    upto = node + np.minimum(running - before, 1.0)
    last = edge_first[node + 1] - 1
    upto[last] = node + 1.0
    return Lattices(first, edge_first, target.astype(np.int32), piece, log_p, upto,
                    np.concatenate([np.zeros((0, 4), np.int64), *spelled]))


class Known:
    """The lattices of units met so far in a task, by their hashes; forgotten once they have ``limit`` nodes.

    Most units of a slice were met before, so that only the new ones are prepared. The limit
    bounds memory alone: a unit's lattice is the same whenever it is built.
    """

    def __init__(self, vocab: Vocabulary, limit: int = KNOWN_NODES):
        self.vocab, self.limit, self.net, self.room = vocab, limit, None, {}
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def lattices(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[Lattices | None, np.ndarray]:
        """(lattices, number of each unit in them)."""
        if not len(start):
            return self.net, np.zeros(0, np.int64)
        h, head, unit = np.unique(word_hashes(buf, start, end), return_index=True, return_inverse=True)
        if self.net is not None and len(self.net.edge_first) > self.limit:
            self.net, self.hashes, self.numbers = None, self.hashes[:0], self.numbers[:0]  # the room stays
        at = np.searchsorted(self.hashes, h)
        new = np.ones(len(h), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != h[inside]
        if new.any():
            first, had = head[new], len(self.numbers)
            self._add(build(buf, start[first], (end - start)[first], self.vocab))
            self.hashes = np.insert(self.hashes, at[new], h[new])
            self.numbers = np.insert(self.numbers, at[new], had + np.arange(len(first)))
        return self.net, self.numbers[np.searchsorted(self.hashes, h)][unit]

    def _add(self, more: Lattices) -> None:
        """Append lattices; arrays grow by doubling."""
        old = self.net
        nodes, edges, spelled = (len(old.edge_first) - 1, len(old.target), len(old.spelled)) if old else (0, 0, 0)

        def append(name: str, n: int, new: np.ndarray) -> np.ndarray:
            room, need = self.room.get(name), n + len(new)
            if room is None or len(room) < need:
                larger = np.empty((max(need, 2 * n), *new.shape[1:]), new.dtype)
                if n:
                    larger[:n] = room[:n]
                self.room[name] = room = larger
            room[n:need] = new
            return room[:need]

        self.net = Lattices(
            append("first", len(self.numbers), more.first + nodes), append("edge_first", nodes, more.edge_first + edges),
            append("target", edges, np.where(more.target < 0, np.int32(-1), more.target + np.int32(nodes))),
            append("piece", edges, np.where(more.piece < 0, more.piece - np.int32(spelled), more.piece)),
            append("log_p", edges, more.log_p), append("upto", edges, more.upto + nodes), append("spelled", spelled, more.spelled))


def _mix_one(x: int) -> int:
    """``mix`` of one whole number."""
    full = 0xFFFFFFFFFFFFFFFF
    x = (x + 0x9E3779B97F4A7C15) & full
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
    return x ^ (x >> 31)


def uniform(*parts):
    """Numbers inside (0, 1) from hashes of the parts, plain ints first; ints alone give a float."""
    x = 0
    for p in parts:
        if isinstance(p, int):
            x = _mix_one(x + p)
        else:
            with np.errstate(over="ignore"):
                x = mix(np.uint64(x) + p.astype(np.uint64))
    if isinstance(x, int):
        return (float(x >> 11) + 0.5) * 2.0 ** -53
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53


def sample_units(net: Lattices, unit: np.ndarray, key: np.ndarray, place: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges in order, edges per occurrence) of one sampled path through each occurrence of a unit."""
    at, step = np.argsort(unit, kind="stable"), 0  # neighbours read neighbouring nodes
    node = net.first[unit[at]]
    got, count = [], np.zeros(len(unit), np.int64)
    seed = mix(key + mix(place.astype(np.uint64)))
    while len(at):
        u = uniform(seed[at], np.array(turn * 1_000_003 + step))
        e, reach = net.edge_first[node], node + u
        late = np.flatnonzero(net.upto[e] < reach)
        while len(late):  # on to the edge whose running probability covers the number
            e[late] += 1
            late = late[net.upto[e[late]] < reach[late]]
        got.append((at, e))
        count[at] += 1
        node = net.target[e]
        on = node >= 0
        at, node, step = at[on], node[on], step + 1
    first = np.cumsum(count) - count
    edges = np.zeros(int(count.sum()), np.int64)
    for s, (o, e) in enumerate(got):
        edges[first[o] + s] = e
    return edges, count


@dataclass(order=True)
class _Set:
    """Segmentations that share the edges of ``path`` before ``step`` and then leave the ``taken`` ones."""
    bound: float
    path: int = field(compare=False)
    step: int = field(compare=False)
    taken: tuple = field(compare=False)
    prefix: float = field(compare=False)


def _truncated(location: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Gumbels at ``location`` given that they are at most ``top``."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-top, -location + np.log(-np.log(u)))


class Search:
    """The samples of one text; ``fresh(turn)`` gives (edges, edges per unit) of a newly sampled path."""

    def __init__(self, net: Lattices, key: int, fresh):
        self.net, self.key, self.fresh = net, key, fresh
        self.paths, self.queue, self.found = [], [], []
        self.k = SAMPLES

    def _push(self, path: int, first: int, prefix: float, top: float) -> None:
        """Queue the sets that leave ``path`` at or after step ``first``."""
        edges = self.paths[path][0]
        log_p = self.net.log_p[edges[first:]]
        before = prefix + np.concatenate(([0.0], np.cumsum(log_p)[:-1]))
        n = len(log_p)
        near = int(np.searchsorted(-before, _REACH + 120.0)) if n else 0  # sets this far down come last of all
        for part in ((0, near), (near, n)):
            if part[0] == part[1] or (part[0] and len(self.queue) > 2 * self.k + 2):
                continue
            s = slice(*part)
            with np.errstate(divide="ignore"):
                location = before[s] + np.log(np.maximum(-np.expm1(log_p[s]), 0.0))
            u = uniform(self.key, 7 + path if path < 4 else 100 + path, np.arange(first + part[0], first + part[1]))
            bound = _truncated(location, top, u)
            some = np.flatnonzero(np.isfinite(location))
            if len(some) > self.k + 1:
                some = some[np.argsort(-bound[some], kind="stable")[:self.k + 1]]  # no more can be opened
            for i in some.tolist():
                t = first + part[0] + i
                heapq.heappush(self.queue, _Set(-bound[i], path, t, (int(edges[t]),), float(before[part[0] + i])))

    def run(self, k: int) -> float:
        """Fill ``found`` with up to k (edges, log probability, perturbed); returns the next maximum, -inf if none."""
        self.k = k
        edges, counts = self.fresh(0)
        top = float(-np.log(-np.log(uniform(self.key, 3))))
        self.paths.append((edges, counts))
        self.found.append((edges, float(self.net.log_p[edges].sum()), top))
        self._push(0, 0, 0.0, top)
        while len(self.found) < k and self.queue:
            s = heapq.heappop(self.queue)
            self._open(s)
        return -self.queue[0].bound if self.queue else -np.inf

    def _open(self, s: _Set) -> None:
        net, top, turn = self.net, -s.bound, len(self.found)
        old, counts = self.paths[s.path]
        node = int(np.searchsorted(net.edge_first, s.taken[0], "right")) - 1
        rest = np.array([e for e in range(net.edge_first[node], net.edge_first[node + 1]) if e not in s.taken])
        share = np.cumsum(np.exp(net.log_p[rest]))
        u = uniform(self.key, 11, turn)
        e = int(rest[min(int(np.searchsorted(share, u * share[-1])), len(rest) - 1)])
        left = share[-1] - np.exp(net.log_p[e])
        ends = np.cumsum(counts)
        unit = int(np.searchsorted(ends, s.step, "right"))
        new, step = [*old[:s.step].tolist(), e], 0
        node = int(net.target[e])
        while node >= 0:  # to the end of the unit
            x = int(np.searchsorted(net.upto, node + uniform(self.key, 13, turn, step), "left"))
            new.append(x)
            node, step = int(net.target[x]), step + 1
        fresh, fresh_counts = self.fresh(turn)
        skip = int(fresh_counts[:unit + 1].sum())
        own = len(new) - (int(ends[unit - 1]) if unit else 0)
        edges = np.concatenate((np.array(new, np.int64), fresh[skip:]))
        counts = np.concatenate((counts[:unit], [own], fresh_counts[unit + 1:]))
        self.paths.append((edges, counts))
        self.found.append((edges, float(net.log_p[edges].sum()), top))
        if len(rest) > 1 and left > 1e-15:
            location = s.prefix + np.log(left)
            bound = float(_truncated(np.array(location), top, uniform(self.key, 17, turn)))
            heapq.heappush(self.queue, _Set(-bound, s.path, s.step, (*s.taken, e), s.prefix))
        self._push(len(self.paths) - 1, s.step + 1, s.prefix + float(net.log_p[e]), top)


def piece_ids(net: Lattices, edges: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of edges, row offsets in them) for row offsets ``at``; a fallback edge gives its bytes' ids."""
    piece = net.piece[edges]
    few = np.flatnonzero(piece < 0)
    if not len(few):
        return piece, at
    spelled = net.spelled[-1 - piece[few]]
    n = np.ones(len(piece), np.int64)
    n[few] = (spelled >= 0).sum(1)
    out, ends = np.repeat(piece, n), np.cumsum(n)
    first = ends - n
    for k in range(4):
        has = spelled[:, k] >= 0
        out[first[few[has]] + k] = spelled[has, k]
    return out, np.concatenate(([0], ends))[at]


def segment(buf: np.ndarray, at: np.ndarray, keys: np.ndarray, known: Known, k: int = SAMPLES):
    """Yield (row, samples, next maximum, ids per sample, round trip per sample) of one slice; ``buf``: with the leading space."""
    start, end, row = units(buf, at)
    net, unit = known.lattices(buf, start, end)
    vocab = known.vocab
    bounds = np.searchsorted(row, np.arange(len(at)))
    place = np.arange(len(row)) - bounds[row]
    drawn = [sample_units(net, unit, keys[row], place, turn) if len(unit) else None for turn in range(k)]
    offsets = [np.concatenate(([0], np.cumsum(c))) for _, c in drawn] if len(unit) else []
    full = [r for r in range(len(at) - 1) if bounds[r] < bounds[r + 1]]
    texts, thresholds = [], []
    for r in full:
        a, b = bounds[r], bounds[r + 1]
        search = Search(net, int(keys[r]), lambda t: (drawn[t][0][offsets[t][a]:offsets[t][b]], drawn[t][1][a:b]))
        thresholds.append(search.run(k))
        texts.append(search.found)
    paths = [e for found in texts for e, _, _ in found]
    if not paths:
        return
    ids, ends = piece_ids(net, np.concatenate(paths), np.cumsum([0, *map(len, paths)]))
    raw, size = vocab.decode(ids), np.concatenate(([0], np.cumsum(vocab.lengths[ids])))[ends]
    n = 0
    for r, found, rest in zip(full, texts, thresholds):
        of = range(n, n := n + len(found))
        yield (r, found, rest, [ids[ends[j]:ends[j + 1]] for j in of],
               [np.array_equal(raw[size[j]:size[j + 1]], buf[at[r]:at[r + 1]]) for j in of])


def with_leading_space(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every non-empty row with the model's leading space, U+2581 as a space."""
    full = np.diff(at) > 0
    out = np.insert(buf, at[:-1][full], np.uint8(_SPACE))
    new = at + np.concatenate(([0], np.cumsum(full)))
    mark = np.flatnonzero((out[:-2] == 0xE2) & (out[1:-1] == 0x96) & (out[2:] == 0x81)) if len(out) > 2 else []
    if len(mark):
        keep = np.ones(len(out), bool)
        out = out.copy()
        out[mark] = _SPACE
        keep[mark + 1] = keep[mark + 2] = False
        new = np.concatenate(([0], np.cumsum(keep)))[new]
        out = out[keep]
    return out, new


def log_inclusion(log_p: float, threshold: float) -> float:
    """Logarithm of the chance 1 - exp(-exp(log_p - threshold)) to be above the threshold."""
    x = log_p - threshold
    return x if x < -30 else 0.0 if x > 30 else float(np.log(-np.expm1(-np.exp(x))))


def sample(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", k: int = SAMPLES) -> DataFrame:
    """A row per sample: its piece ids (``pieces``: 32 bits each, little-endian, as training files hold them), scores,
    and whether decoding gives the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(Vocabulary(model))
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
        for batch in batches:
            keys = batch.column(2).to_numpy().astype(np.int64).view(np.uint64)
            ids_in = batch.column(0).to_pylist()
            for a, b, buf, at in chunks(batch.column(1)):
                rows = [(ids_in[a + r], 0, b"", 0.0, 0.0, 0.0, True) for r in np.flatnonzero(np.diff(at) == 0)]
                own, places = with_leading_space(buf, at)
                for r, found, rest, ids, same in segment(own, places, keys[a:b], known, k):
                    for j, ((_, log_p, top), i) in enumerate(zip(found, ids)):
                        rows.append((ids_in[a + r], j, i.astype("<u4").tobytes(), log_p, top,
                                     log_inclusion(log_p, rest), same[j]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    filled = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), filled.alias("text"), F.xxhash64(doc_id).alias("key")).mapInArrow(run, SCHEMA)
