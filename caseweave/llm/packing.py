"""Order-preserving packing of documents into sequences by dynamic programming.

Documents follow each other in the order of their ids. Cuts between sequences lie at
document or sentence ends; of all such choices the one with the least sum of padding and
cut penalties is taken. Among the cuts within reach the best predecessor comes from a
monotone queue; the few lengths that need no padding (powers of two, at a small cost that
keeps short sequences rare) are looked up.

Defined cases: a null or empty text is its end token alone; null ids come first; rows with
equal ids follow each other in any order; a stretch longer than a sequence without a
sentence end is cut at full sequences; an empty table gives no piece; extra columns are ignored.
"""
from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

SEQUENCE = 2048
END_ID = 1
#: Documents of so many tokens are packed together; only their last sequence may end early.
BLOCK_TOKENS = 1 << 20
#: Penalties in tokens of padding.
SENTENCE_CUT = 8
HARD_CUT = 256
SHORT_SEQUENCE = 32  # of a power of two below SEQUENCE, which needs no padding

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _merges(path: str, special: list[str]):
    """The vocabulary as ranks of byte strings; None if its ids do not follow its merges."""
    import json

    import public_tokenizers
    import tiktoken
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD) and (b < 0x7F or b > 0xA0)]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    return tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenEncoder:
    """Little-endian 32-bit ids of whole texts, equal to those of the ``tokenizers`` file.

    Its merges run in ``tiktoken``, four times as fast. Texts with special tokens, those it
    gives up on, and vocabularies whose ids do not follow their merges go through ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = _merges(path, self.special)

    def __call__(self, text: str) -> bytes:
        if self.merges is not None and not any(s in text for s in self.special):
            try:
                return self.merges.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:  # the splitting pattern's backtracking limit, on huge runs of spaces
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def sentence_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By id: may end a sentence; may begin one (starts with white space)."""
        size = self.tokenizer.get_vocab_size()
        # in this byte alphabet a space is U+0120 and a line break U+010A
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        ends = np.array([t.endswith((".", "!", "?", "Ċ")) for t in tokens])
        begins = np.array([t.startswith(("Ġ", "Ċ")) for t in tokens])
        return ends, begins


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, begins: np.ndarray,
               size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(position, penalty) of the allowed cuts, 0 and the end of ``ids`` among them."""
    known = np.minimum(ids, len(ends) - 1)
    inner = np.flatnonzero(ends[known[:-1]] & begins[known[1:]]) + 1
    at = np.union1d(np.concatenate(([0], doc_ends)), inner)
    gap = np.diff(at)
    hard = [np.arange(a + size, b, size) for a, b in zip(at[:-1][gap > size], at[1:][gap > size])]
    if hard:
        at = np.union1d(at, np.concatenate(hard))
    penalty = np.full(len(at), HARD_CUT)
    penalty[np.searchsorted(at, inner)] = SENTENCE_CUT
    penalty[np.searchsorted(at, doc_ends)] = penalty[0] = 0
    return at, penalty


def exact_lengths(at: np.ndarray, size: int = SEQUENCE) -> dict[int, list[int]]:
    """Cut -> earlier cuts that are a smaller power of two away."""
    out: dict[int, list[int]] = {}
    w = 1
    while w < size:
        before = np.searchsorted(at, at - w)
        hit = np.flatnonzero((at >= w) & (at[before] == at - w))
        for j, i in zip(hit.tolist(), before[hit].tolist()):
            out.setdefault(j, []).append(i)
        w *= 2
    return out


def best_cuts(at: np.ndarray, penalty: np.ndarray, size: int = SEQUENCE) -> list[int]:
    """The cuts, first and last position included, with the least padding plus penalties."""
    short = exact_lengths(at, size)
    at, penalty = at.tolist(), penalty.tolist()
    n = len(at)
    cost, before = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(float(at[0]), 0)])
    for j in range(1, n):
        p = at[j]
        while at[queue[0][1]] < p - size:
            queue.popleft()
        key, i = queue[0]
        least = key + size - p  # cost[i] + at[i] + padding up to ``size``
        if j in short:
            for k in short[j]:
                if cost[k] + SHORT_SEQUENCE < least:
                    least, i = cost[k] + SHORT_SEQUENCE, k
        cost[j], before[j] = least + penalty[j], i
        key = cost[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out = [n - 1]
    while out[-1]:
        out.append(before[out[-1]])
    return [at[i] for i in reversed(out)]


def pack_block(docs: list[tuple[int | None, bytes]], ends: np.ndarray, begins: np.ndarray, first_sequence: int) -> tuple[list[list], int]:
    """(columns of the pieces, sequences used) of documents given as (id, token bytes)."""
    sizes = np.array([len(b) // 4 for _, b in docs])
    doc_ends = np.cumsum(sizes)
    stream = b"".join([b for _, b in docs])
    at, penalty = candidates(np.frombuffer(stream, "<u4"), doc_ends, ends, begins)
    cuts = np.array(best_cuts(at, penalty))
    doc_starts = doc_ends - sizes
    edges = np.union1d(cuts, np.concatenate(([0], doc_ends)))
    a, b = edges[:-1], edges[1:]
    doc = np.searchsorted(doc_ends, a, "right")
    seq = np.searchsorted(cuts, a, "right") - 1
    crc = [zlib.crc32(stream[4 * x:4 * y]) for x, y in zip(a.tolist(), b.tolist())]
    return [[docs[i][0] for i in doc.tolist()], a - doc_starts[doc], b - a, crc, sizes[doc], seq + first_sequence,
            a - cuts[seq]], len(cuts) - 1


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are range-partitioned and sorted by id; a task packs them block by block.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TokenEncoder(tokenizer)
        ends, begins = encode.sentence_tables()
        sequence = TaskContext.get().partitionId() << 32
        end = np.array([END_ID], "<u4").tobytes()
        block: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            columns, used = pack_block(block, ends, begins, sequence)
            sequence += used
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                              names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(t.as_py() or "") + end
                block.append((i, ids))
                size += len(ids) // 4
                if size >= BLOCK_TOKENS:
                    yield flush()
                    block, size = [], 0
        if block:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, SCHEMA)
