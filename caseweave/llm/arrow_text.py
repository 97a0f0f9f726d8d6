"""Small numpy helpers over Arrow text columns, used inside tasks."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: Bytes of text that one numpy pass works on; temporary arrays are some 60 times as large.
CHUNK_BYTES = 1 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_WORD_BREAK = np.zeros(256, bool)
_WORD_BREAK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value (SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))
_powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(4095, _BASE))), dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, _BASE))), dtype=np.uint64)
    return _powers


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them) of slices of about ``limit`` bytes.

    A row is never cut, so a slice holds at least one row. Null counts as empty text.
    """
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, buf[at[row]:at[end]], at[row:end + 1] - at[row]
        row = end


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words, runs of bytes outside space and 09-0D, of one slice."""
    n = len(buf)
    gap = _WORD_BREAK[buf]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a row's end is a break even without a space
    begins = ~gap & (np.concatenate(([True], gap[:-1])) | first[:n]) if n else np.zeros(0, bool)
    ends = ~gap & (np.concatenate((gap[1:], [True])) | first[1:]) if n else np.zeros(0, bool)
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: polynomials of randomised byte values, then mixed."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    total = int(size.sum())
    first = np.cumsum(size) - size
    local = np.arange(total) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        terms = _BYTE[buf[local + np.repeat(start, size)]] * _power_table(int(size.max()))[local]
        return mix(np.add.reduceat(terms, first))


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all runs of ``width`` words of a row; a row of fewer words is one shingle, of none has none."""
    if not len(hashes):
        return hashes, row
    out = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _BASE + hashes[k:k + len(out)]
    whole = row[:len(out)] == row[width - 1:] if len(out) else np.zeros(0, bool)
    full, of = mix(out[whole]), row[:len(out)][whole]
    count = np.bincount(row, minlength=rows)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(row, short)
        few = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width - 1):
                has = count[short] > k
                few[has] = few[has] * _BASE + hashes[first[has] + k]
        full, of = np.concatenate((full, mix(few))), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        full, of = full[order], of[order]
    return full, of


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with as many underscores as it takes to differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def with_text_function(df: DataFrame, text: str, name: str, kind: T.StructType,
                       make: Callable[[], Callable[[pa.Array], pa.StructArray]]) -> DataFrame:
    """``df`` with a struct column ``name`` of ``make()(texts)``; ``make`` runs once a task."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows:
                new = fn(batch.column(batch.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def struct_of(names: Sequence[str], arrays: Sequence) -> pa.StructArray:
    return pa.StructArray.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=list(names))
