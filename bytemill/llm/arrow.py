"""Arrow and NumPy helpers shared by the operators: UTF-8 buffers, words, 64-bit hashes, groups in a stream."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of the Arrow batches that Spark hands to Python; sessions that ask for less keep theirs.
BATCH_BYTES, BATCH_KEY = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

U64 = np.uint64
#: White space of the word rule: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def release() -> None:
    """Gives memory that is free back to the system: Python workers live on, and so would the peak of each task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes, and with memory released when a task ends."""
    conf = df.sparkSession.conf
    size = re.fullmatch(r"(\d+)([kmgt]?)b?", conf.get(BATCH_KEY).strip().lower())
    if not size or not 0 < int(size[1]) << 10 * " kmgt".index(size[2] or " ") <= BATCH_BYTES:
        conf.set(BATCH_KEY, str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers that depend on the seed alone."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15)) | U64(1)


#: Masks of the first 0 to 8 bytes of a little-endian word; bytes from which a span is long; bytes that are looked at together.
_FRONT = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U64)
LONG, STEP = 64, 4 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column and their offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `most` bytes of text (a longer text makes a piece of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in data, and its row. No word crosses the border of two rows."""
    n, starts, ends = len(data), [], []
    for a in range(0, n, STEP):
        b = min(n, a + STEP)
        low, high = max(a - 1, 0), min(b + 1, n)
        solid = np.zeros(b - a + 2, dtype=bool)  # with the byte before and the byte behind
        solid[low - a + 1 : high - a + 1] = ~SPACE[data[low:high]]
        new = np.zeros(b - a + 1, dtype=bool)
        new[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, side="right")] - a] = True
        starts.append(np.flatnonzero(solid[1:-1] & (~solid[:-2] | new[:-1])) + a)
        ends.append(np.flatnonzero(solid[1:-1] & (~solid[2:] | new[1:])) + a + 1)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = np.concatenate(starts), np.concatenate(ends)
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end].

    Eight bytes at a time go through a bijective mixer that starts from the length, so spans of equal length up to eight bytes never
    collide, and longer ones have no algebraic way to. Spans of more than LONG bytes get a cryptographic digest.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each byte on
    out = np.empty(len(start), dtype=U64)
    for i in range(0, len(start), STEP // 8):
        a, b = start[i : i + STEP // 8], end[i : i + STEP // 8]
        size = b - a
        h = mix(size.astype(U64) + U64(0x9E3779B97F4A7C15))
        live = np.flatnonzero(size <= LONG)
        for k in range(0, LONG, 8):
            live = live[size[live] > k]
            if not len(live):
                break
            h[live] = mix(h[live] ^ (at[a[live] + k] & _FRONT[np.minimum(size[live] - k, 8)]))
        for j in np.flatnonzero(size > LONG).tolist():
            h[j] = int.from_bytes(hashlib.blake2b(padded[a[j] : b[j]], digest_size=8).digest(), "little")
        out[i : i + len(a)] = h
    return out


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables with all rows of one key, out of batches that are sorted by the key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)
