"""NumPy kernels over whole Arrow batches of binary values: no loop runs per value or per byte."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from bytemill.schema import TOP_PAIRS

#: Graphic ASCII, space, tab, line feed, carriage return.
PRINTABLE = np.zeros(256)
PRINTABLE[[9, 10, 13, *range(32, 127)]] = 1
#: 0-9, A-F, a-f.
HEX_DIGITS = np.zeros(256)
HEX_DIGITS[[*range(48, 58), *range(65, 71), *range(97, 103)]] = 1


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and the offsets of its values; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of 256 counts per value."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    return np.bincount(owner * 256 + data, minlength=256 * n).reshape(n, 256)


def entropy(count: np.ndarray) -> np.ndarray:
    """Shannon entropy in bits per byte; 0 for no bytes."""
    total = count.sum(axis=1)
    logs = np.log2(np.maximum(count, 1))
    return np.where(total > 0, np.log2(np.maximum(total, 1)) - (count * logs).sum(axis=1) / np.maximum(total, 1), 0.0) + 0.0


def share(count: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Share of the bytes that are members; 0 for no bytes."""
    return count @ members / np.maximum(count.sum(axis=1), 1)


def mean_variance(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance of the byte values, from exact integer sums."""
    n, value = np.maximum(count.sum(axis=1), 1), np.arange(256)
    s, s2 = count @ value, count @ (value * value)
    return s / n, np.maximum(n * s2 - s * s, 0) / (n.astype(np.float64) * n)


def top_pairs(data: np.ndarray, offsets: np.ndarray, k: int = TOP_PAIRS) -> np.ndarray:
    """Shares of the k most frequent pairs of neighbouring bytes of each value, largest first, 0 where there are fewer."""
    n = len(offsets) - 1
    out = np.zeros((n, k))
    if len(data) < 2:
        return out
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    same = owner[1:] == owner[:-1]
    code = np.sort(((owner[:-1] << 16) | (data[:-1].astype(np.int64) << 8) | data[1:])[same])
    if not len(code):
        return out
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    count, owner = np.diff(np.append(first, len(code))), code[first] >> 16
    by = np.lexsort((-count, owner))
    count, owner = count[by], owner[by]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    top = rank < k
    out[owner[top], rank[top]] = count[top] / (np.diff(offsets)[owner[top]] - 1)
    return out


def features(column: pa.Array) -> np.ndarray:
    """The features of each value, in the order of schema.FEATURES."""
    data, offsets = flat(column)
    c, length = counts(data, offsets), np.diff(offsets)
    mean, variance = mean_variance(c)
    hist = c / np.maximum(length, 1)[:, None]
    return np.column_stack([length, entropy(c), share(c, PRINTABLE), mean, variance, hist, top_pairs(data, offsets)])


def window_labels(data: bytes | np.ndarray, window: int, printable: float, high_entropy: float, hexes: float) -> np.ndarray:
    """Whether each window of the bytes is text: printable enough, of low entropy, and not nearly all hex digits."""
    data = np.frombuffer(data, dtype=np.uint8) if isinstance(data, (bytes, memoryview)) else data
    offsets = np.append(np.arange(0, len(data), window), len(data))
    c = counts(data, offsets)
    return (share(c, PRINTABLE) >= printable) & (entropy(c) < high_entropy) & (share(c, HEX_DIGITS) < hexes)
