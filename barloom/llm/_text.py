"""Vectorised text helpers over Arrow buffers: slices of whole texts, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that one slice holds (a longer text is a slice of its own).
SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); overwrites nothing."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0x5851F42D4C957F2D % 2**64))


_BYTE = stream(256, 1)
_PLACE = stream(4096, 2) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SIGN = _SPACE.copy()  # space and every other ASCII byte that is no letter or digit
_SIGN[:128] |= ~np.isin(np.arange(128), [*range(48, 58), *range(65, 91), *range(97, 123)])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string column; null is empty."""
    column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets from 0)`` of runs of whole texts."""
    at, data = text_buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    if size and n:
        pa.default_memory_pool().release_unused()  # workers stay between stages; what they hold counts


def words(data: np.ndarray, at: np.ndarray, *, signs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z folded, split at space and U+0009 to U+000D; with ``signs``
    at ASCII signs too), and the offset of every text's first word among them (one more than texts)."""
    apart = _SIGN if signs else _SPACE
    if not len(data):
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    space = apart[data]
    first = ~space
    first[1:] &= space[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = ~space[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    data, at = data[starts[0] :], at - starts[0]
    starts = starts - starts[0]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = np.where(apart, U(0), _BYTE[_LOWER])[data]
    if place.max() < 4096:
        value *= _PLACE[place]
    else:  # the same factors for places under 4096, whatever else the slice holds
        value *= _PLACE[place & 4095] + (place >> 12).astype(U) * U(0x9E3779B97F4A7C16)
    return mix(np.add.reduceat(value, starts)), np.searchsorted(starts, at)


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs of every text and the text of each; a text with 1 to n-1 words
    gives its whole sequence as one."""
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    left = first[1:][row] - np.arange(len(hashes))  # words from here to the end of the text
    h = hashes.copy()
    padded = np.concatenate([hashes, np.zeros(n, U)])
    for k in range(1, n):
        h = mix(h * U(0x9E3779B97F4A7C15) + np.where(left > k, padded[k : k + len(h)], U(0)))
    short = (counts < n)[row]
    keep = (left >= n) | (short & (left == counts[row]))
    h[short] ^= left[short].astype(U)  # a short sequence never equals a longer one
    return h[keep], row[keep]
