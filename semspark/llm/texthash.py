"""Vectorised hashing of words and word shingles over Arrow string buffers.

A word is mixed into its hash eight bytes at a time, so that no Python object is made for a word. Two words of one
length up to eight bytes never have the same hash, and no fixed words of other lengths are known that do. ASCII
capitals count as the small letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions.hashing import U, mix

#: Keys of the hashes: one for words and pieces, another for the second half of 128-bit fingerprints.
KEY, SECOND_KEY = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Longer spans are hashed one by one.
LONG = 64


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The low 0 to 8 bytes of a word of eight.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros after the end, as little-endian numbers (a view of overlapping parts)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: tuple[int, ...] = (KEY,)) -> list[np.ndarray]:
    """Hashes of the given spans of bytes, an array for each key. Arrays of several keys are independent."""
    size = ends - starts
    eight = eights(data)
    chunk = eight[starts] & MASKS[np.minimum(size, 8)]
    with np.errstate(over="ignore"):
        out = [mix(mix(size.astype(U) * U(0xD1342543DE82EF95) + U(key)) ^ chunk) for key in keys]
    rows = np.flatnonzero((size > 8) & (size <= LONG))
    at, left = starts[rows] + 8, size[rows] - 8
    while len(rows):
        chunk = eight[at] & MASKS[np.minimum(left, 8)]
        for state in out:
            state[rows] = mix(state[rows] ^ chunk)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for row in np.flatnonzero(size > LONG).tolist():
        span = data[starts[row] : ends[row]].tobytes()
        for state, key in zip(out, keys, strict=True):
            state[row] = int.from_bytes(hashlib.blake2b(span, digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of whole texts of about ``limit`` bytes: (first row, bytes, offsets).

    It bounds the scratch memory, not the texts: a longer text makes a run of its own.
    """
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (n+1 entries).

    With ``prefix`` the hashes are of the words' first bytes, that many at most.
    """
    (hashes,), index = keyed_word_hashes(data, offsets, (KEY,), prefix)
    return hashes, index


def keyed_word_hashes(data: np.ndarray, offsets: np.ndarray, keys: tuple[int, ...], prefix: int | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """As ``word_hashes``, with an array of hashes for each key."""
    n = len(data)
    if not n:
        return [np.zeros(0, U) for _ in keys], np.zeros(len(offsets), np.int64)
    letter = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    start = letter.copy()
    start[1:] &= ~letter[:-1] | first[1:n]
    end = letter.copy()
    end[:-1] &= ~letter[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    if prefix is not None:
        ends = np.minimum(ends, starts + prefix)
    return span_hashes(_LOWER[data], starts, ends, keys), np.searchsorted(starts, offsets)


_STEPS = mix(np.arange(101, 164, dtype=U)) | U(1)


def shingle_hashes(words: np.ndarray, index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in order, and the index of each text's first.

    A text with fewer words has its whole sequence as the only one; one without words has none.
    """
    counts = np.diff(index)
    each = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_index = np.concatenate([[0], np.cumsum(each)])
    owner = np.repeat(np.arange(len(counts)), each)
    at = index[:-1][owner] + np.arange(out_index[-1]) - out_index[:-1][owner]
    short = counts[owner] < size
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), U)
        padded = np.concatenate([words, np.zeros(size, U)])
        for k in range(size):
            part = padded[at + k] * _STEPS[k]
            if short.any():
                part[short & (k >= counts[owner])] = 0
            total += part
        total += np.minimum(counts[owner], size).astype(U) * _STEPS[62]
    return mix(total), out_index
