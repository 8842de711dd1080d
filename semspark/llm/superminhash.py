"""SuperMinHash signatures (Ertl 2017): every element ranks the signature's places by a random permutation.

Element x puts ``j + r_j`` at the j-th place of its permutation; a place keeps the smallest value. Once every
place holds a value under j + 1, no later rank of any element can lower one, so the work stops early.
"""

from __future__ import annotations

import numpy as np

from .texthash import U, mix

_RANK = 50
_FILL = U(1 << 63)


def signatures(elements: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """uint64 matrix, a row for each set ``elements[index[i]:index[i+1]]`` (repeats do no harm).

    ``size`` is a power of two. Rows of empty sets hold the fill value throughout.
    """
    bits = size.bit_length() - 1
    n = len(index) - 1
    out = np.full(n * size, _FILL, U)
    owner = np.repeat(np.arange(n), np.diff(index))
    low = U((1 << _RANK) - 1)
    with np.errstate(over="ignore"):
        draw = mix(elements ^ U(0x2545F4914F6CDD1D))
        first = (draw >> U(64 - bits)).astype(np.int64)
        np.minimum.at(out, owner * size + first, draw & low)
        matrix, rank = out.reshape(n, size), 1
        open_ = (matrix == _FILL).any(axis=1) & (np.diff(index) > 0)
        keep = open_[owner]
        seeds, owner, first = elements[keep], owner[keep], first[keep]
        places = None
        while len(seeds):
            draw = mix(seeds + U(rank) * U(0x9E3779B97F4A7C15))
            step = rank + ((draw >> U(_RANK)).astype(np.int64) * (size - rank) >> (64 - _RANK))
            if rank == 1:  # only the first swap can have moved a place
                place = np.where(step == first, 0, step)
                second = step
            else:
                if places is None:
                    places = np.tile(np.arange(size, dtype=np.int16), (len(seeds), 1))
                    rows = np.arange(len(seeds))
                    for at, swap in ((0, first), (1, second)):
                        places[rows, at], places[rows, swap] = places[rows, swap], places[rows, at].copy()
                rows = np.arange(len(seeds))
                place = places[rows, step].astype(np.int64)
                places[rows, step] = places[rows, rank]
                places[rows, rank] = place
            np.minimum.at(out, owner * size + place, (draw & low) | U(rank << _RANK))
            rank += 1
            still = open_ & (matrix.max(axis=1) >= U(rank << _RANK))
            if rank == size:
                break
            if not np.array_equal(still, open_):
                keep = still[owner]
                seeds, owner, first, second = seeds[keep], owner[keep], first[keep], second[keep]
                places = places[keep] if places is not None else None
                open_ = still
    return matrix


def band_keys(matrix: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of consecutive places; equal keys mean that the band's values agree."""
    n, size = matrix.shape
    rows = size // bands
    with np.errstate(over="ignore"):
        key = np.repeat(mix(np.arange(1, bands + 1, dtype=U))[None, :], n, axis=0)
        parts = matrix.reshape(n, bands, rows)
        for k in range(rows):
            key = mix(key * U(0x9FB21C651E98DF25) + parts[:, :, k])
    return key
