"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts and benchmark items are reduced to lower-case words with single spaces. An item of m bytes that occurs with at
most k edits shares at least m - q + 1 - k q of its q-grams with the text, on diagonals that lie within 2 k of each
other (the q-gram lemma). q is 10, or less for short items, so that the bound is one q-gram at least. Shared q-grams
are counted in overlapping diagonal bands; bands that reach the bound are verified by an alignment of the whole item
inside the band. Items of fewer than ten bytes have to stand between word bounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, short, written
from .texthash import MASKS, U, eights, mix

#: Bytes of a q-gram, less for items that allow edits in fewer than 20 bytes or are shorter.
Q = 10
#: Edits allowed, as a share of the item's length.
EDITS = 0.06
#: Bytes of benchmark text that are searched for in one pass over the documents.
BLOCK_BYTES = 4 << 20
#: Texts of about this many bytes are searched at once; a longer one is read in slices of so many, and shared q-grams are
#: counted so many at a time, whichever texts and items they are of.
CHUNK_BYTES, HITS = 1 << 20, 1 << 19
#: Diagonals of a region that an item is aligned with at once.
REGION = 1 << 16

_NOT_WORD = re.compile(r"[\W_]+")


def normalised(text: str | None) -> bytes:
    """Lower-case words with single spaces. A long text is reduced in windows that end between words."""
    low = (text or "").lower()
    parts, at = [], 0
    while at < len(low):
        stop = _NOT_WORD.search(low, at + CHUNK_BYTES)
        end = stop.start() if stop else len(low)
        parts.append(_NOT_WORD.sub(" ", low[at:end]).strip().encode("utf-8", "replace"))
        at = end
    return b" ".join(p for p in parts if p)


def pattern(text: str | None) -> bytes:
    """The bytes that are searched for: the reduced item, with its word bounds if it has fewer than Q bytes."""
    reduced = normalised(text)
    return b" " + reduced + b" " if 0 < len(reduced) < Q else reduced


def edits_of(item: bytes) -> int:
    return int(len(item) * EDITS)


def gram_size(item: bytes) -> int:
    """The largest q up to Q with which the lemma asks for one shared q-gram at least."""
    return min(Q, len(item) // (edits_of(item) + 1))


def indexes(items: list[tuple[int, str]]) -> list[ItemIndex]:
    """An index for each q among the items; items without words are left out."""
    by: dict[int, list[tuple[int, bytes]]] = {}
    for i, text in items:
        if item := pattern(text):
            by.setdefault(gram_size(item), []).append((i, item))
    return [ItemIndex(own, q) for q, own in sorted(by.items())]


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit value for each run of q bytes (10 at most)."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, U)
    first = eights(data)[:n] & MASKS[min(q, 8)]
    rest = np.zeros(n, U)
    for k in range(8, q):
        rest = rest << U(8) | data[k : k + n]
    with np.errstate(over="ignore"):
        return mix(first + rest * U(0x9E3779B97F4A7C15))


class ItemIndex:
    """The q-grams of benchmark items that have one q, and the edits and bound of each."""

    def __init__(self, items: list[tuple[int, bytes]], q: int):
        self.q = q
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([edits_of(t) for t in self.texts], np.int64)
        self.bound = self.length - q + 1 - self.edits * q
        self.width = 2 * self.edits + 1
        grams = [_grams(np.frombuffer(t, np.uint8), q) for t in self.texts]
        values = np.concatenate(grams) if grams else np.zeros(0, U)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(values, kind="stable")
        self.owner, self.at = owner[order].astype(np.int32), at[order].astype(np.int32)
        self.grams, self.first = np.unique(values[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(values)))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.grams >> U(44)] = True

    def hits(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float, bool]]:
        """Position in the text, item and position in the item of shared q-grams, at most ``HITS`` at a time in text
        order; with the least position that those after them can have, and whether they are all there are."""
        n = max(0, len(data) - self.q + 1)
        for first in range(0, n, CHUNK_BYTES):
            grams = _grams(data[first : first + CHUNK_BYTES + self.q - 1], self.q)
            where = np.flatnonzero(self.bits[grams >> U(44)])
            found = np.searchsorted(self.grams, grams[where])
            found[found == len(self.grams)] = 0
            good = self.grams[found] == grams[where] if len(self.grams) else np.zeros(len(where), bool)
            where, found = where[good] + first, found[good]
            low, many = self.first[found], self.count[found]
            edge = np.concatenate([[0], np.cumsum(many)])
            total = int(edge[-1])
            for a in range(0, total, HITS):
                b = min(total, a + HITS)
                i, j = int(np.searchsorted(edge, a, "right")) - 1, int(np.searchsorted(edge, b, "left"))
                own_low, own_many = low[i:j].copy(), many[i:j].copy()
                own_low[0] += a - edge[i]
                own_many[0] -= a - edge[i]
                own_many[-1] -= edge[j] - b
                after = where[int(np.searchsorted(edge, b, "right")) - 1] if b < total else first + CHUNK_BYTES
                yield *self._postings(where[i:j], own_low, own_many), after, n <= CHUNK_BYTES and total <= HITS
        none = np.zeros(0, np.int64)
        yield none, none, none, np.inf, False

    def _postings(self, where: np.ndarray, low: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edge = np.concatenate([[0], np.cumsum(many)])
        posting = np.repeat(low - edge[:-1], many) + np.arange(edge[-1])
        return np.repeat(where, many), self.owner[posting].astype(np.int64), self.at[posting].astype(np.int64)

    def candidates(self, data: np.ndarray, offsets: np.ndarray, settled: set[tuple[int, int]] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first, last) of each run of bands of diagonals that reach the bound, in pieces of about REGION;
        positions are in ``data``. Counts of bands that later q-grams may add to are carried on, all others are judged
        and forgotten. Pairs (text, item) that come to be in ``settled`` are passed over from then on."""
        pair, band, count = (np.zeros(0, np.int64) for _ in range(3))
        for where, item, at, after, alone in self.hits(data):
            if not len(where) and not len(pair):
                continue
            # A band holds twice the width and begins at each multiple of it, so that every drift fits into one band.
            text = np.searchsorted(offsets, where, "right") - 1
            here, own = text * len(self.ids) + item, (where - at) // self.width[item]
            if settled:
                open_ = ~np.isin(here, [t * len(self.ids) + i for t, i in settled])
                here, own, item = here[open_], own[open_], item[open_]
            if alone:  # few pairs of text and item share enough q-grams in all bands together
                _, code, many = np.unique(here, return_inverse=True, return_counts=True)
                enough = many[code] >= self.bound[item]
                here, own = here[enough], own[enough]
            pair, band = np.concatenate([pair, here, here]), np.concatenate([band, own, own - 1])
            count = np.concatenate([count, np.ones(2 * len(here), np.int64)])
            if not len(pair):
                continue
            order = np.lexsort((band, pair))
            pair, band, count = pair[order], band[order], count[order]
            start = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])]))
            pair, band, count = pair[start], band[start], np.add.reduceat(count, start)
            item = pair % len(self.ids)
            done = (band + 2) * self.width[item] + self.length[item] <= after
            yield from self._regions(*(x[done & (count >= self.bound[item])] for x in (pair, band)))
            pair, band, count = pair[~done], band[~done], count[~done]

    def _regions(self, pair: np.ndarray, band: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        if not len(pair):
            return
        start = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (band[1:] != band[:-1] + 1)]))
        for a, b in zip(start.tolist(), np.append(start[1:], len(pair)).tolist(), strict=True):
            t, i = divmod(int(pair[a]), len(self.ids))
            wide = int(self.width[i])
            step = max(1, REGION // wide)
            for k in range(a, b, step):
                yield t, i, int(band[k]) * wide, (int(band[min(b, k + step) - 1]) + 2) * wide


def banded_edits(item: np.ndarray, region: np.ndarray, most: int) -> int:
    """Least edits that turn ``item`` into some part of ``region``, or most + 1 if there are more."""
    n = len(region)
    row = np.zeros(n + 1, np.int64)
    steps = np.arange(n + 1)
    for k, c in enumerate(item.tolist(), 1):
        new = row + 1
        np.minimum(new[1:], row[:-1] + (region != c), out=new[1:])
        new[0] = k
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > most:
            return most + 1
    return min(int(row.min()), most + 1)


def _found(index: ItemIndex, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], int]:
    """Least edits by (text, item), of the items that occur."""
    best: dict[tuple[int, int], int] = {}
    settled: set[tuple[int, int]] = set()
    for t, i, low, high in index.candidates(data, offsets, settled):
        most = int(index.edits[i])
        if (t, i) in settled:
            continue
        a, b = max(low, int(offsets[t])), min(high + len(index.texts[i]) + most, int(offsets[t + 1]) - 1)
        region = data[a:b]
        edits = 0 if index.texts[i] in region.tobytes() else banded_edits(np.frombuffer(index.texts[i], np.uint8), region, most)
        if edits <= most:
            best[t, i] = min(edits, best.get((t, i), edits))
            if not edits:
                settled.add((t, i))
    return best


def _search(known: list[ItemIndex]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            found: list[tuple[object, int, int]] = []
            start, size, parts = 0, 0, []
            for k, text in enumerate(texts):
                parts.append(b" " + normalised(text) + b" ")
                size += len(parts[-1]) + 1
                if size < CHUNK_BYTES and k + 1 < len(texts):
                    continue
                data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
                offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
                for index in known:
                    found += [(ids[start + t].as_py(), index.ids[i], e) for (t, i), e in _found(index, data, offsets).items()]
                start, size, parts = k + 1, 0, []
            yield pa.record_batch({"doc_id": pa.array([x[0] for x in found], pa.int64()), "item_id": pa.array([x[1] for x in found], pa.int64()), "edits": pa.array([x[2] for x in found], pa.int64())})

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits): the benchmark items that occur in each text, whole, with few edits.

    A clean text has no row. Null and empty texts hold nothing; null items and items without words occur nowhere. An
    item of fewer than Q bytes once reduced occurs where it stands between word bounds, unchanged. Rows that repeat an
    id give their least number of edits once. Null ids are reported as null. An empty table of either kind gives no
    rows. The benchmark is searched for in blocks of bounded size, one pass over the documents for each, so only a
    block is ever held in memory; a block has BLOCK_BYTES of items. Extra columns of either table are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        known = indexes([(r.item_id, r.text) for r in own.orderBy("item_id").collect()])  # about BLOCK_BYTES
        part = plain.mapInArrow(_search(known), "doc_id long, item_id long, edits long")
        found = part if found is None else found.union(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item occurs (columns unchanged).

    All rows of an id go if an item occurs in one of them, null ids included. Null and empty texts stay; a benchmark
    without items drops nothing; an empty table gives no rows. The ids found are written first: up to BROADCAST_IDS of
    them are broadcast and no text is shuffled, more are joined by a shuffle of ``docs``. The helper column's name
    clashes with none of ``docs``.
    """
    (hit,) = fresh(docs.columns, "hit")
    hits = written(contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(hit)).distinct(), "hits")
    return docs.join(short(hits), F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(hit)), "left_anti")
