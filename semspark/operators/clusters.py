"""Greedy clusters of near neighbours, for components of any size.

The rule is sequential: anchors in id order take those of their hits that no one has. What an anchor does depends only on
lesser anchors that touch the same ids. So ids are cut into ranges, a task decides the anchors of its range that depend on
no open anchor of a lower range, and rounds follow until all are decided. The lowest open range is always decided whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import spread_join
from ..runtime.shared import FEW, few, written

#: Hits of a range, about.
RANGE_HITS = 500_000
_DECIDED = "anchor long, members array<long>, open boolean"


def greedy(hits: dict[int, list[int]]) -> list[list[int]]:
    """Clusters: anchors in id order take their hits that nobody has; the anchor comes last in its cluster."""
    return [[*own, anchor] for anchor, own in _decided(sorted(hits.items()), set()) if own]


def _decided(anchors: Iterable[tuple[int, list[int]]], unsure: set[int]) -> Iterator[tuple[int, list[int] | None]]:
    """(anchor, what it takes) of anchors in id order; None for those that have to wait for anchors elsewhere, which
    may still take one of the ids in ``unsure``."""
    seen: set[int] = set()
    unsure = set(unsure)
    for anchor, hits in anchors:
        if anchor in seen:
            continue
        own = [h for h in dict.fromkeys(hits) if h != anchor and h not in seen]
        if not unsure.isdisjoint(own) or anchor in unsure:
            unsure.update(own)
            unsure.add(anchor)
            yield anchor, None
            continue
        if own:
            seen.update(own)
            seen.add(anchor)
        yield anchor, own


def _decide(group: pa.Table) -> pa.Table:
    ids, hits, scores = (np.asarray(group.column(c)) for c in ("id", "hit", "score"))
    order = np.lexsort((hits, -scores, ids))
    unsure = set(hits[np.asarray(group.column("hit_low"))].tolist()) | set(ids[np.asarray(group.column("id_low"))].tolist())
    ids, hits = ids[order], hits[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    lists = zip(ids[first].tolist(), (part.tolist() for part in np.split(hits, first[1:])), strict=True)
    rows = list(_decided(lists, unsure))
    return pa.table({"anchor": pa.array([a for a, _ in rows], pa.int64()), "members": pa.array([[*own, a] if own else None for a, own in rows], pa.list_(pa.int64())), "open": pa.array([own is None for _, own in rows], pa.bool_())})


def _ranges(bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(np.array(bounds, np.int64), np.asarray(batch.column(0)), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["id", "hit", "score", "part"])

    return run


def _lower(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(ids that open anchors of several ranges touch, with the lowest of these; whether there are few)."""
    touched = rows.select(F.col("id").alias("x"), "part").union(rows.select("hit", "part"))
    low = written(touched.groupBy("x").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("x", "low"), "low")
    return low, low.count() <= FEW


def _joined(left: DataFrame, right: DataFrame, key: str, how: str, small: bool) -> DataFrame:
    return left.join(F.broadcast(right), key, how) if small else spread_join(left, right, [key], how)


def clusters(hits: DataFrame, range_hits: int = RANGE_HITS) -> DataFrame:
    """(cluster_id, members): greedy clusters of directed hits (id, hit, score); hits of one anchor count by falling
    score, ties by id. Members come in the order in which they were taken, the anchor last, and cluster_id is the least.
    An id is in one cluster at most. No hits give no rows; hits of an id to itself and repeated ones change nothing.

    A task holds about ``range_hits`` hits, whatever the components' sizes. Each round is written to the shared folder;
    there are as many rounds as ranges at most, one for hits that fit into one range.
    """
    edges = written(hits.where("id <> hit").select("id", "hit", "score"), "edges")
    ranges = -(-edges.count() // range_hits)
    bounds = []
    if ranges > 1:
        shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
        bounds = sorted(set(edges.agg(F.percentile_approx("id", shares, F.lit(100 * ranges))).first()[0]))
    rows = edges.mapInArrow(_ranges(bounds), "id long, hit long, score float, part int")
    found = None
    while True:
        if bounds:
            low, small = _lower(rows)
            marked = _joined(rows, low.select(F.col("x").alias("hit"), F.col("low").alias("hit_at")), "hit", "left", small)
            marked = _joined(marked, low.select(F.col("x").alias("id"), F.col("low").alias("id_at")), "id", "left", small)
            lower = lambda c: F.coalesce(F.col(c) < F.col("part"), F.lit(False))
            marked = marked.select("id", "hit", "score", "part", lower("hit_at").alias("hit_low"), lower("id_at").alias("id_low"))
        else:
            marked = rows.select("*", F.lit(False).alias("hit_low"), F.lit(False).alias("id_low"))
        decided = written(marked.groupBy("part").applyInArrow(_decide, _DECIDED), "decided")
        made = decided.where("members is not null").select(F.array_min("members").alias("cluster_id"), "members")
        found = made if found is None else found.union(made)
        waiting = decided.where("open")
        if not bounds or waiting.isEmpty():
            return found
        taken = written(made.select(F.explode("members").alias("x")), "taken")
        small = taken.count() <= FEW
        left = rows.join(few(written(waiting.select(F.col("anchor").alias("id")), "waiting")), "id", "left_semi")
        for end in ("id", "hit"):
            left = _joined(left, taken.select(F.col("x").alias(end)), end, "left_anti", small)
        rows = written(left.select("id", "hit", "score", "part"), "edges")
