"""Approximate nearest neighbours by navigable small-world graphs, one for each cell of the vectors.

Cells are the vectors nearest to each of a sample of them. A cell has 32,768 vectors, or twice the square root of their
number if that is more, so work grows with the power 1.5 of the rows at most, and shuffled bytes in proportion. A vector is in
one cell and is searched for in the ``probes`` nearest ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime.shared import few, written

#: Vectors of a cell at least, and cells at most; the centres, a sample of the vectors, go to every task.
CELL, CELLS = 32_768, 65_536
#: Vectors of a graph, and vectors that a task searches for in it, at most; larger cells are cut into several graphs, all
#: of which are searched.
GRAPH, SEARCHED = 100_000, 200_000
#: Vectors searched for side by side, points of a beam that are expanded at once, and vectors that every search begins with.
SIDE, EXPAND, ENTRIES = 256, 4, 64
#: Vectors that the probed cells are fitted on, and those of a graph that its beam is fitted on, at most; all are compared
#: with every vector. A beam that would be wider than BEAM points gives way to comparing all vectors of the graph.
FIT, FIT_BEAM, BEAM = 256, 64, 2048
#: Candidates that a new point's links are chosen from, as a multiple of their number.
SPARE = 2


class SmallWorld:
    """A navigable small-world graph (after Malkov and Yashunin) over unit vectors, in the order given, which should be
    random: early points get the long links.

    Each point has ``m`` links of its own, to near points that are not nearer to one another than to it, and ``m`` more
    from the nearest of the points that link to it. Points are inserted in batches and searched for side by side, by
    beams of ``ef`` points.
    """

    def __init__(self, vectors: np.ndarray, m: int = 32, ef: int = 128):
        self.vectors, self.m = np.ascontiguousarray(vectors, np.float32), max(2, m)
        n = len(vectors)
        self.links = np.full((n, 2 * self.m), -1, np.int32)
        self._back = np.full((n, self.m), -np.inf, np.float32)
        done = 0
        while done < n:
            end = min(n, done + min(max(ENTRIES, done // 4), 4 * SIDE))
            self._insert(done, end, max(ef, SPARE * self.m))
            done = end

    def _insert(self, first: int, end: int, ef: int) -> None:
        new = self.vectors[first:end]
        score = new @ new.T
        np.fill_diagonal(score, -np.inf)
        keep = min(self.m, end - first)
        at = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
        ids, values = at + first, np.take_along_axis(score, at, 1)
        if first:
            old_ids, old_values = self.search(new, ef, first)
            ids, values = np.concatenate([ids, old_ids], 1), np.concatenate([values, old_values], 1)
        order = np.argsort(-values, axis=1, kind="stable")[:, : SPARE * self.m]
        ids, values = np.take_along_axis(ids, order, 1), np.take_along_axis(values, order, 1)
        for k in range(0, len(ids), SIDE):
            self._link(first + k, ids[k : k + SIDE], values[k : k + SIDE])

    def _link(self, first: int, ids: np.ndarray, values: np.ndarray) -> None:
        """Links of the points from ``first`` on, from candidates by falling score."""
        there = values > -np.inf
        near = self.vectors[np.where(there, ids, 0)]
        between = near @ near.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            hidden = (chosen[:, :j] & (between[:, :j, j] > values[:, j : j + 1])).any(1)
            chosen[:, j] = there[:, j] & ~hidden & (chosen.sum(1) < self.m)
        # Places that are left go to the nearest of the others.
        rank = np.argsort(np.where(chosen, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, : self.m]
        own, value = np.take_along_axis(ids, rank, 1), np.take_along_axis(values, rank, 1)
        own[value == -np.inf] = -1
        self.links[first : first + len(own), : own.shape[1]] = own
        self._link_back(np.repeat(np.arange(first, first + len(own)), own.shape[1]), own.ravel(), value.ravel())

    def _link_back(self, source: np.ndarray, target: np.ndarray, value: np.ndarray) -> None:
        real = target >= 0
        source, target, value = source[real], target[real], value[real]
        order = np.lexsort((-value, target))
        source, target, value = source[order], target[order], value[order]
        points, start = np.unique(target, return_index=True)
        rank = np.arange(len(target)) - np.repeat(start, np.diff(np.append(start, len(target))))
        best = rank < self.m
        slot = np.searchsorted(points, target[best])
        ids, values = np.full((len(points), self.m), -1, np.int32), np.full((len(points), self.m), -np.inf, np.float32)
        ids[slot, rank[best]], values[slot, rank[best]] = source[best], value[best]
        ids, values = np.concatenate([self.links[points, self.m :], ids], 1), np.concatenate([self._back[points], values], 1)
        keep = np.argpartition(-values, self.m - 1, axis=1)[:, : self.m]
        self.links[points, self.m :], self._back[points] = np.take_along_axis(ids, keep, 1), np.take_along_axis(values, keep, 1)

    def search(self, queries: np.ndarray, ef: int, among: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(points, scores), by falling score: for each query the ``ef`` nearest points that the search meets, among the
        first ``among``. Missing ones have the score minus infinity."""
        n = len(self.vectors) if among is None else among
        parts = [self._beams(queries[k : k + SIDE], ef, n) for k in range(0, len(queries), SIDE)]
        if not parts:
            return np.zeros((0, ef), np.int64), np.zeros((0, ef), np.float32)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _beams(self, q: np.ndarray, ef: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        begin = min(n, max(ENTRIES, math.isqrt(n)))
        ids, score = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), -np.inf, np.float32)
        first = q @ self.vectors[:begin].T
        keep = min(ef, begin)
        at = np.argpartition(-first, keep - 1, axis=1)[:, :keep]
        ids[:, :keep], score[:, :keep] = at, np.take_along_axis(first, at, 1)
        open_ = ids >= 0
        met = np.zeros((len(q), n), bool)
        met[:, :begin] = True
        active = np.arange(len(q))
        if begin == n:
            active = active[:0]  # all are compared already
        width = min(EXPAND, ef)
        while len(active):
            waiting = np.where(open_[active], score[active], -np.inf)
            pick = np.argpartition(-waiting, width - 1, axis=1)[:, :width]
            real = np.take_along_axis(waiting, pick, 1) > -np.inf
            some = real.any(1)
            active, pick, real = active[some], pick[some], real[some]
            if not len(active):
                break
            open_[active[:, None], pick] = False
            near = self.links[ids[active[:, None], pick]]
            near[~real] = -1
            near = np.sort(near.reshape(len(active), -1), axis=1)
            fresh = (near >= 0) & (near < n)
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            row, column = np.nonzero(fresh)
            row, column = (x[~met[active[row], near[row, column]]] for x in (row, column))
            point = near[row, column]
            met[active[row], point] = True
            found = np.full(near.shape, -np.inf, np.float32)
            found[row, column] = np.einsum("ij,ij->i", self.vectors[point], q[active[row]])
            all_score = np.concatenate([score[active], found], 1)
            keep = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef]
            ids[active] = np.take_along_axis(np.concatenate([ids[active], near], 1), keep, 1)
            open_[active] = np.take_along_axis(np.concatenate([open_[active], found > -np.inf], 1), keep, 1)
            score[active] = np.take_along_axis(all_score, keep, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


_HITS = "id long, hit long, score float"


def stacked(column) -> np.ndarray:
    """A matrix of the vectors of a column, which have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def cell_count(n: int) -> int:
    """Cells for ``n`` vectors: of CELL or twice the root of n vectors each, and CELLS at most."""
    return min(CELLS, max(1, math.ceil(n / max(CELL, 2 * math.isqrt(n)))))


def _cells(centres: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.slice(k, 1024)
                score = stacked(part.column(1)) @ centres.T
                near = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
                order = np.argsort(-np.take_along_axis(score, near, 1), axis=1, kind="stable")
                yield pa.record_batch({"id": part.column(0), "cells": pa.array(list(np.take_along_axis(near, order, 1).astype(np.int32)), pa.list_(pa.int32()))})

    return run


def _rows(ids: np.ndarray, hits: np.ndarray, scores: np.ndarray, top_k: int, threshold: float) -> pa.Table:
    """Hits of each id, by falling score in each row, as a table."""
    keep = scores[:, :top_k] >= threshold
    row, column = np.nonzero(keep)
    return pa.table({"id": pa.array(ids[row], pa.int64()), "hit": pa.array(hits[row, column], pa.int64()), "score": pa.array(scores[row, column], pa.float32())})


def _compared(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, scores), by falling score: the ``k`` nearest of all vectors, for each query."""
    k = min(k, len(vectors))
    score = queries @ vectors.T
    at = np.argpartition(-score, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(score, at, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(at, order, 1), np.take_along_axis(near, order, 1)


def fitted_beam(graph: SmallWorld, queries: np.ndarray, ef: int, top_k: int, share: float) -> int | None:
    """The first of ``ef``, twice that and so on whose beam finds ``share`` of the exact ``top_k`` hits of the queries in
    this graph; None if that takes more than BEAM points."""
    exact = _compared(queries, graph.vectors, top_k)[1]
    while ef <= BEAM:
        # Hits count by their scores, so equal vectors are as good as each other.
        got = graph.search(queries, ef)[1][:, :top_k]
        if (got >= exact[:, -1:] - 1e-6).sum() >= share * exact.size:
            return ef
        ef *= 2
    return None


def _found(m: int, ef: int, top_k: int, threshold: float, share: float | None = None):
    def run(group: pa.Table) -> pa.Table:
        home = np.asarray(group.column("home"))
        ids, vec = np.asarray(group.column("id")), stacked(group.column("vec"))
        held, asked = np.flatnonzero(home), np.flatnonzero(~home)
        if not len(held) or not len(asked):
            return _rows(np.zeros(0, np.int64), np.zeros((0, 1), np.int64), np.zeros((0, 1), np.float32), top_k, threshold)
        held = held[np.random.default_rng(len(held)).permutation(len(held))]
        graph = SmallWorld(vec[held], m, ef)
        beam = ef if share is None else fitted_beam(graph, vec[asked[np.random.default_rng(len(asked)).permutation(len(asked))[:FIT_BEAM]]], ef, top_k, share)
        parts = []
        for k in range(0, len(asked), 8 * SIDE):
            own = asked[k : k + 8 * SIDE]
            if beam is None:
                found = [_compared(vec[own[j : j + SIDE]], graph.vectors, top_k) for j in range(0, len(own), SIDE)]
                at, score = (np.concatenate([f[c] for f in found]) for c in range(2))
            else:
                at, score = graph.search(vec[own], beam)
            parts.append(_rows(ids[own], ids[held][np.maximum(at, 0)], score, top_k, threshold))
        return pa.concat_tables(parts)

    return run


def best_hits(hits: DataFrame, top_k: int) -> DataFrame:
    """The ``top_k`` hits of each id, ties to the lesser id."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "hit"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= top_k).select("id", "hit", "score")


def _fitted_probes(vectors: DataFrame, centres: np.ndarray, top_k: int, share: float) -> int:
    """The least number of nearest cells that hold ``share`` of the exact hits of FIT vectors that are asked for."""
    chosen = [r.id for r in vectors.where("asked").orderBy(F.xxhash64("id", F.lit("fit")), "id").limit(FIT).select("id").collect()]
    if not chosen:
        return 1
    picked = F.col("id").isin(chosen)
    exact = nearest_exact(vectors.where(F.col("held") | picked).select("id", "vec", "held"), picked, top_k, held=F.col("held"))
    hits = exact.select("id", "hit").join(vectors.select(F.col("id").alias("hit"), F.col("vec").alias("there")), "hit")
    hits = hits.join(vectors.where(picked).select("id", "vec"), "id").select("vec", "there").toArrow()
    if not len(hits):
        return 1
    own, there = (stacked(hits.column(c)) @ centres.T for c in ("vec", "there"))
    home = np.take_along_axis(own, there.argmax(1)[:, None], 1)
    rank = np.sort((own > home).sum(1))
    return int(rank[min(len(rank), math.ceil(share * len(rank))) - 1]) + 1


def nearest_graph(vectors: DataFrame, top_k: int = 50, threshold: float = 0.90, m: int = 32, ef: int = 128, probes: int = 4, asked=None, held=None, recall: float | None = None) -> DataFrame:
    """(id, hit, score): for each id about its ``top_k`` nearest vectors by cosine (itself among them), those that reach
    the threshold.

    vectors: (id, vec) of unit vectors of one length; ids whole numbers. ``m`` and ``ef`` are the links and the beam of
    the graphs, ``probes`` the cells that each vector is searched for in; more of each find more. ``asked`` is a
    condition on the rows that are searched for and ``held`` one on those that are found, all without it. Null vectors are left out; an empty table gives no
    rows. The centres are about as many vectors as there are cells, taken by a hash of their ids; every vector is in a
    graph. Equal vectors are found like others, but should be given once, as they fill a cell.

    ``recall`` is the share of the exact hits that is to be found at least, whatever ``probes`` and ``ef``, which are then
    raised as far as that takes: the probed cells until they hold enough of the exact hits of FIT vectors, and the beam of
    each graph until it finds enough of those of FIT_BEAM vectors in it. A third of what may be lost is left to each, and
    a third is spare. Random vectors have neighbours in most cells, so nearly all cells are probed for them and work grows
    with the product of the vectors asked for and the cells.
    """
    wanted_rows = lambda c: F.lit(True) if c is None else F.coalesce(c, F.lit(False))
    vectors = vectors.where("vec is not null").select("id", "vec", wanted_rows(asked).alias("asked"), wanted_rows(held).alias("held"))
    n = vectors.where("held").count()
    wanted = cell_count(n)
    central = F.pmod(F.xxhash64("id", F.lit("centre")), F.lit(1 << 30)) < int(min(1.0, (wanted if wanted > 1 else 0) / max(1, n)) * (1 << 30))
    centres = stacked(vectors.where(central & F.col("held")).orderBy("id").select("vec").limit(2 * CELLS).toArrow().column(0)) if wanted > 1 else np.zeros((0, 0), np.float32)
    share = None if recall is None else 1 - (1 - recall) / 3
    if share is not None and len(centres) >= 2:
        probes = max(probes, _fitted_probes(vectors, centres, top_k, share))
    if len(centres) < 2:
        coded = vectors.select("id", F.array(F.lit(0)).alias("cells"))
    else:
        coded = vectors.select("id", "vec").mapInArrow(_cells(centres, min(probes, len(centres))), "id long, cells array<int>")
    rows = coded.join(vectors.select("id", "asked", "held"), "id").select("id", "asked", "held", F.posexplode("cells").alias("rank", "cell"))
    rows = written(rows.where("asked or held and rank = 0"), "cells")
    home, own = F.col("held") & (F.col("rank") == 0), F.xxhash64("id", F.lit("part"))
    sizes = rows.groupBy("cell").agg(F.ceil(F.sum(home.cast("int")) / GRAPH).cast("int").alias("graphs"), F.ceil(F.sum(F.col("asked").cast("int")) / SEARCHED).cast("int").alias("parts"))
    role = lambda graph, part, home: F.struct(graph.cast("int").alias("graph"), part.cast("int").alias("part"), F.lit(home).alias("home"))
    none = F.array().cast("array<struct<graph:int,part:int,home:boolean>>")
    every = lambda c, f: F.when(F.col(c) > 0, F.transform(F.sequence(F.lit(0), F.col(c) - 1), f)).otherwise(none)
    roles = F.concat(
        F.when(home, every("parts", lambda p: role(F.pmod(own, F.col("graphs")), p, True))).otherwise(none),
        F.when(F.col("asked"), every("graphs", lambda g: role(g, F.pmod(own, F.col("parts")), False))).otherwise(none),
    )
    dealt = rows.join(few(written(sizes, "sizes")), "cell").select("id", "cell", F.explode(roles).alias("r")).select("id", "cell", "r.*")
    dealt = dealt.join(vectors.select("id", "vec"), "id")
    found = dealt.groupBy("cell", "graph", "part").applyInArrow(_found(m, max(ef, top_k), top_k, threshold, share), _HITS)
    return best_hits(found, top_k)


def nearest_exact(vectors: DataFrame, asked, top_k: int, threshold: float = -2.0, block: int = 8192, held=None) -> DataFrame:
    """As ``nearest_graph``, but exact: each block of the vectors asked for is compared with each block of those held."""
    vectors = vectors.where("vec is not null").select("id", "vec", F.coalesce(asked, F.lit(False)).alias("asked"), F.lit(True).alias("held") if held is None else F.coalesce(held, F.lit(False)).alias("held"))
    n = vectors.agg(F.count("*").alias("all"), F.count_if("asked").alias("asked")).first()
    parts, blocks = max(1, -(-n["asked"] // block)), max(1, -(-n["all"] // block))
    own = lambda count: F.pmod(F.xxhash64("id", F.lit("block")), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    held = vectors.where("held").select("id", "vec", F.lit(True).alias("home"), every(parts).alias("i"), own(blocks).alias("j"))
    sought = vectors.where("asked").select("id", "vec", F.lit(False).alias("home"), own(parts).alias("i"), every(blocks).alias("j"))

    def run(group: pa.Table) -> pa.Table:
        home = np.asarray(group.column("home"))
        ids, vec = np.asarray(group.column("id")), stacked(group.column("vec"))
        held, asked = ids[home], ids[~home]
        score = vec[~home] @ vec[home].T
        order = np.argsort(held, kind="stable")
        order = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, :top_k]] if len(asked) and len(held) else np.zeros((len(asked), 0), np.int64)
        return _rows(asked, held[order], np.take_along_axis(score, order, 1), top_k, threshold)

    return best_hits(held.union(sought).groupBy("i", "j").applyInArrow(run, _HITS), top_k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits that were found; 1 where there are none."""
    both = exact.select("id", "hit").join(found.select("id", "hit", F.lit(1).alias("got")), ["id", "hit"], "left")
    row = both.agg(F.count("*").alias("n"), F.count("got").alias("got")).first()
    return row["got"] / row["n"] if row["n"] else 1.0
