"""Connected components of a link table, by union-find inside partitions and star contraction across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime.shared import forget, written

#: Up to so many links, whose number is checked in each round, the centres are broadcast; more are joined by shuffles.
BROADCAST_LINKS = 500_000


def union_find(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and for each the smallest node that the links reach."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    parent = list(range(len(nodes)))
    for a, b in zip(at[: len(left)].tolist(), at[len(left) :].tolist(), strict=True):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    for i, p in enumerate(parent):  # a parent is never larger than its child
        parent[i] = parent[p]
    return nodes, nodes[np.array(parent, np.int64)] if len(nodes) else nodes


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:  # between batches only the forest is kept
        a, b = (np.asarray(batch.column(k)) for k in range(2))
        nodes, roots = union_find(np.concatenate([left, a]), np.concatenate([right, b]))
        far = nodes != roots
        left, right = nodes[far], roots[far]
    yield pa.record_batch({"u": pa.array(left, pa.int64()), "v": pa.array(right, pa.int64())})


def _stars(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One star step. edges: u > v. The least neighbour (or the node itself) becomes the new centre. few: whether the
    centres may be broadcast, so that a centre of many links makes no large task."""
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(F.broadcast(least) if few else least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v")


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one link and no centre has a link of its own."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    worst = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into > 0")
    return worst.isEmpty()


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, component): each node of ``links`` (two long columns) with the least node it reaches.

    No links give no rows. Links from a node to itself are ignored. Every round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path.
    """
    spark = links.sparkSession
    u, v = (F.col(f"`{c}`") for c in links.columns[:2])
    edges = written(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").mapInArrow(_contract, "u long, v long").distinct(), label)
    while not _settled(edges):
        old = edges
        few = edges.count() <= BROADCAST_LINKS
        edges = written(_stars(_stars(edges, True, few), False, few).distinct(), label)
        forget(spark, old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
