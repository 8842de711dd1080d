"""Semantic deduplication: embed rows, find near neighbours, cluster, let a model confirm, merge."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import U, mix
from ..functions.names import fresh
from ..functions.numbering import numbered
from ..functions.skew import spread_join
from ..runtime.embedders import REQUEST_ROWS, HashingEmbedder, HTTPEmbedder, unit
from ..runtime.protocol import parse_literal
from ..runtime.shared import few, written
from .base import answer_udf, col, dealt, input_columns, serialised, shared_model
from .clusters import clusters
from .graph import _HITS, best_hits, nearest_graph, stacked
from .reduce import register_action

#: Vectors of a block; a task compares two blocks.
BLOCK = 2048
#: Width of the intervals of a projection, as a multiple of the distance at the threshold, and vectors that the number
#: of projections is fitted on.
RATIO, SAMPLE = 4.0, 1000
#: Ids that may be broadcast; their number is checked, and more are joined by shuffles.
BROADCAST_IDS = 1_000_000
#: Rows of several columns that may be broadcast: buckets of vectors, and members of clusters.
BROADCAST_ROWS = 50_000
NONE = "NO_DUPLICATES"


def embedding_text(columns: list[str]):
    """``k: v, k: v`` of the columns that are not null."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), col(c).cast("string")) for c in columns])


def embed(df: DataFrame, id_col: str, text, embedder, store=None) -> DataFrame:
    """(id, vec): unit vectors of the texts, in requests of 256. With a ``store`` only texts that it lacks are embedded.
    Whole-number ids become longs, others keep their type."""
    own = df.select(col(id_col)).schema[0].dataType
    own = T.LongType() if isinstance(own, T.IntegralType) else own
    rows = df.select(col(id_col).cast(own).alias("id"), text.alias("text")).where("id is not null")
    if store is not None:
        return store.embedded(rows, embedder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), REQUEST_ROWS):
                part = batch.slice(k, REQUEST_ROWS)
                vectors = unit(np.asarray(embedder.embed([t or "" for t in part.column(1).to_pylist()]), np.float32))
                yield pa.record_batch({"id": part.column(0), "vec": pa.array(list(vectors), pa.list_(pa.float32()))})

    made = T.StructType([T.StructField("id", own), T.StructField("vec", T.ArrayType(T.FloatType()))])
    return dealt(rows, df.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, made)


def _best(score: np.ndarray, left: np.ndarray, right: np.ndarray, top_k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, hit, score) of each row's best columns; ties go to the lesser id."""
    row, column = np.nonzero(score >= threshold)
    value, hit = score[row, column], right[column]
    order = np.lexsort((hit, -value, row))
    row, value, hit = row[order], value[order], hit[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < top_k
    return left[row[keep]], hit[keep], value[keep]


def _block_hits(top_k: int, threshold: float, keys: tuple[str, ...] = ("i", "j")):
    """Hits between the blocks i and j of each bucket in a group; ``keys`` tell the buckets' pairs of blocks apart."""

    def hits(group: pa.Table) -> pa.Table:
        parts = [np.asarray(group.column(k)) for k in keys]
        order = np.lexsort(parts)
        cut = np.flatnonzero(np.any([p[order][1:] != p[order][:-1] for p in parts], axis=0)) + 1
        ids, home, first, second = (np.asarray(group.column(c)) for c in ("id", "home", "i", "j"))
        vec = stacked(group.column("vec"))
        found = []
        for own in np.split(order, cut):
            i, j = first[own[0]], second[own[0]]
            left, right = own[home[own] == i], own[home[own] == j]
            if len(left) and len(right):
                score = vec[left] @ vec[right].T
                found.append(_best(score, ids[left], ids[right], top_k, threshold))
                if i != j:
                    found.append(_best(score.T, ids[right], ids[left], top_k, threshold))
        columns = [np.concatenate([f[c] for f in found]) if found else np.zeros(0) for c in range(3)]
        return pa.table({"id": pa.array(columns[0].astype(np.int64)), "hit": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(np.float32))})

    return hits


def nearest(vectors: DataFrame, top_k: int = 50, threshold: float = 0.90, block: int = BLOCK) -> DataFrame:
    """(id, hit, score): for each id its ``top_k`` nearest vectors by cosine (itself among them), those that reach
    the threshold. Exact: blocks of vectors are multiplied with each other, so the work grows with the square of their
    number. Ties go to the lesser id."""
    n = vectors.count()
    blocks = max(1, -(-n // block))
    dealt = vectors.withColumn("home", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("id", "vec", "home", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"))
    return best_hits(dealt.groupBy("i", "j").applyInArrow(_block_hits(top_k, threshold), _HITS), top_k)


def _agreement(ratio: float) -> float:
    """Probability that two points fall into one of the intervals of a random projection that are ``ratio`` times as
    wide as the points are apart (Datar and others, 2004)."""
    tail = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def interval(threshold: float) -> float:
    """Width of the intervals for unit vectors whose cosine reaches the threshold."""
    return RATIO * max(1e-3, math.sqrt(max(0.0, 2 - 2 * threshold)))


def fit_bands(sample: np.ndarray, n: int, threshold: float, recall: float, seed: int = 7) -> tuple[int, int]:
    """(projections of a code, tables): codes deal n vectors like those of the sample out to buckets of a few hundred,
    and in one of the tables at least a pair at the threshold agrees with the wanted probability."""
    if len(sample) < 2:
        return 1, 1
    rng = np.random.default_rng(seed)
    cells = np.floor(sample @ rng.standard_normal((sample.shape[1], 64)) / interval(threshold) + rng.random(64))
    equal = [(np.unique(c, return_counts=True)[1] ** 2).sum() / len(c) ** 2 for c in cells.T]
    chance = min(0.99, float(np.mean(equal)))
    size = min(64, max(1, math.ceil(math.log(max(1.0, n / 256)) / -math.log(chance))))
    return size, max(1, math.ceil(math.log(1 - recall) / math.log(1 - _agreement(RATIO) ** size)))


def _codes(threshold: float, size: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not len(batch):
                continue
            vec = stacked(batch.column(1)).astype(np.float64)
            if planes is None:
                rng = np.random.default_rng(seed)
                planes, shift = rng.standard_normal((vec.shape[1], size * tables)), rng.random(size * tables)
            cells = np.floor(vec @ planes / interval(threshold) + shift).astype(np.int64).view(U).reshape(len(vec), tables, size)
            code = np.zeros((len(vec), tables), U)
            for k in range(size):
                code = mix(code ^ cells[:, :, k])
            yield pa.record_batch({"id": batch.column(0), "codes": pa.array(list(code.view(np.int64)), pa.list_(pa.int64()))})

    return run


def nearest_banded(vectors: DataFrame, top_k: int = 50, threshold: float = 0.90, recall: float = 0.95, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """As ``nearest``, but pairs at the threshold are found with the probability ``recall`` only, nearer ones with more.

    Vectors are dealt out by the intervals that they fall into on random projections, in several tables; only vectors
    of one code in some table are compared, by their exact cosines. The number of projections is fitted on SAMPLE
    vectors at most; all vectors are dealt out. Buckets of more than ``block`` vectors are cut into blocks, and all
    their pairs of blocks are compared.
    """
    vectors = vectors.select("id", "vec")
    if vectors.isEmpty():
        return vectors.select("id", F.col("id").alias("hit"), F.lit(1.0).cast("float").alias("score"))
    sample = [r.vec for r in vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()]
    size, tables = fit_bands(np.array(sample, np.float64).reshape(len(sample), -1), vectors.count(), threshold, recall, seed)
    coded = vectors.mapInArrow(_codes(threshold, size, tables, seed), "id long, codes array<long>")
    rows = written(coded.select("id", F.posexplode("codes").alias("band", "code")), "codes")
    sizes = written(rows.groupBy("band", "code").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1"), "buckets")
    # Small buckets share a group; a pair of blocks is never split, so a group has about two pairs of blocks at most.
    bins = -(-(sizes.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0) // (2 * block)) or 1
    sizes = few(sizes.drop("n"), BROADCAST_ROWS)  # a few bytes a row in files, about 120 where they are broadcast
    dealt = rows.join(sizes, ["band", "code"]).withColumn("home", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "code", "id", "home", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j")).join(vectors, "id")
    keys = ("band", "code", "i", "j")
    hits = dealt.groupBy(F.pmod(F.xxhash64(*keys), F.lit(bins))).applyInArrow(_block_hits(top_k, threshold, keys), _HITS)
    alone = vectors.where(F.exists("vec", lambda v: v != 0)).select("id", F.col("id").alias("hit"), F.lit(1.0).cast("float").alias("score"))
    return best_hits(hits.where("id <> hit").groupBy("id", "hit").agg(F.max("score").alias("score")).union(alone), top_k)


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score), a < b, of all pairs of vectors (id, vec) whose cosine reaches the threshold."""
    everything = nearest(vectors, 1 << 30, threshold)
    return everything.where("id < hit").select(F.col("id").alias("a"), F.col("hit").alias("b"), "score")


def composed(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """(id, canonical_id): ``upper``'s pairs, and ``lower``'s with what ``upper`` makes of their canonical ids. An id has
    one pair at most in each. Very many rows may have one canonical id."""
    onward = upper.select(F.col("id").alias("canonical_id"), F.col("canonical_id").alias("onward"))
    moved = spread_join(lower, onward, ["canonical_id"], "left").select("id", F.coalesce("onward", "canonical_id").alias("canonical_id"))
    return moved.union(upper.select("id", "canonical_id"))


def one_of_each(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(id of the least row of each value of ``key``, pairs (id, canonical_id) of the other rows) of ``rows`` (id, key).

    Values are counted before rows meet, and only those of several rows take part in the join; their rows are dealt out.
    """
    least = written(rows.groupBy(key).agg(F.min("id").alias("canonical_id"), F.count("*").alias("n")), "least")
    several = least.where("n > 1").select(key, "canonical_id")
    pairs = spread_join(rows, several, [key]).where("id <> canonical_id").select("id", "canonical_id")
    return least.select(F.col("canonical_id").alias("id")), pairs


_VERDICT = T.StructType([T.StructField("canonical_id", T.LongType()), T.StructField("duplicate_ids", T.ArrayType(T.LongType())), T.StructField("error", T.StringType())])


def read_verdict(answer) -> dict:
    """canonical_id and duplicate_ids of an answer; none for NO_DUPLICATES or an answer that cannot be read."""
    empty = {"canonical_id": None, "duplicate_ids": None, "error": None}
    if isinstance(answer, Exception):
        return {**empty, "error": str(answer)}
    if answer.strip().strip("'\"") == NONE:
        return empty
    try:
        value = parse_literal(answer) if answer.strip().startswith("{") else parse_literal(str(parse_literal(answer)))
        canonical, dups = value["canonical_id"], value["duplicate_ids"]
        if type(canonical) is not int or not isinstance(dups, list) or not all(type(d) is int for d in dups):
            raise TypeError("ids are whole numbers")
    except (ValueError, TypeError, KeyError, SyntaxError, RecursionError) as error:
        return {**empty, "error": f"unreadable: {error}"}
    return {"canonical_id": canonical, "duplicate_ids": dups, "error": None}


@register_action("dedup")
class SemanticDeduplicator:
    """Merges rows that mean the same.

    ``id_col`` names a unique column of any type with an order. Rows with equal inputs are one class, merged without a
    question; the neighbour search and the model see the row of least id of each, so ``top_k`` bounds distinct neighbours
    only. Without ``llm`` equal vectors are one class too, and every candidate cluster is merged onto its least id. Rows
    with a null id take no part. A model is told whole-number ids as they are, and others by their rank.

    Calling it gives the merges (canonical_id, duplicate_ids), one array for each group; with ``pairs`` rows (id,
    canonical_id), which groups of any size allow; with ``return_df`` the frame without duplicates. Without ``id_col``
    rows are numbered as they come, which serves ``return_df`` alone.

    index: 'graph' (the default) searches small-world graphs of ``hnsw_m`` links by beams of ``ef_search`` points in
    ``probes`` cells; 'banded' compares vectors that agree in a band of random projections, and finds a pair at the
    threshold with the probability ``recall``; 'exact' compares all distinct vectors, so that its work grows with the
    square of their number. ``embedding_model`` names a model of the HTTP endpoint in place of an ``embedder``. ``store``
    keeps vectors by model and text, so that a text is embedded once (see ``VectorStore``).
    """

    def __init__(self, llm=None, id_col: str | None = "id", embedder=None, sim_threshold: float = 0.90, top_k: int = 50, input_fields=None, return_df: bool = False, pairs: bool = False, max_retries: int = 3, block: int = BLOCK, index: str = "graph", recall: float = 0.95, embedding_model: str | None = None, hnsw_m: int = 32, ef_search: int = 128, probes: int = 4, store=None):
        if index not in ("graph", "banded", "exact"):
            raise ValueError("index is 'graph', 'banded' or 'exact'")
        if id_col is None and not return_df:
            raise ValueError("merges need id_col, the column that their ids are from")
        self.llm, self.id_col = llm, id_col
        self.embedder = embedder or (HTTPEmbedder(embedding_model) if embedding_model else HashingEmbedder())
        self.sim_threshold, self.top_k, self.input_fields = sim_threshold, top_k, input_fields
        self.return_df, self.pairs, self.max_retries, self.block = return_df, pairs, max_retries, block
        self.index, self.recall, self.hnsw_m, self.ef_search, self.probes, self.store = index, recall, hnsw_m, ef_search, probes, store

    def _near(self, points: DataFrame) -> DataFrame:
        if self.index == "graph":
            return nearest_graph(points, self.top_k, self.sim_threshold, self.hnsw_m, self.ef_search, self.probes)
        if self.index == "banded":
            return nearest_banded(points, self.top_k, self.sim_threshold, self.recall, self.block)
        return nearest(points, self.top_k, self.sim_threshold, self.block)

    def __call__(self, df: DataFrame) -> DataFrame:
        columns = input_columns(df, self.input_fields)
        (number,) = fresh(df.columns, "row_number")
        names = None
        if self.id_col is None:
            df = written(df.withColumn(number, F.monotonically_increasing_id()), "rows")
        elif self.id_col not in df.columns:
            raise ValueError(f"id_col {self.id_col!r} is not a column of the frame")
        elif isinstance(df.schema[self.id_col].dataType, T.IntegralType):
            df = df.withColumn(number, col(self.id_col).cast("long"))
        else:
            names = written(numbered(df.select(col(self.id_col))), "names")
        merged = written(self._merged(df, number, names, [c for c in columns if c != self.id_col]), "pairs")
        if self.return_df:
            gone = merged.select(F.col("id").alias(number))
            if names is not None:
                gone = written(names.join(few(gone.toDF("number")), "number", "left_semi").select(F.col("given").alias(number)), "gone")
                df = df.withColumn(number, col(self.id_col))
            kept = df.join(F.broadcast(gone), number, "left_anti") if gone.count() <= BROADCAST_IDS else spread_join(df, gone, [number], "left_anti")
            return kept.drop(number)
        if names is not None:
            for end in ("id", "canonical_id"):
                merged = spread_join(merged, names.select(F.col("number").alias(end), F.col("given").alias("of_" + end)), [end])
            merged = merged.select(F.col("of_id").alias("id"), F.col("of_canonical_id").alias("canonical_id"))
        if self.pairs:
            return merged
        return merged.groupBy("canonical_id").agg(F.array_sort(F.collect_list("id")).alias("duplicate_ids"))

    def _merged(self, df: DataFrame, number: str, names: DataFrame | None, inputs: list[str]) -> DataFrame:
        """(id, canonical_id) of all rows that are merged into another one, by their numbers: the column ``number`` of
        ``df``, or those that ``names`` gives to ids of another type. Inputs are not moved to look them up.

        Names in their order take a byte or two in files and over a hundred where they are broadcast, so they are joined
        by shuffles whatever Spark takes their size for. Heads of classes are picked by a hash of their ids, which may be
        broadcast and lets hardly another row through; vectors are joined by the ids themselves.
        """
        same = F.sha2(serialised(inputs), 256) if inputs else col(number if names is None else self.id_col).cast("string")
        if names is None:
            rows = df.select(col(number).alias("id"), same.alias("row")).where("id is not null")
        else:
            rows = df.select(col(self.id_col).alias("given"), same.alias("row")).join(names.hint("merge"), "given").select(F.col("number").alias("id"), "row")
        heads, pairs = one_of_each(rows, "row")
        if names is None:
            firsts = df.join(few(heads.select(F.col("id").alias(number))), number, "left_semi")
            vectors = embed(firsts, number, embedding_text(inputs), self.embedder, self.store)
        else:
            given = written(names.join(heads.select(F.col("id").alias("number")).hint("merge"), "number", "left_semi").select("given", "number"), "heads")
            firsts = df.withColumn(number, F.xxhash64(col(self.id_col))).join(few(given.select(F.xxhash64("given").alias(number))), number, "left_semi")
            vectors = embed(firsts, self.id_col, embedding_text(inputs), self.embedder, self.store).withColumnRenamed("id", "given")
            vectors = vectors.join(given.hint("merge"), "given").select(F.col("number").alias("id"), "vec")
        vectors = written(vectors, "vectors")
        points = vectors
        if self.llm is None:  # vectors of zeros are like no other
            alone = F.when(~F.exists("vec", lambda v: v != 0), F.col("id"))
            keyed = vectors.select("id", F.struct("vec", F.coalesce(alone, F.lit(-1)).alias("alone")).alias("key"))
            least, equal = one_of_each(keyed, "key")
            points = vectors.join(few(least), "id", "left_semi")
        found = written(clusters(written(self._near(points.select("id", "vec")), "hits")), "clusters")
        confirmed = self._confirmed(df, number, names, found, inputs)
        merges = confirmed.select(F.explode("duplicate_ids").alias("id"), "canonical_id")
        if self.llm is None:
            merges = composed(equal, merges)
        return composed(pairs, merges)

    def _confirmed(self, df: DataFrame, number: str, names: DataFrame | None, found: DataFrame, inputs: list[str]) -> DataFrame:
        if self.llm is None:
            own = found.select(F.array_min("members").alias("canonical_id"), "members")
            return own.select("canonical_id", F.array_sort(F.array_remove("members", F.col("canonical_id"))).alias("duplicate_ids"))
        llm, tasks = shared_model(df.sparkSession, self.llm)
        placed = found.select("cluster_id", "members", F.posexplode("members").alias("at", "member"))
        if names is None:
            placed = placed.join(df.select(col(number).alias("member"), serialised(inputs).alias("row")), "member")
        else:
            placed = written(placed.join(names.select("given", F.col("number").alias("member")).hint("merge"), "member"), "placed")
            placed = few(placed, BROADCAST_ROWS).join(df.select(col(self.id_col).alias("given"), serialised(inputs).alias("row")), "given")
        lines = placed.groupBy("cluster_id").agg(F.first("members").alias("members"), F.array_sort(F.collect_list(F.struct("at", "member", "row"))).alias("rows"))
        line = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("ID "), r["member"].cast("string"), F.lit(": "), r["row"])), "\n")
        text = F.concat(F.lit("CLUSTER "), F.col("cluster_id").cast("string"), F.lit(" START\n"), line, F.lit("\nCLUSTER "), F.col("cluster_id").cast("string"), F.lit(" END"))
        prefix = f"Each record is a cluster of rows. Answer with a dictionary of canonical_id and duplicate_ids (a list) for the rows that mean the same, or with the string '{NONE}'.\n"
        ask = answer_udf(llm, prefix, "Find duplicates.", "\nAnswer all clusters.", read_verdict, _VERDICT, self.max_retries)
        verdicts = dealt(lines.select("members", text.alias("text")), tasks).withColumn("v", ask(F.col("text"))).select("members", "v.canonical_id", "v.duplicate_ids")
        valid = verdicts.where("canonical_id is not null and array_contains(members, canonical_id) and size(array_except(duplicate_ids, members)) = 0")
        out = valid.select("canonical_id", F.array_sort(F.array_distinct(F.filter("duplicate_ids", lambda d: d != F.col("canonical_id")))).alias("duplicate_ids"))
        return written(out.where("size(duplicate_ids) > 0"), "confirmed")
