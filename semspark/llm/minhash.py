"""Near-duplicate groups by SuperMinHash, banding, exact verification and union-find.

Two texts are linked if 100 * |A & B| >= threshold * |A | B| for their sets of distinct word shingles. Candidates
come from bands of SuperMinHash signatures; a link counts only once the full sets confirm it.

Texts with equal sets are one class from the start. The members of all buckets of equal band keys that have the same
least id, the centre, are one group, so a pair that shares several bands is met once. A group is cut into blocks of
bounded size, each with the centre, and all pairs of a block are compared: first by sketches, which tell the members
whose sets have to be made at all, then by their full sets. Only a spanning forest of the links comes out. A group of
one block is done then. Where a group of several blocks still holds two components or more, the members outside its
largest component are compared with all its other blocks. So no pair in a common bucket goes unseen, whatever the
bucket's size, and a large group of copies takes work in proportion to its members.

Shingles are compared by 64-bit hashes that are no polynomials (see ``texthash``); classes of equal sets are told by
their size and 128 bits, of which half come from hashes with a key of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.components import components
from ..functions.skew import spread_join
from .common import BROADCAST_IDS, fresh, short, written
from .superminhash import band_keys, signatures
from .texthash import KEY, SECOND_KEY, U, keyed_word_hashes, mix, shingle_hashes, slices

WORDS, THRESHOLD, PLACES, BANDS = 5, 75, 128, 32
#: Members of a group that are compared with each other at once, and shingles of their sets; larger groups are cut.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Texts that are hashed at once; a shingle of a short text takes some 600 bytes while its signature is made.
RUN_BYTES = 512 << 10
#: Pairs whose sketches are more standard deviations than this below the threshold are not compared by their sets.
SLACK = 5.5


def _each_set(column: pa.Array, words: int, keys: tuple[int, ...] = (KEY,)) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(first row, hashes of the shingles for each key, index of each text's first shingle) of each run of texts."""
    for first, data, offsets in slices(column, RUN_BYTES):
        hashes, index = keyed_word_hashes(data, offsets, keys)
        made = [shingle_hashes(h, index, words) for h in hashes]
        yield first, [m[0] for m in made], made[0][1]


def _sum(elements: np.ndarray) -> np.ndarray:
    return np.add.reduce(elements, dtype=U)


def _sign(words: int, places: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, (elements, seconds), index in _each_set(batch.column(1), words, (KEY, SECOND_KEY)):
                n = len(index) - 1
                # The distinct shingles of each text: a long text of few keeps no more than these while places are open.
                sets = [np.unique(elements[index[i] : index[i + 1]], return_index=True) for i in range(n)]
                size = np.array([len(own) for own, _ in sets], np.int64)
                a = np.array([_sum(mix(own)) for own, _ in sets], U)
                b = np.array([_sum(mix(seconds[index[i] + one])) for i, (_, one) in enumerate(sets)], U)
                matrix = signatures(np.concatenate([own for own, _ in sets]), np.concatenate([[0], np.cumsum(size)]), places)
                keys = band_keys(matrix, bands).view(np.int64)
                sketch = (matrix & U(255)).astype(np.uint8)
                full = np.repeat(size > 0, bands)
                offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(first, n),
                        "n": pa.array(size),
                        "set_a": pa.array(a.view(np.int64)),
                        "set_b": pa.array(b.view(np.int64)),
                        "sketch": pa.FixedSizeBinaryArray.from_buffers(pa.binary(places), n, [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary()),
                        "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()[full])),
                    }
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, (elements,), index in _each_set(batch.column(1), words):
                n = len(index) - 1
                own = [np.unique(elements[index[i] : index[i + 1]]) for i in range(n)]
                tags = np.array([_sum(mix(x)) for x in own], U).view(np.int64)
                yield pa.record_batch({"id": batch.column(0).slice(first, n), "tag": pa.array(tags), "shingles": pa.array([x.tobytes() for x in own], pa.binary())})

    return run


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, places: int = PLACES, bands: int = BANDS) -> DataFrame:
    """(doc_id, n, set_a, set_b, sketch, bands): size and fingerprint of each text's shingle set, the low byte of
    each place of its signature, and its band keys."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        _sign(words, places, bands), "doc_id long, n long, set_a long, set_b long, sketch binary, bands array<long>"
    )


def _least_matches(threshold: int, places: int) -> int:
    p = threshold / 100
    return max(0, math.floor(places * (p - SLACK * math.sqrt(p * (1 - p) / places))))


def _rows(held: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    if held is None:
        return batch
    return pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]


def _grouped(compare):
    """An operator over rows that come sorted by their first three columns: ``compare`` gets the rows of a group."""

    def groups(rows: pa.RecordBatch):
        parts = [np.asarray(rows.column(c)) for c in range(3)]
        cut = np.flatnonzero(np.any([p[1:] != p[:-1] for p in parts], axis=0)) + 1
        edges = np.concatenate([[0], cut, [len(rows)]])
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if e - s > 1 and (found := compare(rows.slice(s, e - s))) is not None:
                yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = _rows(held, batch)
            same = np.ones(len(rows), bool)
            for c in range(3):
                part = np.asarray(rows.column(c))
                same &= part == part[-1]
            first = int(np.argmax(same))
            if first:
                yield from groups(rows.slice(0, first))
            held = rows.slice(first)
        if held is not None:
            yield from groups(held)

    return run


def _matrix(column: pa.Array, places: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), places)


class _Group:
    """The rows of a block, or of a block and a chunk that it is compared with."""

    def __init__(self, rows: pa.RecordBatch, least: int, places: int, threshold: int):
        self.rep, self.n, self.side, component = (np.asarray(rows.column(c)) for c in (3, 5, 6, 7))
        self.label = np.unique(component, return_inverse=True)[1]
        self.within = rows.column(2)[0].as_py() < 0
        self.sketch, self.least, self.threshold = _matrix(rows.column(8), places), least, threshold

    def alike(self, k: int, among: np.ndarray) -> np.ndarray:
        """Those rows that are in another component than row k and may be linked with it, by sizes and sketches."""
        among = among[self.label[among] != self.label[k]]
        if not self.within:
            among = among[self.side[among] != self.side[k]]
        among = among[100 * np.minimum(self.n[among], self.n[k]) >= self.threshold * np.maximum(self.n[among], self.n[k])]
        return among[(self.sketch[among] == self.sketch[k]).sum(axis=1) >= self.least] if len(among) else among


def _near(least: int, places: int, threshold: int):
    """The rows that may be linked with a row of another component in their group. Pairs of rows that are both found
    already are not looked at."""

    def compare(rows: pa.RecordBatch):
        group = _Group(rows, least, places, threshold)
        near = np.zeros(len(rows), bool)
        for k in range(len(rows) - 1):
            later = np.arange(k + 1, len(rows))
            at = group.alike(k, later[~near[k + 1 :]] if near[k] else later)
            if len(at):
                near[at] = near[k] = True
        return rows.filter(pa.array(near)) if near.any() else None

    return _grouped(compare)


def _linked(least: int, places: int, threshold: int):
    """Confirmed links (a, b) between components of a group: a spanning forest of all that there are.

    The sizes of all intersections of a row are counted at once, over the sets that hold its shingles. Rows that a
    link has brought into one component are not compared again.
    """

    def compare(rows: pa.RecordBatch):
        group = _Group(rows, least, places, threshold)
        shingle = first = holder = edge = None
        left, right = [], []
        for k in range(len(rows) - 1):
            at = group.alike(k, np.arange(k + 1, len(rows)))
            if not len(at):
                continue
            if shingle is None:
                values = [np.frombuffer(s.as_buffer(), U) for s in rows.column(9)]
                shingle = np.unique(np.concatenate(values), return_inverse=True)[1]
                edge = np.concatenate([[0], np.cumsum([len(v) for v in values])])
                holder = np.repeat(np.arange(len(values)), np.diff(edge))[np.argsort(shingle, kind="stable")]
                first = np.concatenate([[0], np.cumsum(np.bincount(shingle))])
            mine = shingle[edge[k] : edge[k + 1]]
            many = first[mine + 1] - first[mine]
            posting = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            shared = np.bincount(holder[posting], minlength=len(rows))[at]
            at = at[100 * shared >= threshold * (group.n[at] + group.n[k] - shared)]
            merged, one = np.unique(group.label[at], return_index=True)
            left += [group.rep[k]] * len(merged)
            right += group.rep[at[one]].tolist()
            group.label[np.isin(group.label, merged)] = group.label[k]
        return pa.record_batch({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())}) if left else None

    return _grouped(compare)


_MEMBER = "centre long, block int, chunk int, rep long, tag long, n long, side int, component long, sketch binary"
_GROUP = ["centre", "block", "chunk"]


class _Comparison:
    """How groups are compared, and the sets that confirm links."""

    def __init__(self, docs: DataFrame, words: int, threshold: int, places: int):
        self.docs, self.words, self.places, self.threshold = docs, words, places, threshold
        self.least = _least_matches(threshold, places)

    def near(self, members: DataFrame, label: str) -> DataFrame:
        members = members.select(*[c.split()[0] for c in _MEMBER.split(", ")])
        return written(members.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_near(self.least, self.places, self.threshold), _MEMBER), label)

    def sets(self, ids: DataFrame, repeated: bool) -> DataFrame:
        """(id, tag, shingles) of the texts named by ``ids`` (doc_id) alone. A long list of ids is joined by shuffles."""
        ids = written(ids.distinct(), "wanted")
        made = self.docs.join(short(ids), "doc_id", "left_semi").mapInArrow(_sets(self.words), "id long, tag long, shingles binary")
        return written(made.groupBy("id", "tag").agg(F.first("shingles").alias("shingles")) if repeated else made, "sets")

    def links(self, near: DataFrame, sets: DataFrame, label: str) -> DataFrame:
        sets = sets.withColumnsRenamed({"id": "rep"})
        full = near.join(sets, ["rep", "tag"]).select(*near.columns, "shingles")
        full = full.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
        return written(full.mapInArrow(_linked(self.least, self.places, self.threshold), "a long, b long"), label)


def _split(members: DataFrame) -> tuple[DataFrame, int]:
    """(centre, blocks) of the centres whose members make more than one block, and the number of such centres."""
    sizes = members.groupBy("centre").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sizes = written(sizes.where("blocks > 1"), "blocks")
    return sizes, sizes.count()


def _across(members: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the comparisons that are left between blocks of a centre.

    ``members`` (centre, blocks, own, rep, tag, n, sketch): those of centres with several blocks. A centre's largest
    component needs no comparisons within itself. The other members are cut into chunks, and each block meets each
    chunk: pairs of the chunk and the block that lie in one block have met already.
    """
    placed = members.join(found, members.rep == found.node, "left").select(members["*"], F.coalesce("component", "rep").alias("component"))
    counts = placed.groupBy("centre", "component").agg(F.count("*").alias("rows"))
    largest = counts.groupBy("centre").agg(F.max(F.struct("rows", "component"))["component"].alias("largest"), F.sum("rows").alias("all"), F.max("rows").alias("most"))
    largest = largest.where("all > most").select("centre", "largest", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("chunks"))
    open_ = written(placed.join(largest, "centre"), "open")
    common = ["centre", "rep", "tag", "n", "component", "sketch"]
    all_ = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    blocks = open_.select(*common, F.col("own").alias("block"), F.lit(0).alias("side"), all_)
    chunk = F.pmod(F.xxhash64("rep", "tag", F.lit(1)), F.col("chunks")).cast("int")
    others = open_.where("component <> largest").select(*common, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), chunk.alias("chunk"))
    return blocks.unionByName(others.where("block <> own").drop("own"))


def _repeats(table: DataFrame) -> DataFrame:
    """(doc_id, first_row) of the ids that several rows have; the first row is the least by its set, then by place."""
    least = F.min(F.struct("n", "set_a", "set_b", "row"))["row"]
    return written(table.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), least.alias("first_row")).where("rows > 1").drop("rows"), "repeats")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD, places: int = PLACES, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    component_id is the least id reachable over confirmed links; kept marks the row that stands for its component.

    - Null, empty or blank text: n_shingles 0, linked with nothing, kept.
    - Null id: takes no part in linking; component_id is null and the row is kept.
    - Rows that repeat an id are one node; of the rows of a component's least id one is kept.
    - An empty table gives no rows. Other columns of ``docs`` are not looked at, whatever their names.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    table = written(signed(plain, words=words, places=places, bands=bands).withColumn("row", F.monotonically_increasing_id()), "signed")
    repeats = _repeats(table)
    repeated = not repeats.isEmpty()
    known = table.where("doc_id is not null and n > 0")
    heads = written(known.groupBy("n", "set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.count("*").alias("rows")), "heads")

    keys = heads.select("rep", F.col("set_a").alias("tag"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre < last").drop("last")
    # Very many sets may share a band; their rows are dealt out.
    centres = spread_join(keys, shared, ["key"], salts=8).groupBy("rep", "tag").agg(F.collect_set("centre").alias("centres"))  # one for each band at most
    small = heads.select("rep", F.col("set_a").alias("tag"), "n", "sketch")
    members = written(centres.join(small, ["rep", "tag"]).select(F.explode("centres").alias("centre"), "rep", "tag", "n", "sketch"), "members")
    sizes, split = _split(members)
    blocks = members.join(F.broadcast(sizes) if split <= BROADCAST_IDS else sizes, "centre", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("rep", "tag"), F.col("blocks")).cast("int"))

    comparison = _Comparison(plain, words, threshold, places)
    # The centre goes to each block, so that what is like it becomes one component at once.
    place = F.explode(F.when(F.col("rep") == F.col("centre"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))).alias("block")
    near = comparison.near(blocks.select("centre", place, F.lit(-1).alias("chunk"), "rep", "tag", "n", F.lit(0).alias("side"), F.col("rep").alias("component"), "sketch"), "near")
    wanted = near.select(F.col("rep").alias("doc_id"))
    if split:
        wanted = wanted.union(blocks.where("blocks > 1").select("rep"))
    sets = comparison.sets(wanted, repeated)
    links = comparison.links(near, sets, "links")

    placed = table.select("doc_id", "row", "n", "set_a", "set_b")
    if repeated:
        of_class = spread_join(placed.where("n > 0").join(repeats, "doc_id", "left_semi"), heads.drop("rows"), ["n", "set_a", "set_b"])
        links = links.union(of_class.where("doc_id <> rep").select("doc_id", "rep").distinct())
    found = components(links)
    if split:
        more = comparison.links(comparison.near(_across(blocks.where("blocks > 1"), found), "near"), sets, "links")
        if not more.isEmpty():
            found = components(found.union(more))
    found = written(found, "found")

    # Rows whose set no other row has, and that are linked with none, need no class; nor do texts without words.
    of_class = heads.join(found, heads.rep == found.node, "left").where("rows > 1 or component < rep")
    of_class = written(of_class.select("n", "set_a", "set_b", F.coalesce("component", "rep").alias("of_class")), "classes")
    rows = placed.where("doc_id is not null")
    same = ["n", "set_a", "set_b"]
    out = rows.join(F.broadcast(of_class), same, "left") if of_class.count() <= BROADCAST_IDS else spread_join(rows, of_class, same, "left")
    out = out.withColumn("component_id", F.coalesce("of_class", "doc_id"))
    kept = F.col("doc_id") == F.col("component_id")
    if repeated:
        own = repeats.join(found, repeats.doc_id == found.node, "left").select("doc_id", "first_row", F.col("component").alias("of_id"))
        out = out.join(own, "doc_id", "left").withColumn("component_id", F.coalesce("of_id", "component_id"))
        kept = kept & (F.coalesce("first_row", "row") == F.col("row"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
    return out.union(table.where("doc_id is null").select("doc_id", "n", F.lit(None).cast("long"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without all but one document of each near-duplicate group (columns unchanged).

    The document of least id stays. Rows with a null id, and those without words, stay; of the rows that repeat an id
    one stays, that with the least hash of its text. An empty table gives no rows. Helper columns get names that
    clash with none of ``docs``.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = written(near_duplicates(docs, **options).where("not kept"), "dropped")
    (key,) = fresh(docs.columns, "dropped_id")
    ident = F.col(f"`{id_col}`").cast("long")
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "gone")
    left = docs.join(short(gone), ident == F.col(key), "left_anti")
    twice = written(found.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct(), "twice")
    if twice.isEmpty():
        return left
    twice = short(twice)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = left.join(twice, ident == F.col(key), "left_semi").groupBy(ident.alias(key)).agg(F.min_by(row, F.xxhash64(F.col(f"`{text_col}`"))).alias("one"))
    return left.join(twice, ident == F.col(key), "left_anti").union(one.select("one.*"))
