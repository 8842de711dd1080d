"""A trie of conversations by Patricia construction: sorted sequences, points only where something branches or ends.

Equal sequences of turns are counted first. The distinct ones are sorted over the cluster, and each range of them builds
its part of the compressed tree from the common prefixes of neighbours: a point for each branch, end and leaf, with the
edge that leads to it. A node whose sequences lie in several ranges is a prefix of the last sequence of one; these are
the only nodes that ranges share. They are kept uncompressed, and what the ranges know of them is added up. At last the
edges are expanded to the nodes with a single child, by sums over the rest of the edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import short, written

#: Bytes that stand for a turn in a sequence.
WIDTH = 16
#: Turns of a range's sequences, about; a longer conversation is a range of its own.
TURNS = 200_000
#: Ids of a block whose text is hashed as one piece.
BLOCK_IDS = 8192
#: Turns that may be taken from another conversation, at most.
HEADS = 5
_NOTHING = hashlib.sha256().hexdigest()


def turn_sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, chars): the turns of each conversation in order, as 16 bytes each, and their code points.

    Turns are ordered by number, null first, and those of one number by a hash of role and text; a repeated row is a
    turn of its own. Null roles and texts are empty. Rows without a conversation are left out. Texts are hashed where
    they are read; a conversation is one row of 20 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    one = F.struct(F.col("turn").alias("turn"), digest.alias("h"), F.char_length(text).alias("chars"))
    own = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(one), _by_turn).alias("t"))
    return own.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t["h"]), "")).alias("seq"), F.transform("t", lambda t: t["chars"]).alias("chars"))


def _by_turn(a, b):
    """Null before all numbers, then by number, then by hash."""
    missing = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    number = F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1)
    return F.coalesce(missing, number, F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1), F.lit(0))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Each conversation c with its first turns taken from conversation c - c % 100: crc32 of c's digits modulo 6 of
    them, or all if there are fewer, followed by c's own turns after its first so many. A conversation that is not there
    gives none. At most a hundred conversations take from one, so the join has no hot key."""
    sequences = written(sequences, "sequences")
    heads = sequences.where("conv_id % 100 = 0").select(F.col("conv_id").alias("host"), F.substring("seq", 1, WIDTH * HEADS).alias("head"), F.slice("chars", 1, HEADS).alias("head_chars"))
    n = F.expr(f"cast(crc32(cast(conv_id as string)) % {HEADS + 1} as int)")
    rows = sequences.withColumn("host", F.col("conv_id") - F.col("conv_id") % 100).withColumn("n", n).join(short(heads), "host", "left")
    empty = F.expr("x''")
    seq = F.concat(F.coalesce(F.substring("head", F.lit(1), F.col("n") * WIDTH), empty), F.substring("seq", F.col("n") * WIDTH + 1, F.octet_length("seq")))
    chars = F.concat(F.coalesce(F.slice("head_chars", F.lit(1), F.col("n")), F.array().cast("array<int>")), F.slice("chars", F.col("n") + 1, F.size("chars")))
    return rows.select("conv_id", seq.alias("seq"), chars.alias("chars"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sequence from its blocks of ids, which follow each other; the text of its ids is hashed block
    by block."""
    names = ("key", "seq", "chars", "n", "conv_id", "ids")
    open_ = None
    for batch in batches:
        for key, seq, chars, n, conv, ids in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if open_ is not None and open_[0] == key:
                open_[3] += n
                open_[4] = min(open_[4], conv)
                open_[5].update(b"," + ids.encode())
            else:
                if open_ is not None:
                    yield _end(open_)
                open_ = [key, seq, chars, n, conv, hashlib.sha256(ids.encode())]
    if open_ is not None:
        yield _end(open_)


def _end(row: list) -> pa.RecordBatch:
    _, seq, chars, n, conv, ids = row
    return pa.record_batch({"seq": pa.array([seq], pa.binary()), "chars": pa.array([chars], pa.list_(pa.int32())), "n": pa.array([n], pa.int64()), "conv_id": pa.array([conv], pa.int64()), "ends": pa.array([ids.hexdigest()])})


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """(seq, chars, n, conv_id, ends): each sequence with its conversations' number, least id, and the SHA-256 of their
    ids. Blocks of ids are joined to texts first, so that a sequence of very many conversations has few rows."""
    rows = sequences.withColumns({"key": F.md5("seq"), "block": F.floor(F.col("conv_id") / BLOCK_IDS)})
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    blocks = rows.groupBy("key", "block").agg(F.first("seq").alias("seq"), F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), ids.alias("ids"))
    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_ends, "seq binary, chars array<int>, n long, conv_id long, ends string")


def common(a: bytes, b: bytes) -> int:
    """Turns at the beginning that two sequences share."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:  # equal beginnings are compared at once
        middle = (low + high + 1) // 2
        if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


class _Point:
    __slots__ = ("depth", "row", "shared", "first", "n", "conv", "leaves", "children", "below", "ends", "up", "edge")

    def __init__(self, depth: int, row: int, shared: bool, first: bool):
        # shared: other ranges have sequences of this node as well; first: none of those ranges is before this one
        self.depth, self.row, self.shared, self.first = depth, row, shared, first
        self.n, self.conv, self.leaves, self.children, self.below, self.ends = 0, None, 0, 0, 0, None
        self.up: _Point | None = None
        self.edge: list[int] = []


def compressed(rows: list[tuple], left: int, right: int, leads: bool) -> list[_Point]:
    """The points of a range of sorted distinct sequences (seq, chars, n, conv_id, ends).

    left, right: turns that the first sequence shares with the range before, and the last with the range after; nodes
    down to these depths are points of their own. leads: no range is before. ``below`` of a point is the sum over the
    nodes under it of conversations times characters, less the characters once, in the range that is first to see the
    node; so sums over ranges are those of the whole tree.
    """
    out: list[_Point] = []
    stack = [_Point(d, 0, True, leads) for d in range(left + 1)]

    def close() -> None:
        x = stack.pop()
        if stack:
            y = x.up = stack[-1]
            x.edge = rows[x.row][1][y.depth : x.depth]
            y.n += x.n
            y.conv = x.conv if y.conv is None else min(x.conv, y.conv)
            y.children += x.first
            y.leaves += x.leaves if x.children or x.shared else 1
            y.below += x.below + (x.n - x.first) * sum(x.edge)
        if not x.children and not x.shared:
            x.leaves = 1
        out.append(x)

    def above(depth: int) -> None:
        """A point at ``depth`` between the two last ones, if there is none."""
        if len(stack) < 2 or stack[-2].depth < depth:
            stack.insert(len(stack) - 1, _Point(depth, stack[-1].row, False, True))

    for k, (seq, _, n, conv, ends) in enumerate(rows):
        if k:
            shared = common(rows[k - 1][0], seq)
            while stack[-1].depth > shared:
                above(shared)
                close()
        if len(seq) // WIDTH > stack[-1].depth:
            stack.append(_Point(len(seq) // WIDTH, k, False, True))
        x = stack[-1]
        x.n, x.ends = x.n + n, ends
        x.conv = conv if x.conv is None else min(conv, x.conv)
    while stack[-1].depth > right:
        above(right)
        close()
    while stack:
        stack[-1].shared = True
        if stack[-1].depth:
            above(stack[-1].depth - 1)
        close()
    return out


def _key(seq: bytes, depth: int) -> bytes:
    return hashlib.blake2b(seq[: WIDTH * depth], digest_size=16).digest()


_POINTS = "shared boolean, key binary, up_key binary, up_conv long, conv_id long, depth long, n long, children long, leaves long, saved long, ends string, edge array<long>"


def _points(edges: dict[int, tuple[int, int, bool]]):
    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("seq", "chars", "n", "conv_id", "ends")), strict=True), key=lambda r: r[0])
        made: dict[str, list] = {c.split()[0]: [] for c in _POINTS.split(", ")}
        for x in compressed(rows, *edges[part]):
            seq = rows[x.row][0]
            rest, suffix = 0, []
            for chars in reversed(x.edge[:-1]):
                suffix.append(rest := rest + chars)
            y = x.up
            own = (x.n - x.first) * (x.edge[-1] if x.edge else 0)
            far = y is not None and y.shared
            row = (x.shared, _key(seq, x.depth) if x.shared else None, _key(seq, y.depth) if far else None, None if y is None or far else y.conv, x.conv, x.depth, x.n, x.children, x.leaves, x.below + own, x.ends, [*reversed(suffix), 0])
            for column, value in zip(made.values(), row, strict=True):
                column.append(value)
        types = {"boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
        return pa.table({c.split()[0]: pa.array(made[c.split()[0]], types[c.split()[1]]) for c in _POINTS.split(", ")})

    return run


def prefix_trie(sequences: DataFrame, turns: int = TURNS) -> DataFrame:
    """One row for each node of the trie of ``sequences`` (conv_id, seq, chars), one conversation a row.

    conv_id: least conversation that begins with the node's turns; depth; parent_conv_id, that of its parent (null for
    the root); n_convs; n_children; n_leaves, nodes without children in its subtree, itself included; saved_tokens,
    summed over its subtree, conversations less one times the code points of a node's last text; ends_sha256 of the
    decimal ids, ascending and joined by commas, of the conversations that end there. No conversations, no nodes; a
    conversation without turns ends at the root. Ranges of about ``turns`` turns are built in a task each.
    """
    distinct = written(distinct_sequences(sequences), "distinct")
    total = distinct.agg(F.sum(F.octet_length("seq") / WIDTH + 1)).first()[0] or 0
    ranged = distinct.repartitionByRange(max(1, -(-int(total) // turns)), "seq")
    ranges = written(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    ends = ranges.groupBy("part").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    shared = F.udf(lambda a, b: common(bytes(a), bytes(b)) if a is not None and b is not None else 0, "int")
    order = Window.orderBy("part")  # a row for each range
    ends = ends.select("part", F.col("low"), "high", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    edges = {r.part: (r.left, r.right, r.leads) for r in ends.select("part", shared("before", "low").alias("left"), shared("high", "after").alias("right"), F.col("before").isNull().alias("leads")).collect()}
    points = written(ranges.groupBy("part").applyInArrow(_points(edges), _POINTS), "points")

    total = points.where("shared").groupBy("key").agg(F.first("up_key").alias("up_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.max("ends").alias("ends"))
    spine = written(total, "shared-nodes")
    above = short(spine.select(F.col("key").alias("up_key"), F.col("conv_id").alias("above")))
    lone = F.col("children") == 0
    upper = spine.join(above, "up_key", "left").select("conv_id", "depth", F.col("above").alias("parent_conv_id"), "n", "children", F.when(lone, F.lit(1)).otherwise(F.col("leaves")).alias("leaves"), "saved", "ends")
    inner = points.where("not shared").join(above, "up_key", "left").select("*", F.posexplode("edge").alias("at", "rest"))
    last = F.col("at") + 1 == F.size("edge")
    nodes = inner.select(
        "conv_id",
        (F.col("depth") - F.size("edge") + 1 + F.col("at")).alias("depth"),
        F.when(F.col("at") == 0, F.coalesce("up_conv", "above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n",
        F.when(last, F.col("children")).otherwise(F.lit(1)).alias("children"),
        "leaves",
        (F.col("saved") + (F.col("n") - 1) * F.col("rest")).alias("saved"),
        F.when(last, F.col("ends")).alias("ends"),
    ).union(upper)
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").cast("long").alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256"))
