"""Shards of equal row counts along a Hilbert curve through metadata dimensions, with native Spark functions only.

Rows are quantised by each dimension, ordered by the index of their cell on the curve and cut into runs, so that a
file covers a small box of the dimensions and file statistics prune on all of them. Ranks come from counts: the rows
of each cell, and of each part of a large cell, are counted; the running sums of those counts (a row for each part)
give each part's first rank, and a row's rank within its part is added. No task gets more than about a part's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import short, written

#: Rows of a part of a cell, about.
PART_ROWS = 50_000
#: Bits of each dimension; the number of cells is at most 2 ** (bits * dimensions).
BITS = 4


def _tables(n: int) -> tuple[list[int], list[int], list[int]]:
    """Rank of each Gray code, and the entry point and direction of each sub-cube along an n-dimensional curve."""
    size = 1 << n
    gray = [w ^ w >> 1 for w in range(size)]
    rank = [gray.index(g) for g in range(size)]
    entry = [0] + [gray[2 * ((w - 1) // 2)] for w in range(1, size)]
    ones = lambda w: (~w & w + 1).bit_length() - 1  # noqa: E731  trailing ones
    direction = [0] + [ones(w - 1 if w % 2 == 0 else w) % n for w in range(1, size)]
    return rank, entry, direction


def hilbert_index(axes: list[str], bits: int) -> Column:
    """Index on the Hilbert curve of the cell with these coordinates (integer columns of ``bits`` bits each).

    The compact state update of Hamilton and Rau-Chaplin (2008): from the highest bits down, the corner of the current
    sub-cube is turned into the curve's own frame, its rank is appended, and the frame moves on.
    """
    n = len(axes)
    mask = (1 << n) - 1
    rank, entry, direction = ("array(" + ",".join(map(str, t)) + ")" for t in _tables(n))
    corner = " | ".join(f"shiftleft(shiftright({a}, i) & 1, {j})" for j, a in enumerate(axes))
    turned = f"(({corner}) ^ s.e)"
    turn = f"((s.d + 1) % {n})"
    w = f"element_at({rank}, ((shiftright({turned}, {turn}) | shiftleft({turned}, {n} - {turn})) & {mask}) + 1)"
    step = f"element_at({entry}, w + 1)"
    moved = f"s.e ^ ((shiftleft({step}, {turn}) | shiftright({step}, {n} - {turn})) & {mask})"
    inner = f"named_struct('h', shiftleft(s.h, {n}) | cast(w as bigint), 'e', {moved}, 'd', (s.d + element_at({direction}, w + 1) + 1) % {n})"
    body = f"element_at(transform(array({w}), w -> {inner}), 1)"
    return F.expr(f"aggregate(sequence({bits - 1}, 0, -1), named_struct('h', 0L, 'e', 0, 'd', 0), (s, i) -> {body}, s -> s.h)")


def text_cuts(base: DataFrame, name: str, levels: int, total: int) -> list[str | None]:
    """The values of a string column at its quantiles, by whole strings in byte order, nulls first; ``total`` rows.

    Distinct values are counted and sorted in ranges, so no task gets more than a range of them.
    """
    order = F.col(name).asc_nulls_first()
    values = base.groupBy(name).agg(F.count("*").alias("rows")).repartitionByRange(order).withColumn("run", F.spark_partition_id())
    values = written(values, "values")
    runs = values.groupBy("run").agg(F.sum("rows").alias("all"))
    runs = runs.select("run", F.coalesce(F.sum("all").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    last = F.col("before") + F.sum("rows").over(Window.partitionBy("run").orderBy(order))
    placed = values.join(F.broadcast(runs), "run").withColumn("last", last)
    # A quantile k / levels lies on the rows of the value.
    return [r[0] for r in placed.where(f"least(last * {levels} div {total}, {levels - 1}) > (last - rows) * {levels} div {total}").select(name).collect()]


def hilbert_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("source", "lang"), bits: int = BITS, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot): every row of ``docs`` in one of ``shards`` runs of the curve.

    Dimensions are the string columns ``by`` and the size (UTF-8 bytes of the text plus 1), each cut at its quantiles
    over all rows. Row counts of shards differ by one at most; slots run without gaps from 0. Rows of one cell are cut
    into parts of about ``part_rows`` by a hash, and are in the order of id within a part; which of several equal rows
    comes first is not defined. Null texts have size 1 and crc 0; null dimensions come before all others; rows that
    repeat an id or a whole row are all kept; an empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    names = [f"code{k}" for k in range(len(by))]
    base = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *[F.col(f"`{c}`").cast("string").alias(k) for c, k in zip(by, names, strict=True)],
        F.monotonically_increasing_id().alias("row"),
    )
    base = written(base, "sizes")
    levels = 1 << bits
    total = base.count()
    if not total:
        empty = base.where("false").select("doc_id", "size", "text_crc32")
        return empty.select("*", F.lit(0).cast("long").alias("curve"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    steps = F.lit([k / levels for k in range(1, levels)])
    cuts = [text_cuts(base, c, levels, total) for c in names]
    cuts.append(sorted(set(base.agg(F.percentile_approx("size", steps, F.lit(10_000))).first()[0])))
    names.append("size")
    for k, c in enumerate(names):
        above = [F.col(c).isNotNull() if x is None else F.coalesce(F.col(c) > F.lit(x), F.lit(False)) for x in cuts[k]]
        base = base.withColumn(f"axis{k}", sum((a.cast("int") for a in above), F.lit(0)))
    cells = base.withColumn("curve", hilbert_index([f"axis{k}" for k in range(len(names))], bits)).select("doc_id", "size", "text_crc32", "curve", "row")
    # A row for each occupied cell: at most 2 ** (bits * dimensions), that many more only if the caller wants it.
    counted = written(cells.groupBy("curve").agg(F.ceil(F.count("*") / part_rows).alias("parts")), "counted")
    # The row's number is in the hash, so that rows that repeat, and copies of one row, are dealt out too.
    dealt = cells.join(short(counted), "curve").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "row"), F.col("parts")))
    dealt = written(dealt.drop("parts", "row"), "cells")
    # One task adds up a number for each part: a row for every ``part_rows`` of the input.
    parts = dealt.groupBy("curve", "part").agg(F.count("*").alias("rows"))
    parts = parts.withColumn("first", F.sum("rows").over(Window.orderBy("curve", "part").rowsBetween(Window.unboundedPreceding, -1)))
    least, longer = divmod(total, shards)
    cut = longer * (least + 1)
    within = F.row_number().over(Window.partitionBy("curve", "part").orderBy("doc_id", "text_crc32", "size"))
    placed = dealt.withColumn("at", within - 1).join(parts.select("curve", "part", F.coalesce("first", F.lit(0)).alias("first")), ["curve", "part"])
    placed = placed.withColumn("rank", F.col("first") + F.col("at"))
    shard = F.when(F.col("rank") < cut, F.expr(f"rank div {least + 1}")).otherwise(F.expr(f"{longer} + (rank - {cut}) div {max(least, 1)}"))
    start = F.col("shard").cast("long") * least + F.least(F.col("shard").cast("long"), F.lit(longer))
    return placed.withColumn("shard", shard.cast("int")).select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("rank") - start).cast("long").alias("slot"))
