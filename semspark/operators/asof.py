"""As-of joins: each row on the left with the last row on the right of its key that is not later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.skew import few_join
from ..runtime.shared import written
from .base import col

#: Rows of both sides for each span that the order's values are cut into.
SPAN_ROWS = 200_000
#: Rows handed on to later spans that may be broadcast; they hold keys and columns of the right.
CARRIED = 50_000


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], on: str, right_by: list[str] | None = None, right_on: str | None = None, columns: list[str] | None = None, suffix: str = "_right", span_rows: int = SPAN_ROWS) -> DataFrame:
    """``left`` with ``columns`` of ``right`` (all without it, but for its keys): those of the row of equal ``by`` whose
    ``right_on`` is the greatest that is not above ``on``; of several such rows the greatest in all its columns. Rows
    without one, or with a null key or order, have nulls. ``on`` is a number, a date or a time.

    Both sides are united and the last right row is carried along each key. So that a key of very many rows is no single
    task, the values of the order are cut into spans of one width; each key and span is worked on by itself, and the last
    row of every earlier span is handed on. Rows of one key within one span stay together.
    """
    right_by, right_on = list(right_by or by), right_on or on
    if len(right_by) != len(by):
        raise ValueError("by and right_by name as many columns")
    columns = list(columns) if columns is not None else [c for c in right.columns if c not in right_by]
    key, at, mine, side, found, span, carry = fresh([*left.columns, *right.columns], "asof_key", "asof_at", "asof_left", "asof_side", "asof_found", "asof_span", "asof_carry")
    united = lambda df, names: F.when(F.greatest(*[col(c).isNull().cast("int") for c in names], F.lit(0)) == 0, F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(names)]))
    rows = left.select(united(left, by).alias(key), col(on).alias(at), F.struct(*[col(c) for c in left.columns]).alias(mine))
    other = right.select(united(right, right_by).alias(key), col(right_on).alias(at), F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias(found)).where(F.col(key).isNotNull() & F.col(at).isNotNull())
    apart = F.col(key).isNull() | F.col(at).isNull()
    alone = rows.where(apart).select(mine, F.lit(None).cast(other.schema[found].dataType).alias(found))
    both = rows.where(~apart).withColumns({side: F.lit(1), found: F.lit(None).cast(other.schema[found].dataType)}).unionByName(other.withColumns({side: F.lit(0), mine: F.lit(None).cast(rows.schema[mine].dataType)}))
    number = F.col(at).cast("timestamp").cast("double") if rows.schema[at].dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.col(at).cast("double")
    both = written(both.withColumn(span, number), "united")
    size = both.agg(F.count("*").alias("n"), F.min(span).alias("low"), F.max(span).alias("high")).first()
    width = ((size["high"] or 0.0) - (size["low"] or 0.0)) / max(1, size["n"] // span_rows)
    cut = F.floor((F.col(span) - F.lit(size["low"] or 0.0)) / F.lit(width)).cast("long") if width > 0 else F.lit(0).cast("long")
    both = both.withColumn(span, cut)
    # Right rows come before left ones of the same place, the greatest last.
    within = Window.partitionBy(key, span).orderBy(at, side, F.col(found).asc_nulls_first())
    filled = both.withColumn(found, F.last(found, True).over(within)).where(F.col(side) == 1)
    last = both.where(F.col(side) == 0).groupBy(key, span).agg(F.max(F.struct(F.col(at), F.col(found))).alias(carry))
    spans = both.select(key, span).distinct().join(last, [key, span], "left")
    before = Window.partitionBy(key).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    handed = written(spans.select(key, span, F.last(F.col(carry)[found], True).over(before).alias(carry)).where(F.col(carry).isNotNull()), "carried")
    out = few_join(filled, handed, [key, span], "left", CARRIED) if width > 0 else filled.withColumn(carry, F.lit(None).cast(other.schema[found].dataType))
    out = out.select(mine, F.coalesce(found, carry).alias(found)).union(alone)
    names = [c + suffix if c.lower() in {n.lower() for n in left.columns} else c for c in columns]
    return out.select(*[F.col(mine)[c].alias(c) for c in left.columns], *[F.col(found)[f"c{i}"].alias(n) for i, n in enumerate(names)])
