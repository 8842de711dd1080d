"""Joins whose left side may have very many rows of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import fresh

#: Parts that the rows of each key are dealt out to.
SALTS = 32


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``left.join(right, keys, how)`` for inner, left, left_semi and left_anti joins to a ``right`` with one row a key.

    Each key's rows on the left are dealt out to ``salts`` tasks by a hash of all their columns; the row on the right
    goes to each of them. Rows that are equal in all columns stay together. The copies are joined by shuffles, whatever
    ``right`` is hinted or estimated at: Spark takes the size of a table for that of its ``salts`` copies, which would all
    go through the driver. A ``right`` that is small enough to be broadcast needs no copies (see ``few_join``).
    """
    (salt,) = fresh([*left.columns, *right.columns], "salt")
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int"))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return dealt.join(copies, [*keys, salt], how).drop(salt)


def few_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", most: int | None = None) -> DataFrame:
    """As ``spread_join``, for a written ``right``: its rows are counted, and up to ``most`` (FEW) are broadcast, once each."""
    from ..runtime.shared import FEW

    if right.count() <= (FEW if most is None else most):
        return left.join(right.hint("broadcast"), keys, how)
    return spread_join(left, right, keys, how)


#: Rows of a key from which on they are dealt out.
HOT = 10_000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: int = HOT) -> DataFrame:
    """As ``spread_join``, for a ``right`` of wide rows: only keys of more than ``hot`` rows on the left are spread. They
    are counted first, which is a job; without any this is a plain join."""
    from ..runtime.shared import few, written

    many = written(left.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*keys), "hot-keys")
    if many.isEmpty():
        return left.join(right, keys, how)
    marked = few(many)
    spread = spread_join(left.join(marked, keys, "left_semi"), right.join(marked, keys, "left_semi"), keys, how)
    return left.join(marked, keys, "left_anti").join(right, keys, how).unionByName(spread)
