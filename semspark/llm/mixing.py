"""Mixing of sources to target weights by Poisson replication, with native Spark functions only.

Each document gets a number of copies drawn from a Poisson distribution whose mean is its source's target repetition
rate: the inverse of the distribution function at a uniform number hashed from seed and id. The copies are exploded
and dealt out in the order of another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, short, written

#: A larger mean is drawn as a sum of Poisson numbers of at most this mean each.
LARGEST_MEAN = 32.0
#: Sources whose rates are broadcast, about a kilobyte each; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _table(mean: str) -> str:
    """Distribution function of a Poisson law at 0, 1, ... until it stays at its limit for 64-bit numbers."""
    steps = f"sequence(1, cast({mean} + 12 * sqrt({mean}) + 20 as int))"
    start = f"named_struct('p', exp(-{mean}), 'c', array(exp(-{mean})))"
    step = f"(s, k) -> named_struct('p', s.p * {mean} / k, 'c', array_append(s.c, element_at(s.c, -1) + s.p * {mean} / k))"
    return f"aggregate({steps}, {start}, {step}, s -> s.c)"


def rates(docs: DataFrame, weights: dict[str | None, float] | float = 0.7, size: float = 1.0, source_col: str = "source") -> DataFrame:
    """(source, mean, draws, cdf): expected copies of a document of each source.

    ``weights`` names the target share of each source (others get none), or is a power to which the sources' counts
    are raised to get their shares. ``size`` is the expected output as a multiple of the input.
    """
    counts = written(docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count("*").alias("n")), "sources")
    if isinstance(weights, dict):
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), float(w)).otherwise(share)
    else:
        share = F.pow(F.col("n").cast("double"), F.lit(float(weights)))
    counts = counts.withColumn("share", share)
    n, shares = counts.agg(F.sum("n"), F.sum("share")).first()
    mean = F.try_divide(F.col("share") * float(n or 0) * size, F.lit(float(shares or 0)) * F.col("n"))
    out = counts.select("source", F.coalesce(mean, F.lit(0.0)).alias("mean"))
    out = out.withColumn("draws", F.greatest(F.ceil(F.col("mean") / LARGEST_MEAN), F.lit(1)).cast("int")).withColumn("each", F.col("mean") / F.col("draws"))
    return out.select("source", "mean", "draws", F.expr(_table("each")).alias("cdf"))


def replicate(docs: DataFrame, weights: dict[str | None, float] | float = 0.7, size: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", extras: bool = False) -> DataFrame:
    """Copies of the rows of ``docs`` in shuffled order; columns unchanged, with ``extras`` also copy_no and mix_key.

    A null source is a source of its own; a null id is hashed as an empty part. Rows that repeat an id get the same
    number of copies each, and stand next to each other in no defined order, as do rows with null ids. Texts are not
    looked at and are shuffled once, into the order of the copies. An empty table gives no rows. Extra columns are
    carried along; helper columns get names that clash with none of them.
    """
    source, mean, draws, cdf, n, copy, key = fresh(docs.columns, "mix_source", "mix_mean", "mix_draws", "mix_cdf", "mix_n", "copy_no", "mix_key")
    table = short(written(rates(docs, weights, size, source_col).toDF(source, mean, draws, cdf), "rates"), BROADCAST_SOURCES)
    joined = docs.join(table, F.col(f"`{source_col}`").eqNullSafe(F.col(source)))
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    count = F.aggregate(
        F.transform(
            F.transform(F.sequence(F.lit(1), F.col(draws)), lambda j: uniform(F.lit(seed), ident, j.cast("string"))),
            lambda u: F.size(F.filter(F.col(cdf), lambda c: c <= u)),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    # The number is drawn before the rows are copied, once for each document.
    copies = joined.withColumn(n, count).where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    copies = copies.withColumn(key, F.substring(F.md5(F.concat_ws(":", F.lit(seed + "/order"), ident, F.col(copy).cast("string"))), 1, 16))
    mixed = copies.repartition(F.col(key)).sortWithinPartitions(key)
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns], *([F.col(copy), F.col(key)] if extras else []))
