"""Whole numbers for ids of any type, in the order of the ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime.shared import written


def numbered(ids: DataFrame) -> DataFrame:
    """(given, number): the distinct values of the only column of ``ids`` that are not null, numbered from 0 in their
    order. They are sorted over the cluster; one row for each sorted partition is added up in a single task."""
    given = ids.select(F.col(f"`{ids.columns[0]}`").alias("given")).where("given is not null").distinct()
    rows = written(given.orderBy("given").select("given", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "numbers")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    parts = parts.select("part", (F.coalesce(F.sum("n").over(order), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(F.broadcast(parts), "part").select("given", (F.col("at") + F.col("shift")).alias("number"))
