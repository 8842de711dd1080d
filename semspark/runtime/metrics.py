"""Counts of what model calls cost, added up over all tasks."""

from __future__ import annotations

from pyspark.sql import SparkSession

NAMES = ("requests", "failed_requests", "rows", "retried_rows", "unanswered_rows", "tokens_sent", "embedding_requests")


class RunMetrics:
    """Accumulators of a session. Give it to a client as ``metrics``; tasks that are run again count again."""

    def __init__(self, spark: SparkSession):
        self._counts = {n: spark.sparkContext.accumulator(0) for n in NAMES}

    def add(self, **counts: int) -> None:
        for name, n in counts.items():
            if n:
                self._counts[name].add(n)

    def values(self) -> dict[str, int]:
        """The counts so far; on the driver."""
        return {n: a.value for n, a in self._counts.items()}
