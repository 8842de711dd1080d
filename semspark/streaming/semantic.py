"""Semantic operators over streams: the same operators run inside a streaming query, each row once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def read_parquet_stream(spark: SparkSession, path: str, schema=None, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand all that is there to ``sink`` batch by batch, then stop; the checkpoint remembers what has been done."""
    query = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
