"""Streams with state: repeated rows are asked once, and windows of answers close behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import col
from ..operators.semantic import finalize
from .semantic import run_available


def answer_available(op, llm, stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a semantic ``op`` that has a ``store`` over all that ``stream`` has, into the Parquet folder ``out``.

    The store is the state of what has been asked: an input that repeats, in a batch, in a later one or in another stream
    with the same store, is sent once. Each batch replaces a folder of its own, so one that is run again after a failure
    leaves no row twice and finds the answers that it had. The checkpoint remembers which batches are done.
    """
    if op.store is None:
        raise ValueError("the operator needs a store")
    run_available(stream, lambda batch, k: finalize(op(llm, batch)).write.mode("overwrite").parquet(f"{out}/batch={k}"), checkpoint)


def close_windows(spark: SparkSession, answered: str, schema, *, time: str, width: str, delay: str, keys: list[str], out: str, checkpoint: str) -> None:
    """Counts the rows of the Parquet folder ``answered`` by window of ``time`` and by ``keys``; windows that are closed
    are appended to the Parquet folder ``out`` as (window_start, window_end, keys, n).

    A window is closed once the greatest time read lies ``delay`` behind its end, and is written once. Rows that come
    after their window was closed are left out; rows with a null time too. Windows that are still open stay in the
    state, which the checkpoint keeps, and are closed by later runs. A key may be null.
    """
    rows = spark.readStream.schema(schema).parquet(answered)
    counts = rows.withWatermark(time, delay).groupBy(F.window(col(time), width).alias("w"), *[col(k) for k in keys]).agg(F.count("*").alias("n"))
    closed = counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[col(k) for k in keys], "n")
    query = closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
