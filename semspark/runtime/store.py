"""A content-addressed store of vectors and answers, so that no text is sent to a model twice.

A store is a folder that driver and executors share. Each run writes what it learned to a folder of its own under
``data`` and then creates one empty file of that name under ``commits``; only committed runs are read, so a run that fails
half-way leaves nothing behind that counts. Runs may overlap: both keep what they learned, and of entries of one key one is
read. ``compact`` makes one run of all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import hot_join
from .embedders import REQUEST_ROWS, model_name, unit
from .shared import few, written


def content_key(model: str, *parts: Column) -> Column:
    """A key of texts under a model: their SHA-256, with lengths between them so that no two lists of texts share it."""
    sized = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in (F.lit(model), *parts)]
    return F.sha2(F.concat(*sized), 256)


class ContentStore:
    """Values by key (a string), in a folder given by its URI. ``kind`` is the values' type."""

    def __init__(self, path: str, kind: str):
        self.path, self.kind = path.rstrip("/"), kind

    def _folder(self, spark: SparkSession, name: str):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def runs(self, spark: SparkSession) -> list[str]:
        """Names of the committed runs."""
        fs, folder = self._folder(spark, "commits")
        return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []

    def read(self, spark: SparkSession) -> DataFrame:
        """(key, value) of all committed runs; a key may be in several."""
        folders = [f"{self.path}/data/{run}" for run in self.runs(spark)]
        schema = f"key string, value {self.kind}"
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def append(self, entries: DataFrame) -> str:
        """Writes (key, value) as one run and commits it. Returns the run's name."""
        spark, run = entries.sparkSession, uuid.uuid4().hex
        entries.select("key", "value").write.option("compression", "zstd").parquet(f"{self.path}/data/{run}")
        fs, mark = self._folder(spark, f"commits/{run}")
        fs.create(mark, False).close()
        return run

    def compact(self, spark: SparkSession) -> None:
        """Makes one run of all, a row a key. Readers that began before may fail and have to begin again; run it alone."""
        old = self.runs(spark)
        if len(old) < 2:
            return
        self.append(self.read(spark).dropDuplicates(["key"]))
        for run in old:
            for name in (f"commits/{run}", f"data/{run}"):
                fs, path = self._folder(spark, name)
                fs.delete(path, True)

    def missing(self, keyed: DataFrame) -> DataFrame:
        """A row for each key of ``keyed`` (key, text) that the store lacks."""
        distinct = keyed.groupBy("key").agg(F.first("text").alias("text"))
        return distinct.join(self.read(keyed.sparkSession).select("key"), "key", "left_anti")

    def known(self, keyed: DataFrame) -> DataFrame:
        """``keyed`` with the column ``value``, null for keys that the store lacks. Very many rows may have one key."""
        wanted = keyed.select("key").distinct()
        values = self.read(keyed.sparkSession).join(wanted, "key", "left_semi").dropDuplicates(["key"])
        return hot_join(keyed, written(values, "known"), ["key"], "left")


class VectorStore(ContentStore):
    """Unit vectors by model and text."""

    def __init__(self, path: str):
        super().__init__(path, "array<float>")

    def embedded(self, rows: DataFrame, embedder) -> DataFrame:
        """(id, vec) of ``rows`` (id, text): texts that the store lacks are embedded and kept, those of one row for each;
        ids are unique (a text may else be sent for several of them). A null text is embedded as an empty one. Runs a job."""
        from ..operators.base import dealt

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, len(batch), REQUEST_ROWS):
                    part = batch.slice(k, REQUEST_ROWS)
                    vectors = unit(np.asarray(embedder.embed(part.column(1).to_pylist()), np.float32))
                    yield pa.record_batch({"key": part.column(0), "value": pa.array(list(vectors), pa.list_(pa.float32()))})

        spark = rows.sparkSession
        text = F.coalesce(F.col("text"), F.lit(""))
        texts = rows.select("id", content_key(model_name(embedder), text).alias("key"), text.alias("text"))
        keyed = written(texts.select("id", "key"), "keyed")  # texts stay where they are until it is known which are sent
        first = keyed.groupBy("key").agg(F.min("id").alias("id"))
        lacking = written(first.join(self.read(spark).select("key"), "key", "left_anti"), "missing")
        if not lacking.isEmpty():
            sent = texts.join(few(lacking), ["id", "key"], "left_semi").select("key", "text")
            self.append(dealt(sent, spark.sparkContext.defaultParallelism).mapInArrow(run, "key string, value array<float>"))
        return self.known(keyed).select("id", F.col("value").alias("vec"))


class AnswerStore(ContentStore):
    """Models' raw answers by model, question and row."""

    def __init__(self, path: str):
        super().__init__(path, "string")
