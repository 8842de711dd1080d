"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that goes to a Python worker, about; a longer row is a batch of its own.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Paths made inside the innermost open ``scratch`` block of this thread.
_open: ContextVar[list[str] | None] = ContextVar("open_scratch", default=None)
#: For each session that jobs of bounded batches run in: how many there are, and the setting before the first.
_bounded: dict[int, tuple[int, str | None]] = {}
_bounding = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or given to ``setCheckpointDir``.

    Where both are unset, a session whose only machine is this one, as in tests, gets a fresh local folder. On a
    cluster that is an error, as executors would write to their own disks.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("semspark.shared.dir", None)
    if known:
        return known
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        known = given.get()
    elif context.master == "local" or context.master.startswith("local["):
        known = "file://" + tempfile.mkdtemp(prefix="semspark-")
    else:
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    spark.conf.set("semspark.shared.dir", known)
    return known


def new_path(spark: SparkSession, label: str) -> str:
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    if (own := _open.get()) is not None:
        own.append(path)
    return path


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds the Arrow batches of jobs inside it by their bytes, so that a batch of long texts, which the JVM and
    Python both hold, takes no more memory than one of short texts. A lower bound of the session stays."""
    key = id(spark._jsparkSession)
    with _bounding:  # jobs of several threads share the setting; the last one to end puts it back
        n, before = _bounded.get(key, (0, None))
        if not n:
            before = spark.conf.get(BATCH_CONF, None)
            if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before or "64m") > BATCH_BYTES:
                spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
        _bounded[key] = (n + 1, before)
    try:
        yield
    finally:
        with _bounding:
            n, before = _bounded.pop(key)
            if n > 1:
                _bounded[key] = (n - 1, before)
            elif before:
                spark.conf.set(BATCH_CONF, before)
            else:
                spark.conf.unset(BATCH_CONF)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = new_path(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that may be broadcast; their count is checked first.
FEW = 1_000_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A written table with a hint to broadcast it if it has ``most`` rows or fewer, else to join it by shuffles."""
    return df.hint("broadcast" if df.count() <= most else "merge")


def _delete(spark: SparkSession, path) -> None:
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a frame made by ``written`` once nothing reads them again."""
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        _delete(spark, jvm.org.apache.hadoop.fs.Path(file).getParent())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what this thread wrote to the shared folder inside it. Frames made inside are not to be read later;
    write what is to stay outside of it, or to a path of your own."""
    own: list[str] = []
    before = _open.set(own)
    try:
        yield
    finally:
        _open.reset(before)
        for path in own:
            _delete(spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
