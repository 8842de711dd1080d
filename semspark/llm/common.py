"""Small helpers shared by the corpus operators: tables, checkpoints, safe column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import fresh  # noqa: F401  used by the operators
from ..runtime.shared import forget, new_path, scratch, shared_dir, written  # noqa: F401  used by the operators

#: A word is a run of characters other than the space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of a few numbers that may be broadcast; their count is checked first, and longer lists are joined by shuffles.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A written table with a hint to broadcast it if it has ``most`` rows or fewer, else to join it by shuffles."""
    return df.hint("broadcast" if df.count() <= most else "merge")


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")
