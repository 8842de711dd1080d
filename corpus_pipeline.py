"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

All stages take rows with nulls in any column, empty and very long texts, repeated rows and ids, extra columns of any
name, and empty tables, which give no rows. What becomes of each is said at the stage. All but the last return the
columns of their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semspark.llm import decontamination, minhash, mixing, quality_rules, tokenfiles
from semspark.llm.common import new_path, scratch, table
from semspark.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base checks or a rule learned from the labels.

    Null and empty texts have no words and go. Rows that repeat are judged alike. Labels with a null, and those of
    documents that are not there, are passed over; of several labels of a document the worst counts; without labels of
    both kinds the base checks alone decide.
    """
    rules = quality_rules.learn_from_labels(docs, table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, rules)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of least id.

    Texts without words, and rows with a null id, are no copies of anything and stay. Of the rows that repeat an id one
    stays.
    """
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item occurs.

    Null and empty texts hold no item and stay; null items and those without words occur nowhere. All rows of an id go
    if one of them holds an item, and so do all rows with a null id.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that small sources weigh more.

    A null source is one of its own. Rows that repeat an id get the same number of copies each, as do those with a null
    id. Texts are not looked at.
    """
    return mixing.replicate(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token shards and returns what the files hold of each document.

    A null text is empty and has the end id alone. Null ids come first; rows that repeat an id, such as the copies that
    mixing makes, are all written, in the order of a hash of their texts.
    """
    root = new_path(spark, "tokens")
    tokenfiles.write_shards(docs, tokenizer_path(), root)
    return tokenfiles.read_digest(spark, root)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage writes for itself is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = new_path(spark, f"stage{k}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned rules, near-duplicate groups and tokenisation are not to be had in SQL.
ORACLE_SQL = None
