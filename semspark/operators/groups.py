"""Operators that ask a model about groups: aggregation by meaning, and grouping by meaning."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import fresh
from ..functions.skew import spread_join
from ..runtime.protocol import estimate_tokens, find_dict
from ..runtime.shared import few, forget, written
from .base import answer_udf, col, dealt, input_columns, require_frame, serialised, shared_model

ANSWER = "answer"
_PARTIAL = T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])


def _read_answer(answer) -> dict:
    """The value under ``answer``, as JSON text."""
    if isinstance(answer, Exception):
        return {"value": None, "error": str(answer) or type(answer).__name__}
    try:
        return {"value": json.dumps(find_dict(answer)[ANSWER], ensure_ascii=False), "error": None}
    except (ValueError, KeyError, RecursionError, TypeError) as error:
        return {"value": None, "error": f"unreadable: {error}"}


def _bundled(budget: int):
    """Lists of a group's texts that hold ``budget`` tokens at most; a longer text is a list of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def made():
            return pa.record_batch({"key": pa.array([key], pa.string()), "text": pa.array(["[" + ", ".join(held) + "]"]), "n": pa.array([len(held)], pa.int64())})

        for batch in batches:
            for k, bucket, text in zip(*(batch.column(c).to_pylist() for c in ("key", "bucket", "text")), strict=True):
                cost = estimate_tokens(text) + 1
                if held and ((k, bucket) != (key, own) or size + cost > budget):
                    yield made()
                    held, size = [], 0
                key, own = k, bucket
                held.append(text)
                size += cost
        if held:
            yield made()

    return run


def _bundles(rows: DataFrame, budget: int) -> DataFrame:
    """(key, text, n): the texts of each key in lists under the budget. Which texts share a list depends on their hashes
    alone; a key of many texts is dealt out to as many buckets as its lists need, so it is spread over tasks."""
    cost = F.ceil(F.char_length("text") / 4) + 1
    buckets = rows.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.sum(cost) / budget)).cast("long").alias("buckets"))
    placed = rows.join(few(written(buckets, "buckets")), "key").withColumn("bucket", F.pmod(F.xxhash64("text", "no"), F.col("buckets")))
    return placed.repartition("key", "bucket").sortWithinPartitions("key", "bucket", "text", "no").select("key", "bucket", "text").mapInArrow(_bundled(budget), "key string, text string, n long")


def sem_agg(llm, df: DataFrame, *, prompt: str, group_columns=None, input_fields=None, output: str = "summary", budget: int | None = None, max_retries: int = 5) -> DataFrame:
    """One row for each group: the group columns, ``output`` (the model's answer as JSON text), ``n_rows`` and ``errors``,
    the number of lists of rows that got no readable answer and are missing from it.

    The rows of a group are put into lists that fit a prompt, each list is answered, and the answers are put into lists
    and answered again, until one is left: ``prompt`` has to say how rows, and how answers, become an answer of the same
    form, whatever their order (the model is told which of both it gets). ``budget`` is the tokens of a list, by default
    half of what the model takes. Lists are made by hashes of the texts and of the rows' places, so the same files give
    the same lists. A group of one row is asked once. Null group values are a group. An empty frame gives no
    rows. Rows that repeat count each time. Each round is written to the shared folder, and there are as many as the
    logarithm of the largest group.
    """
    require_frame(df)
    keys = list(group_columns or [])
    fields = [c for c in input_columns(df, input_fields) if c not in keys or input_fields]
    llm, tasks = shared_model(df.sparkSession, llm)
    budget = budget or max(1, getattr(llm, "max_tokens", 4096) // 2)
    rows = df.select(serialised(keys).alias("key"), serialised(fields).alias("text"), F.monotonically_increasing_id().alias("no"))
    level = written(rows, "rows")
    counts = written(level.groupBy("key").agg(F.count("*").alias("n_rows")), "counts")
    named = df.select(serialised(keys).alias("key"), *[col(c) for c in keys]).dropDuplicates(["key"])
    finished, failed = None, None
    kind = "rows"
    while True:
        prefix = f"Each record is a list of {kind}. Answer each with a dictionary of the key {ANSWER}.\n"
        ask = answer_udf(llm, prefix, f"Task: {prompt}", "\nAnswer all records.", _read_answer, _PARTIAL, max_retries)
        asked = dealt(_bundles(level, budget), tasks).withColumn("a", ask(F.col("text")))
        answers = written(asked.select("key", "n", "a.value", "a.error"), "answers")
        forget(df.sparkSession, level)
        lost = answers.where("error is not null").select("key", F.lit(1).alias("lost"))
        failed = lost if failed is None else failed.union(lost)
        parts = answers.groupBy("key").agg(F.count("*").alias("lists"), F.max("n").alias("most"))
        done = few(written(parts.where("lists = 1").select("key"), "done"))
        last = answers.join(done, "key", "left_semi").where("error is null").select("key", "value")
        finished = last if finished is None else finished.union(last)
        rest = answers.join(done, "key", "left_anti").where("error is null").select("key", F.col("value").alias("text"), F.monotonically_increasing_id().alias("no"))
        level = written(rest, "rows")
        if level.isEmpty():
            break
        shrinks = parts.where("lists > 1 and most > 1").isEmpty()
        if shrinks:  # each answer alone fills a list: two of them go together whatever their size
            budget *= 2
        kind = "answers of parts of a whole"
    summary, n_rows, errors, key = fresh(keys, output, "n_rows", "errors", "group_key")
    total = counts.join(finished, "key", "left").join(failed.groupBy("key").agg(F.count("*").alias("lost")), "key", "left")
    out = named.withColumnRenamed("key", key).join(total, F.col(key) == F.col("key"))
    return out.select(*[col(c) for c in keys], F.col("value").alias(summary), F.col("n_rows").alias(n_rows), F.coalesce("lost", F.lit(0)).alias(errors))


def _label_of(answer) -> dict:
    read = _read_answer(answer)
    value = json.loads(read["value"]) if read["value"] is not None else None
    return {"value": value.strip() if isinstance(value, str) else None, "error": read["error"] or (None if isinstance(value, str) else "the label is no text")}


def _merged_labels(llm, labels: list[str], prompt: str, max_retries: int) -> list[str]:
    """Labels without those that mean the same as another one, in one packed call for each list that fits a prompt."""
    while True:
        lists, size = [[]], 0
        for label in sorted(labels):
            cost = estimate_tokens(label) + 2
            if lists[-1] and size + cost > llm.max_tokens // 2:
                lists.append([])
                size = 0
            lists[-1].append(label)
            size += cost
        asked = [json.dumps(own, ensure_ascii=False) for own in lists]
        prefix = f"Each record is a list of labels. Answer each with a dictionary of the key {ANSWER}: a list of labels without those that mean the same as another.\n"
        answers = llm.runner().run(asked, prefix, f"Labels for: {prompt}", "\nAnswer all records.", max_retries)
        kept: set[str] = set()
        for own, answer in zip(lists, answers, strict=True):
            value = _read_answer(answer)["value"]
            value = json.loads(value) if value is not None else own
            kept |= {v.strip() for v in value if isinstance(v, str)} if isinstance(value, list) else set(own)
        if len(lists) == 1 or len(kept) >= len(labels):
            return sorted(kept)
        labels = sorted(kept)


def discover_labels(llm, df: DataFrame, *, prompt: str, input_fields=None, sample: int = 1000, max_retries: int = 5) -> list[str]:
    """Labels for the rows of ``df``: the model labels ``sample`` distinct inputs at most, those of least hash, and then
    merges labels that mean the same. Labels and sample are bounded, so they are held on the driver."""
    llm, tasks = shared_model(df.sparkSession, llm)
    rows = df.select(serialised(input_columns(df, input_fields)).alias("text")).distinct().orderBy(F.xxhash64("text"), "text").limit(sample)
    ask = answer_udf(llm, f"Give each record a short label. Answer with a dictionary of the key {ANSWER}.\n", f"Label by: {prompt}", "\nAnswer all records.", _label_of, _PARTIAL, max_retries)
    found = dealt(written(rows, "sample"), tasks).withColumn("a", ask(F.col("text"))).where("a.value is not null").select("a.value").distinct()
    labels = [r.value for r in found.collect()]
    return _merged_labels(llm, labels, prompt, max_retries) if labels else []


def sem_group_by(llm, df: DataFrame, *, prompt: str, input_fields=None, output: str = "label", labels: list[str] | None = None, sample: int = 1000, max_retries: int = 5) -> DataFrame:
    """``df`` with the column ``output``: for every row one of ``labels``, or of those that ``discover_labels`` finds.

    Equal inputs are sent once. An answer that is none of the labels is asked again, each label by itself being an
    answer; a row that gets none has a null label. The frame can then be grouped by the label as by any column.
    """
    require_frame(df)
    if labels is None:
        labels = discover_labels(llm, df, prompt=prompt, input_fields=input_fields, sample=sample, max_retries=max_retries)
    known = set(labels)

    def read(answer) -> dict:
        got = _label_of(answer)
        return got if got["value"] in known else {"value": None, "error": got["error"] or "no such label"}

    fields = input_columns(df, input_fields)
    llm, tasks = shared_model(df.sparkSession, llm)
    (text,) = fresh([*df.columns, output], "text")
    distinct = written(df.select(serialised(fields).alias(text)).distinct(), "inputs")
    criteria = f"Label by: {prompt}. The labels are {json.dumps(labels, ensure_ascii=False)}"
    made = None
    for _ in range(2):
        ask = answer_udf(llm, f"Give each record one of the labels. Answer with a dictionary of the key {ANSWER}.\n", criteria, "\nAnswer all records.", read, _PARTIAL, max_retries)
        asked = written(dealt(distinct, tasks).withColumn("a", ask(F.col(text))).select(text, F.col("a.value").alias(output)), "labels")
        good = asked.where(col(output).isNotNull())
        made = good if made is None else made.union(good)
        distinct = written(asked.where(col(output).isNull()).select(text), "inputs")
        if distinct.isEmpty():
            break
    made = written(made, "labels")
    keyed = df.withColumn(text, serialised(fields))
    return spread_join(keyed.drop(output), made, [text], "left").drop(text)
