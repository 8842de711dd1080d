"""Shared parts of the semantic operators: bookkeeping columns, serialised rows, names."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERNAL = "__sem_"
DELETED = "__sem_deleted"
ERROR = "__sem_error"
#: Spark gives tables of unknown size one of about 2 ** 63 bytes.
UNKNOWN_SIZE = 1 << 62

_counts: Counter[str] = Counter()
_lock = threading.Lock()


def name_for(cls: str) -> str:
    """``<class>_<n>`` with n counting from 1 for each class in this process."""
    with _lock:
        _counts[cls] += 1
        return f"{cls}_{_counts[cls]}"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


class Op:
    """An operator: ``op(llm, df)`` gives a DataFrame, and ``df.transform(op.bind(llm))`` does the same."""

    def __init__(self, name: str | None = None):
        self.name = name or name_for(type(self).__name__)

    def __call__(self, llm, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def bind(self, llm):
        return lambda df: self(llm, df)


def require_frame(df) -> None:
    if not isinstance(df, DataFrame):
        raise TypeError(f"a Spark DataFrame is needed, not {type(df).__name__}")


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(INTERNAL)]


def input_columns(df: DataFrame, fields: list[str] | None) -> list[str]:
    """The named columns, or all but the bookkeeping ones. Raises ValueError for names that are not there."""
    if not fields:
        return visible(df)
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"missing input fields {missing}; available: {visible(df)}")
    return list(fields)


def serialised(columns: list[str]) -> Column:
    """The row as JSON text with nulls kept. Angle brackets are escaped, so that no row ends its own frame."""
    if not columns:
        return F.lit("{}")
    text = F.to_json(F.struct(*[col(c) for c in columns]), {"ignoreNullFields": "false"})
    return F.replace(text, F.lit("<"), F.lit("\\u003c"))


def flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def shared_model(spark, llm):
    """(the model with what its tasks need to keep to its limits together, the number of tasks that call it at a time)."""
    slots = spark.sparkContext.defaultParallelism
    if not hasattr(llm, "shared_by"):
        return llm, slots
    tasks = llm.tasks(slots)
    return (llm.borrowing(spark) if llm.leases else llm.shared_by(tasks)), tasks


def _global_sort(plan) -> bool:
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "Sort" and getattr(plan, "global")()


def dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """``rows`` in as many partitions as tasks may call a model, so that none is idle and none calls beyond its share.

    Rows that an earlier operator dealt out, and tables that make more tasks than the session runs at a time, are left
    as they are. Rows in a global order keep it.
    """
    if rows.isStreaming:
        return rows.repartition(tasks)
    spark = rows.sparkSession
    slots = spark.sparkContext.defaultParallelism
    plan = rows._jdf.queryExecution().optimizedPlan()
    if _global_sort(plan):
        return rows.coalesce(tasks) if tasks < slots else rows
    if tasks >= slots:
        split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        size = int(str(plan.stats().sizeInBytes()))
        if DELETED in rows.columns or ERROR in rows.columns or slots * split <= size < UNKNOWN_SIZE:
            return rows
    return rows.repartition(tasks)


def answer_udf(llm, prefix: str, criteria: str, suffix: str, parse, schema: T.StructType, max_retries: int = 5):
    """An iterator UDF: one struct for each row text. ``parse`` makes the struct from an answer or an exception.

    It is marked nondeterministic, so that Catalyst neither copies it nor moves filters across it: each row is sent
    once in an execution. A null text is not sent and gives a null struct.
    """
    import pandas as pd

    names = [f.name for f in schema.fields]

    def answer(batches):
        runner = llm.runner()
        for texts in batches:
            open_ = [k for k, t in enumerate(texts) if t is not None]
            rows = [dict.fromkeys(names) for _ in range(len(texts))]
            for k, reply in zip(open_, runner.run([texts.iloc[k] for k in open_], prefix, criteria, suffix, max_retries), strict=True):
                rows[k] = parse(reply)
            yield pd.DataFrame(rows, columns=names, dtype=object)

    from collections.abc import Iterator

    answer.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(answer, schema).asNondeterministic()
