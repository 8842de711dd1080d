"""Registered queries of readers, writers, streams and the parts of the model runtime that need no operator.

Those that write put their files in the shared folder and read all of them back.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..operators.reduce import reduce
from ..operators.semantic import filter as sem_filter
from ..operators.semantic import finalize
from ..operators.semantic import map as sem_map
from ..runtime.clients import CallableLLM
from ..runtime.embedders import HashingEmbedder
from ..runtime.metrics import RunMetrics
from ..runtime.shared import new_path
from ..runtime.store import AnswerStore
from ..sources import readers
from ..streaming.semantic import read_parquet_stream, run_available
from ..streaming.stateful import answer_available, close_windows
from . import rules
from .registry import query, table


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def source_csv(spark, d):
    """CSV with a given schema."""
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    path = new_path(spark, "csv")
    readers.write_csv(df, path)
    return readers.read_csv(spark, path, df.schema)


@query("SELECT n_nationkey::INT AS n_nationkey, n_name, n_regionkey::INT AS n_regionkey FROM nation")
def source_csv_inferred(spark, d):
    """CSV whose column types are found from its values."""
    path = new_path(spark, "csv")
    readers.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return readers.read_csv(spark, path)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def source_csv_glob(spark, d):
    """Several CSV files, each with a header, named by a glob."""
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = new_path(spark, "csv")
    readers.write_csv(df.repartition(4, "o_orderkey"), path)
    return readers.read_csv(spark, f"{path}/part-*.csv", df.schema)


@query("SELECT event_id, user_id, value, props FROM events")
def source_csv_quoted(spark, d):
    """CSV whose fields hold quotes, commas and braces."""
    df = table(spark, d, "events").select("event_id", "user_id", "value", "props")
    path = new_path(spark, "csv")
    readers.write_csv(df, path)
    return readers.read_csv(spark, path, df.schema, multiline=True)


@query("SELECT event_id, user_id, value, event_type FROM events WHERE event_type = 'purchase' AND value > 10")
def source_parquet_partitioned(spark, d):
    """Parquet in folders by a column; a filter on it prunes folders and the other reaches the scan."""
    path = new_path(spark, "parquet")
    readers.write_parquet(table(spark, d, "events").select("event_id", "user_id", "value", "event_type"), path, partition_by=["event_type"])
    return readers.read_parquet(spark, path).where("event_type = 'purchase' AND value > 10").select("event_id", "user_id", "value", "event_type")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
def sink_table_overwrite(spark, d):
    """A catalog table that a second write replaces. Its name goes at the end, its files stay for the result."""
    df = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    name, path = f"semspark_{uuid.uuid4().hex}", new_path(spark, "table")
    try:
        readers.write_table(df, name, path=path)
        readers.write_table(df.where("s_acctbal > 0"), name, path=path)
        files = readers.read_table(spark, name).inputFiles()
        return readers.read_parquet(spark, *files) if files else df.limit(0)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@query("SELECT n_nationkey, n_name, upper(n_name) AS loud FROM nation")
def source_pandas(spark, d):
    """A pandas table dealt out to partitions, through a semantic map. nation has 25 rows at any scale."""
    df = readers.from_pandas(spark, table(spark, d, "nation").select("n_nationkey", "n_name").toPandas(), npartitions=4)
    return finalize(sem_map(prompt="say it loud", input_fields=["n_name"], output_fields=["loud"])(CallableLLM(rules.loud_nation), df))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def source_duckdb(spark, d):
    """A table written to a DuckDB file and read from it."""
    df = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    path = readers.local_file(spark, "supplier.duckdb")
    readers.write_duckdb(df, path, "supplier")
    return readers.read_duckdb(spark, path, "supplier")


@query("SELECT r_regionkey, r_name FROM region")
def source_sqlite(spark, d):
    """A table written to an SQLite file and read from it. region has 5 rows at any scale."""
    df = table(spark, d, "region").select("r_regionkey", "r_name")
    path = readers.local_file(spark, "region.sqlite")
    readers.write_sqlite(df, path, "region")
    return readers.read_sqlite(spark, path, "region", df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('purchase', 'signup')")
def stream_filter(spark, d):
    """The semantic filter in a streaming query. Each batch replaces its own folder, so one that is run again leaves
    no row twice."""
    out, state = new_path(spark, "stream"), new_path(spark, "stream-state")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    source = new_path(spark, "stream-source")
    events.repartition(4, "event_id").write.parquet(source)
    wanted = finalize(sem_filter(prompt="bought or signed up", input_fields=["event_type"])(CallableLLM(rules.wanted_event), read_parquet_stream(spark, source, events.schema, files_per_trigger=2)))
    run_available(wanted, lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}"), state)
    return spark.read.schema(events.schema).parquet(out).select(*events.columns)


@query(
    "WITH e AS (SELECT event_type, ts, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events), m AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM events) "
    "SELECT epoch(w)::BIGINT AS window_start, upper(event_type) AS label, count(*) AS n, (SELECT count(DISTINCT event_type) FROM events) AS n_asked FROM e, m WHERE w + INTERVAL 1 HOUR <= mark GROUP BY w, event_type"
)
def stream_windows(spark, d):
    """Events come in three parts in order of time. Each distinct type is asked once in the whole stream, and hours of
    labels are counted as they close; both streams are stopped after each part and go on from their checkpoints."""
    metrics, store = RunMetrics(spark), AnswerStore(new_path(spark, "stream-store"))
    source, answered, out, asked_at, closed_at = (new_path(spark, f"stream-{k}") for k in ("source", "answered", "windows", "asked", "closed"))
    events = table(spark, d, "events").select("event_type", "ts")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    op = sem_map(prompt="label", input_fields=["event_type"], output_fields=["label"], store=store)
    llm = CallableLLM(rules.event_label, metrics=metrics)
    for k in range(3):
        cut = lambda i: low + (high - low) * i / 3
        part = events.where((F.col("ts") >= cut(k) if k else F.lit(True)) & (F.col("ts") < cut(k + 1) if k < 2 else F.lit(True)))
        part.write.mode("append").parquet(source)
        answer_available(op, llm, read_parquet_stream(spark, source, events.schema), answered, asked_at)
        close_windows(spark, answered, "event_type string, ts timestamp, label string", time="ts", width="1 hour", delay="2 hours", keys=["label"], out=out, checkpoint=closed_at)
    windows = spark.read.schema("window_start timestamp, window_end timestamp, label string, n long").parquet(out)
    return windows.select(F.unix_timestamp("window_start").alias("window_start"), "label", "n", F.lit(metrics.values()["rows"]).cast("long").alias("n_asked"))


class PlainLLM(CallableLLM):
    """Answers a prompt as a whole."""

    def complete(self, prompt: str) -> str:
        return str(self.rule(prompt))


@query("SELECT n_name, CASE WHEN n_name LIKE 'A%' THEN 'error: refused' ELSE 'name: ' || n_name END AS answer FROM nation")
def llm_plain_batch(spark, d):
    """One prompt a row, side by side, on the driver; an error is its row's answer. nation has 25 rows at any scale."""
    names = [r.n_name for r in table(spark, d, "nation").select("n_name").collect()]
    answers = PlainLLM(rules.answer_name)(names, "", "name", "", optimized=False, max_retries=1)
    return spark.createDataFrame([(n, f"error: {a}" if isinstance(a, Exception) else a) for n, a in zip(names, answers, strict=True)], "n_name string, answer string")


@query("SELECT count(*) AS n_rows, count(*) FILTER (event_id % 10 = 3) AS retried, count(*) FILTER (event_id % 10 = 3) AS unanswered FROM events")
def llm_run_metrics(spark, d):
    """What a run counts: rows sent, rows sent again (one retry here) and rows without an answer."""
    metrics = RunMetrics(spark)
    df = table(spark, d, "events").select("event_id", "event_type")
    out = sem_filter(prompt="bought or signed up", max_retries=1)(CallableLLM(rules.wanted_event_or_error, metrics=metrics), df)
    out.write.format("noop").mode("overwrite").save()
    n = metrics.values()
    return spark.createDataFrame([(n["rows"], n["retried_rows"], n["unanswered_rows"])], "n_rows long, retried long, unanswered long")


@query("SELECT lang, count(*) AS n_texts, count(*) FILTER (trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS n_unit FROM documents GROUP BY lang")
def embed_texts(spark, d):
    """Embeddings of whole texts in Arrow batches: those with words have length one, the others length zero."""
    embedder = HashingEmbedder()

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed(texts.tolist())), dtype=object)

    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    vectors = table(spark, d, "documents").select("lang", embed("text").alias("vector")).select("lang", length.alias("length"))
    return vectors.groupBy("lang").agg(F.count("*").alias("n_texts"), F.count_if(F.abs(F.col("length") - 1) < 1e-3).alias("n_unit"))


@query("SELECT * FROM (VALUES ('action', 'ValueError'), ('frame', 'TypeError'), ('input_fields', 'ValueError'), ('on_error', 'ValueError')) AS t(argument, error)")
def guards(spark, d):
    """The kinds of errors that wrong arguments raise before any row is read."""
    df, llm = table(spark, d, "nation"), CallableLLM(rules.loud_nation)
    calls = {
        "action": lambda: reduce(df, action="no such action"),
        "frame": lambda: sem_map(prompt="p", output_fields=["x"])(llm, ["no frame"]),
        "input_fields": lambda: sem_filter(prompt="p", input_fields=["no such column"])(llm, df),
        "on_error": lambda: sem_filter(prompt="p", on_error="no such policy")(llm, df),
    }
    found = []
    for argument, call in calls.items():
        try:
            call()
            found.append((argument, None))
        except (TypeError, ValueError) as error:
            found.append((argument, type(error).__name__))
    return spark.createDataFrame(found, "argument string, error string")
