"""Streams with state, stopped and started again."""

import datetime
import json
from collections import Counter

import pytest

import semspark as ss
from semspark.runtime.metrics import RunMetrics
from semspark.runtime.store import AnswerStore
from semspark.streaming.semantic import read_parquet_stream
from semspark.streaming.stateful import answer_available, close_windows

SCHEMA = "id long, word string, at timestamp"
BEGIN = datetime.datetime(2024, 1, 1)


def rule(text):
    word = json.loads(text)["word"]
    if word == "bad":
        raise ValueError("no answer")
    return {"kind": word[0]}


def test_answers_and_windows_go_on_from_their_checkpoints(spark, tmp_path):
    metrics = RunMetrics(spark)
    store = AnswerStore(f"file://{tmp_path}/store")
    op = ss.map(prompt="first letter", input_fields=["word"], output_fields=["kind"], max_retries=0, store=store)
    llm = ss.CallableLLM(rule, metrics=metrics)
    words = ["apple", "pear", "plum", "apple", "bad"]
    rows = [(k, words[k % 5], BEGIN + datetime.timedelta(minutes=k)) for k in range(300)]
    rows.append((900, "late", BEGIN))  # comes last, long after its window was closed
    rows.append((901, "none", None))
    sent = []
    for part in (rows[:100], rows[100:200], rows[200:]):
        spark.createDataFrame(part, SCHEMA).coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
        answer_available(op, llm, read_parquet_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/answered", f"{tmp_path}/ck1")
        close_windows(spark, f"{tmp_path}/answered", f"{SCHEMA}, kind string", time="at", width="10 minutes", delay="15 minutes", keys=["kind"], out=f"{tmp_path}/windows", checkpoint=f"{tmp_path}/ck2")
        sent.append(metrics.values()["rows"])
    assert sent == [4, 5, 8]  # each word once, and "bad", which has no answer to keep, again in each part
    got = spark.read.parquet(f"{tmp_path}/answered").drop("batch")
    whole = ss.finalize(ss.map(prompt="first letter", input_fields=["word"], output_fields=["kind"], max_retries=0)(ss.CallableLLM(rule), spark.createDataFrame(rows, SCHEMA)))
    assert sorted(map(str, got.select("id", "word", "at", "kind").collect())) == sorted(map(str, whole.select("id", "word", "at", "kind").collect()))
    # The greatest time is minute 299, so windows up to minute 284 are closed.
    want = Counter((k // 10 * 10, None if words[k % 5] == "bad" else words[k % 5][0]) for k in range(280))
    closed = spark.read.parquet(f"{tmp_path}/windows").collect()
    assert {((r.window_start - BEGIN).seconds // 60 + (r.window_start - BEGIN).days * 1440, r.kind): r.n for r in closed} == want and len(closed) == len(want)
    with pytest.raises(ValueError, match="store"):
        answer_available(ss.map(prompt="p"), llm, read_parquet_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/x", f"{tmp_path}/ck3")
