"""Neighbour graphs, greedy clusters over ranges, ids of any type, the content store."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import semspark as ss
from semspark.functions.numbering import numbered
from semspark.functions.skew import hot_join, spread_join
from semspark.operators import dedup, graph
from semspark.operators.clusters import clusters, greedy
from semspark.operators.dedup import nearest_banded
from semspark.plans.rules import same_text
from semspark.runtime.embedders import HashingEmbedder, unit
from semspark.runtime.metrics import RunMetrics
from semspark.runtime.shared import few, new_path, written
from semspark.runtime.store import AnswerStore, VectorStore


def vectors_of(n, dim, groups, seed=3):
    """Half of the vectors at random, half in tight groups of many."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    near = centres[rng.integers(0, groups, n // 2)] + 0.05 * rng.standard_normal((n // 2, dim))
    return unit(np.concatenate([rng.standard_normal((n - n // 2, dim)), near]).astype(np.float32))


def test_graph_finds_nine_in_ten():
    vec = vectors_of(1500, 32, 5)
    vec = vec[np.random.default_rng(1).permutation(len(vec))]
    true = np.argsort(-(vec @ vec.T), axis=1, kind="stable")[:, :10]
    for m, ef in ((16, 64), (32, 128)):
        ids, score = graph.SmallWorld(vec, m, ef).search(vec, ef)
        assert np.all(np.diff(score, axis=1) <= 0) and all(len(set(r.tolist())) == len(r) for r in ids[:50])
        assert np.mean([len(set(a[:10].tolist()) & set(b.tolist())) for a, b in zip(ids, true)]) > 9.5
    worse = graph.SmallWorld(vec, 4, 8).search(vec, 10)[0]
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) for a, b in zip(worse, true)]) < 9.5  # m and ef mean something
    assert graph.SmallWorld(np.zeros((0, 8), np.float32)).search(vec[:0, :8], 5)[0].shape == (0, 5)


def test_graphs_over_cells(spark, monkeypatch):
    """In several cells, with cells cut into several graphs and searched in several parts."""
    vec = vectors_of(1200, 24, 6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)] + [(-1, None)], "id long, vec array<float>")
    exact = graph.nearest_exact(df, F.col("id") % 7 == 0, 10)
    full = vec @ vec.T
    want = {(i, j) for i in range(0, 1200, 7) for j in np.argsort(-full[i], kind="stable")[:10].tolist()}
    assert len({(r.id, r.hit) for r in exact.collect()} & want) >= len(want) - 5  # ties in the last place
    for cell, parts in ((1 << 20, 1 << 20), (100, 1 << 20), (300, 150)):
        monkeypatch.setattr(graph, "CELL", cell)
        monkeypatch.setattr(graph, "GRAPH", parts)
        monkeypatch.setattr(graph, "SEARCHED", parts)
        found = graph.nearest_graph(df, 10, -2.0, m=8, ef=48, probes=6, asked=F.col("id") % 7 == 0)
        assert graph.recall(found, exact) > 0.9
        assert found.groupBy("id").count().where("count <> 10").isEmpty()
    close = {(r.id, r.hit) for r in graph.nearest_graph(df, 50, 0.9).collect()}
    assert all(full[a, b] > 0.8999 for a, b in close) and {(i, i) for i in range(1200)} <= close
    empty = df.limit(0)
    assert graph.nearest_graph(empty).collect() == nearest_banded(empty).collect() == graph.nearest_exact(empty, F.lit(True), 3).collect() == []


def ruled(rows):
    by = {}
    for a, h, _ in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        by.setdefault(a, []).append(h)
    return sorted((min(m), m) for m in greedy(by))


def test_recall_is_reached_in_many_cells(spark, monkeypatch):
    """Random vectors, whose neighbours are in all cells: probes and beams that are too small are raised."""
    vec = unit(np.random.default_rng(8).standard_normal((1500, 32)).astype(np.float32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "id long, vec array<float>")
    asked, held = F.col("id") % 5 == 0, F.col("id") % 3 > 0
    monkeypatch.setattr(graph, "CELL", 100)
    exact = graph.nearest_exact(df, asked, 10, held=held)
    full = np.where(np.arange(1500) % 3 > 0, vec @ vec.T, -9)
    assert {(r.id, r.hit) for r in exact.collect()} == {(i, j) for i in range(0, 1500, 5) for j in np.argsort(-full[i], kind="stable")[:10].tolist()}
    few_probes = {"m": 4, "ef": 10, "probes": 1, "asked": asked, "held": held}
    assert graph.recall(graph.nearest_graph(df, 10, -2.0, **few_probes), exact) < 0.8
    assert graph.recall(graph.nearest_graph(df, 10, -2.0, recall=0.9, **few_probes), exact) >= 0.9
    monkeypatch.setattr(graph, "BEAM", 5)
    assert graph.recall(graph.nearest_graph(df, 10, -2.0, recall=0.9, **few_probes), exact) >= 0.9


def test_clusters_in_ranges_follow_the_sequential_rule(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(200), rng.randrange(200), rng.choice([0.9, 0.95, 1.0])) for _ in range(500)]
    df = spark.createDataFrame(rows, "id long, hit long, score float").repartition(4)
    for size in (1 << 20, 60):
        assert sorted((r.cluster_id, list(r.members)) for r in clusters(df, size).collect()) == ruled(rows)
    assert clusters(df.limit(0)).collect() == []


@pytest.mark.parametrize("sorted_ids", [True, False])
def test_one_component_of_many_ranges(spark, sorted_ids):
    """A path of 10^5 ids, which no task holds whole: in id order each range waits for the one before it."""
    ids = list(range(100_000))
    if not sorted_ids:
        random.Random(2).shuffle(ids)
    rows = list(zip(ids, ids[1:]))
    df = spark.createDataFrame(rows, "id long, hit long").withColumn("score", F.lit(0.9).cast("float")).repartition(4)
    got = sorted((r.cluster_id, list(r.members)) for r in clusters(df, 25_000).collect())
    assert got == ruled([(a, b, 0.9) for a, b in rows])


def test_ids_of_any_type(spark):
    texts = ["red apple", "red apple", "Red  apple", "green pear", None, "", "green pear", "blue plum"]
    rows = [(f"id-{9 - k}", t, k) for k, t in enumerate(texts)] + [(None, "red apple", 99)]
    df = spark.createDataFrame(rows, "key string, text string, row_number int")
    merged = ss.reduce(df, action="dedup", id_col="key", input_fields=["text"], pairs=True, sim_threshold=0.9999)
    assert sorted(tuple(r) for r in merged.collect()) == [("id-6", "id-3"), ("id-8", "id-7"), ("id-9", "id-7")]
    arrays = ss.reduce(df, action="dedup", id_col="key", input_fields=["text"], sim_threshold=0.9999)
    assert sorted((r.canonical_id, list(r.duplicate_ids)) for r in arrays.collect()) == [("id-3", ["id-6"]), ("id-7", ["id-8", "id-9"])]
    kept = ss.reduce(df, action="dedup", id_col="key", input_fields=["text"], return_df=True, sim_threshold=0.9999)
    assert kept.columns == ["key", "text", "row_number"] or set(kept.columns) == {"key", "text", "row_number"}
    assert sorted(str(r.key) for r in kept.collect()) == ["None", "id-2", "id-3", "id-4", "id-5", "id-7"]
    free = ss.reduce(df.drop("key"), action="dedup", id_col=None, input_fields=["text"], return_df=True, sim_threshold=0.9999)
    assert free.count() == 5 and set(free.columns) == {"text", "row_number"}
    asked = ss.reduce(df, action="dedup", llm=ss.CallableLLM(same_text), id_col="key", input_fields=["text"], pairs=True, sim_threshold=0.9)
    assert sorted(tuple(r) for r in asked.collect()) == [("id-6", "id-3"), ("id-9", "id-8")]
    with pytest.raises(ValueError, match="id_col"):
        ss.SemanticDeduplicator(id_col=None)
    assert ss.reduce(df.limit(0), action="dedup", id_col="key", pairs=True).collect() == []


def test_numbers_follow_the_order_of_ids(spark):
    words = [f"w{k * 7919 % 1000:04d}" for k in range(1000)]
    df = spark.createDataFrame([(w,) for w in words + words[:5]] + [(None,)], "w string").repartition(7)
    got = {r.given: r.number for r in numbered(df).collect()}
    assert got == {w: k for k, w in enumerate(sorted(words))}


def test_spread_joins_are_joins(spark):
    left = spark.createDataFrame([(k % 3, k) for k in range(50)] + [(None, 7)], "k int, salt int")
    right = spark.createDataFrame([(0, "a"), (2, "b"), (5, "c")], "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        for hot in (5, 1000):
            assert sorted(map(str, hot_join(left, right, ["k"], how, hot).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
        assert sorted(map(str, spread_join(left, right, ["k"], how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_copies_of_a_spread_join_are_not_broadcast(spark):
    """Neither those of a table whose files are small (names of text ids) nor those of a hinted one."""
    names = written(numbered(spark.range(3000).select(F.concat(F.lit("doc-"), "id").alias("key"))), "names")
    pairs = written(spark.range(3000).select("id", (F.col("id") % 7).alias("canonical_id")), "pairs")
    for right in (names, few(names)):
        joined = spread_join(pairs, right.select(F.col("number").alias("canonical_id"), "given"), ["canonical_id"])
        assert "Broadcast" not in joined._jdf.queryExecution().sparkPlan().toString()
        assert joined.count() == 3000


def test_names_of_text_ids_are_not_broadcast(spark, monkeypatch):
    """Names and ids, of few bytes in files and of any length in memory, are joined by shuffles; a hash of ids may be broadcast."""
    plans = {}

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().sparkPlan().toString()
        return written(df, label)

    monkeypatch.setattr(dedup, "written", seen)
    texts = F.concat(F.lit("text "), (F.col("id") % 70).cast("string"))
    df = spark.range(100).select(F.format_string("doc-%03d", F.col("id")).alias("key"), texts.alias("text"))
    want = [(f"doc-{k:03d}", f"doc-{k - 70:03d}") for k in range(70, 100)]
    store = VectorStore(new_path(spark, "vectors"))
    for options in ({}, {"llm": ss.CallableLLM(same_text)}, {"store": store}, {"store": store}):
        plans.clear()
        got = ss.reduce(df, action="dedup", id_col="key", input_fields=["text"], pairs=True, sim_threshold=0.9999, **options)
        assert sorted(map(tuple, got.collect())) == want
        assert not [label for label in ("least", "heads", "placed") if "Broadcast" in plans.get(label, "")]
        joins = [line for line in plans["vectors"].splitlines() if "BroadcastHashJoin" in line]
        assert "store" in options or all("[row_number#" in line for line in joins)


def test_many_buckets_are_not_broadcast(spark, monkeypatch):
    vec = vectors_of(600, 16, 3)
    df = written(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "id long, vec array<float>"), "vectors")
    few_buckets = nearest_banded(df, 20, 0.95, 0.9)
    want = sorted((r.id, r.hit) for r in few_buckets.collect())
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", 0)
    many = nearest_banded(df, 20, 0.95, 0.9)
    joins = [line for line in many._jdf.queryExecution().sparkPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in joins if "band" in line] and sorted((r.id, r.hit) for r in many.collect()) == want


def test_texts_are_embedded_once(spark):
    metrics = RunMetrics(spark)
    df = spark.createDataFrame([(k, f"text {k % 300}" if k else None) for k in range(900)], "id long, text string")
    store = VectorStore(new_path(spark, "vectors"))
    run = lambda rows, **o: ss.reduce(rows, action="dedup", id_col="id", embedder=HashingEmbedder(32, metrics), store=store, input_fields=["text"], pairs=True, sim_threshold=0.9999, **o)
    first = sorted(tuple(r) for r in run(df).collect())
    sent = metrics.values()["embedding_requests"]
    assert sent > 0 and sorted(tuple(r) for r in run(df).collect()) == first and metrics.values()["embedding_requests"] == sent
    run(df.union(spark.createDataFrame([(1000, "new")], df.schema))).collect()
    assert metrics.values()["embedding_requests"] == sent + 1 and len(store.runs(spark)) == 2
    before = store.read(spark).count()
    store.compact(spark)
    assert len(store.runs(spark)) == 1 and store.read(spark).count() == before == 302
    # A run that did not commit is not read.
    store.read(spark).limit(5).write.parquet(f"{store.path}/data/half")
    assert store.read(spark).count() == before
    plain = ss.reduce(df, action="dedup", id_col="id", embedder=HashingEmbedder(32), input_fields=["text"], pairs=True, sim_threshold=0.9999)
    assert sorted(tuple(r) for r in plain.collect()) == first


def test_answers_are_asked_once(spark):
    """Unreadable answers are asked again; another prompt or model asks anew."""
    metrics = RunMetrics(spark)
    df = spark.createDataFrame([(k, k % 5) for k in range(40)], "id long, n long")

    def rule(text):
        n = json.loads(text)["n"]
        if n == 3:
            raise ValueError("no answer")
        return {"m": n * 2}

    store = AnswerStore(new_path(spark, "answers"))
    op = lambda prompt: ss.map(prompt=prompt, input_fields=["n"], output_fields={"m": "int"}, max_retries=0, store=store)(ss.CallableLLM(rule, metrics=metrics), df)
    want = sorted((k, None if k % 5 == 3 else k % 5 * 2, k % 5 == 3) for k in range(40))
    rows = []
    for prompt in ("double", "double", "twice"):
        assert sorted((r.id, r.m, r["__sem_error"]) for r in op(prompt).collect()) == want
        rows.append(metrics.values()["rows"])
    assert rows == [5, 6, 11]
    kept = ss.filter(prompt="few", input_fields=["n"], store=store)(ss.CallableLLM(lambda t: {"__filter__": json.loads(t)["n"] < 2}), df)
    assert sorted(r.id % 5 for r in ss.finalize(kept).collect()) == [0] * 8 + [1] * 8
