import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import semspark as ss
from semspark.agent import AgentError, PlanError, run_plan
from semspark.operators.clusters import greedy
from semspark.operators.dedup import BLOCK, nearest, nearest_banded, read_verdict
from semspark.plans.rules import same_text
from semspark.runtime.clients import ScriptedLLM
from semspark.runtime.embedders import HashingEmbedder, unit
from semspark.runtime.metrics import RunMetrics


def people(spark, parts=3):
    rows = [(i, f"name {i}", None if i == 4 else float(i)) for i in range(10)]
    return spark.createDataFrame(rows, "id long, name string, score double").repartition(parts)


def decide(text):
    i = json.loads(text)["id"]
    if i in (2, 9):
        raise ValueError("no answer")
    return {"__filter__": "TRUE" if i % 2 else False}


@pytest.mark.parametrize("parts", [1, 3, 12])
def test_filter_policies(spark, parts):
    df = people(spark, parts)
    llm = ss.CallableLLM(decide)
    keep = ss.finalize(ss.filter(prompt="odd", max_retries=0)(llm, df))
    assert sorted(r.id for r in keep.collect()) == [1, 2, 3, 5, 7, 9] and keep.columns == df.columns
    gone = ss.filter(prompt="odd", on_error="delete", max_retries=0)(llm, df)
    assert sorted(r.id for r in ss.finalize(gone).collect()) == [1, 3, 5, 7]
    assert sorted(r.id for r in ss.finalize(gone, keep_errored_rows=True).collect()) == [1, 2, 3, 5, 7, 9]


def test_each_row_is_sent_once(spark, tmp_path):
    def rule(text):
        (tmp_path / f"{json.loads(text)['id']}-{len(list(tmp_path.iterdir()))}").touch()
        return {"__filter__": json.loads(text)["id"] > 3}

    df = ss.filter(prompt="x")(ss.CallableLLM(rule), people(spark, 2).coalesce(1))
    ss.finalize(df).where("id > 5").collect()
    assert len(list(tmp_path.iterdir())) == 10


def test_dropped_rows_stay_dropped_and_are_not_sent(spark):
    first = ss.filter(prompt="small")(ss.CallableLLM(lambda t: {"__filter__": json.loads(t)["id"] < 5}), people(spark))

    def second(text):
        assert json.loads(text)["id"] < 5
        return {"__filter__": True}

    out = ss.filter(prompt="any")(ss.CallableLLM(second), first)
    assert out.where("__sem_error").count() == 0
    assert ss.finalize(out).count() == 5


def test_map_types_nulls_and_misfits(spark):
    def rule(text):
        i = json.loads(text)["id"]
        return {0: {"score": "bad", "tag": [1, "x"]}, 1: {"score": None}, 2: {"tag": {"a": "}"}}}.get(i, {"score": i * 2})

    out = ss.map(prompt="p", output_fields={"score": "double", "tag": "string"})(ss.CallableLLM(rule), people(spark))
    got = {r.id: (r.score, r.tag, r["__sem_error"]) for r in out.collect()}
    assert got[0] == (0.0, '[1,"x"]', True) and got[1] == (None, None, False)
    assert got[2] == (2.0, '{"a":"}"}', False) and got[3] == (6.0, None, False)


def test_missing_input_field_and_wrong_frame(spark):
    with pytest.raises(ValueError, match="available"):
        ss.map(prompt="p", input_fields=["nope"])(ss.CallableLLM(str), people(spark))
    with pytest.raises(TypeError):
        ss.filter(prompt="p")(ss.CallableLLM(str), [1])
    with pytest.raises(ValueError):
        ss.filter(prompt="p", on_error="explode")


def test_clusters_share_one_answer(spark, tmp_path):
    def rule(text):
        (tmp_path / str(json.loads(text)["id"])).touch()
        return {"tag": str(json.loads(text)["id"])}

    op = ss.map(prompt="p", output_fields=["tag"], clusters=[{"canonical_id": 1, "duplicate_ids": [3, 5, 1]}], id_col="id")
    got = {r.id: r.tag for r in op(ss.CallableLLM(rule), people(spark)).collect()}
    assert got[3] == got[5] == got[1] == "1" and got[2] == "2"
    assert not {"3", "5"} & {p.name for p in tmp_path.iterdir()}


def test_greedy_rule():
    assert greedy({0: [0, 1], 1: [1, 0, 2], 2: [2, 1]}) == [[1, 0]]
    assert greedy({0: [0], 1: [1, 0]}) == [[0, 1]]


def test_verdicts():
    assert read_verdict("{'canonical_id': 1, 'duplicate_ids': [2]}")["duplicate_ids"] == [2]
    assert read_verdict("NO_DUPLICATES")["error"] is None
    for bad in ("[1]", "{'canonical_id': 'x', 'duplicate_ids': []}", "??"):
        assert read_verdict(bad)["error"]


def test_dedup(spark):
    df = spark.createDataFrame([(1, "red apple"), (2, "red apple"), (3, "blue whale"), (4, "red apple"), (5, None)], "id long, t string")
    merges = ss.reduce(df, action="dedup", id_col="id", sim_threshold=0.99).collect()
    assert [(m.canonical_id, m.duplicate_ids) for m in merges] == [(1, [2, 4])]
    assert sorted(r.id for r in ss.reduce(df, action="dedup", id_col="id", sim_threshold=0.99, return_df=True).collect()) == [1, 3, 5]
    with pytest.raises(ValueError):
        ss.reduce(df, action="nope")


@pytest.mark.parametrize("llm", [None, ss.CallableLLM(same_text)])
def test_dedup_merges_groups_larger_than_top_k(spark, llm):
    rows = [(k, f"red apple {k % 2}", "a" if k % 5 else None) for k in range(240)] + [(900, "blue whale", None), (901, "blue whale", None), (902, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, other string")
    make = lambda whole: ss.reduce(df, action="dedup", llm=llm, id_col="id", input_fields=["text"], sim_threshold=0.9999, top_k=50, return_df=whole)
    got = {m.canonical_id: m.duplicate_ids for m in make(False).collect()}
    assert got == {0: list(range(2, 240, 2)), 1: list(range(3, 240, 2)), 900: [901]}
    assert sorted(r.id for r in make(True).collect()) == [0, 1, 900, 902]


def test_dedup_of_many_texts_with_one_vector(spark):
    rows = [(k, " ".join("RED" if k >> b & 1 else "red" for b in range(7))) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, text string")
    merges = ss.reduce(df, action="dedup", id_col="id", sim_threshold=0.9999, top_k=50).collect()
    assert [(m.canonical_id, m.duplicate_ids) for m in merges] == [(0, list(range(1, 120)))]


def test_plans_refuse_what_is_not_allowed(spark):
    df = people(spark)
    for expression in ("reflect('java.lang.System', 'getProperty', 'x')", "(select 1)", "java_method('a','b')", "1 +"):
        with pytest.raises(PlanError):
            run_plan([{"operation": "add_column", "params": {"new_column": "x", "expression": expression}}], df)
    for plan in ([{"operation": "drop_table"}], [{"operation": "fillna", "params": {"column": "id"}}], [{"operation": "group_by", "params": {"group_columns": ["id"]}}], {}):
        with pytest.raises(PlanError):
            run_plan(plan, df)
    with pytest.raises(PlanError):
        run_plan([{"operation": "add_column", "params": {"new_column": "ID", "expression": "1"}}], df)


def test_group_by_agg_follows_dataframe_habits(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    out = run_plan([{"operation": "group_by_agg", "params": {"group_columns": ["k"], "aggregations": {"v": "sum"}}}], df)
    assert sorted(tuple(r) for r in out.collect()) == [("a", 0.0), ("b", 2.0)]


def test_agent_gives_up_with_an_error(spark):
    bad = json.dumps([{"operation": "select_columns", "params": {"columns": ["nope"]}}])
    llm = ScriptedLLM([bad] * 2)
    with pytest.raises(AgentError):
        ss.Agent(llm).do("x", people(spark), max_iterations=2)
    assert "nope" in llm.prompts[1]


def test_streams_run_the_same_operator(spark, tmp_path):
    from semspark.streaming.semantic import read_parquet_stream, run_available

    people(spark).write.parquet(str(tmp_path / "in"))
    out = ss.finalize(ss.filter(prompt="odd", max_retries=0)(ss.CallableLLM(decide), read_parquet_stream(spark, str(tmp_path / "in"))))
    run_available(out, lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_user_columns_may_have_any_name(spark):
    names = ["canonical", "dup", "of_canonical", "given", "sent", "first_id", "gone_id"]
    df = people(spark).select("*", *[F.lit(n).alias(n) for n in names])
    rule = lambda t: {"tag": str(json.loads(t)["id"])}
    op = ss.map(prompt="p", output_fields=["tag"], clusters=[{"canonical_id": 1, "duplicate_ids": [3]}], id_col="id")
    got = ss.finalize(op(ss.CallableLLM(rule), df))
    assert got.columns == [*df.columns, "tag"] and {r.id: r.tag for r in got.collect()}[3] == "1"
    got = ss.finalize(ss.map(prompt="p", output_fields=["tag"], collapse=True)(ss.CallableLLM(rule), df))
    assert got.columns == [*df.columns, "tag"] and all(r.tag == str(r.id) and r.sent == "sent" for r in got.collect())
    left = ss.reduce(df, action="dedup", id_col="id", return_df=True, sim_threshold=0.9999)
    assert left.columns == df.columns


def test_rows_are_dealt_out_before_model_calls(spark):
    df = people(spark).coalesce(1)
    out = ss.map(prompt="p", output_fields=["tag"])(ss.CallableLLM(lambda t: {"tag": "x"}), df)
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    again = ss.filter(prompt="p")(ss.CallableLLM(lambda t: {"__filter__": True}), out)
    assert again.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    slow = ss.CallableLLM(lambda t: {"tag": "x"}, rpm=9)
    assert ss.map(prompt="p", output_fields=["tag"])(slow, df).rdd.getNumPartitions() == 2
    ordered = ss.map(prompt="p", output_fields=["tag"])(ss.CallableLLM(lambda t: {"tag": "x"}), people(spark).orderBy(F.desc("id")))
    assert [r.id for r in ordered.collect()] == list(range(9, -1, -1))


def test_run_metrics(spark):
    metrics = RunMetrics(spark)
    ss.finalize(ss.filter(prompt="odd", max_retries=1)(ss.CallableLLM(decide, metrics=metrics), people(spark))).collect()
    got = metrics.values()
    assert got["rows"] == 10 and got["retried_rows"] == 2 and got["unanswered_rows"] == 2 and got["requests"] >= 2 and got["tokens_sent"] > 0


def test_banded_neighbours_find_nine_in_ten(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((700, 64))
    near = base[:400] + 0.45 * rng.standard_normal((400, 64))
    vec = unit(np.concatenate([base, near]).astype(np.float32))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "id long, vec array<float>")
    exact = {(r.id, r.hit) for r in nearest(vectors, 50, 0.9, block=300).collect()}
    for block in (BLOCK, 20):
        got = {(r.id, r.hit): r.score for r in nearest_banded(vectors, 50, 0.9, block=block).collect()}
        assert got.keys() <= exact and len(got) >= 0.9 * len(exact) and len({p for p in got if p[0] != p[1]}) >= 0.9 * sum(a != b for a, b in exact)
        assert all(abs(s - float(vec[a] @ vec[b])) < 1e-4 for (a, b), s in got.items())
    full = vec @ vec.T
    assert exact == {(i, j) for i in range(len(vec)) for j in range(len(vec)) if full[i, j] >= 0.9}
    df = spark.createDataFrame([(k, f"red apple {k % 3} {'x' * (k % 2)}") for k in range(60)], "id long, text string")
    made = [{m.canonical_id: m.duplicate_ids for m in ss.reduce(df, action="dedup", id_col="id", sim_threshold=0.9999, index=i, hnsw_m=32, ef_search=128).collect()} for i in ("exact", "banded", "graph")]
    assert made[0] == made[1] == made[2] and len(made[0]) == 6
    with pytest.raises(ValueError, match="index"):
        ss.SemanticDeduplicator(index="tree")


def test_hashed_trigrams_are_those_of_the_words():
    embedder = HashingEmbedder(64)
    a, b, c, d, e = embedder.embed(["Red  apple", "apple\n red", "red applf", "", "ß\U0001f600 \ud800"])
    assert np.allclose(a, b) and a @ c > 0.6 and not d.any() and abs(np.linalg.norm(e) - 1) < 1e-5
    alone = [embedder._counts(w) for w in ("red", "apple", "x")]
    assert np.array_equal(embedder._counts("red x apple red"), 2 * alone[0] + alone[1] + alone[2]) and np.abs(alone[2]).sum() == 1
