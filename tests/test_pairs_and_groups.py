"""Joins, orders, aggregates and groups by meaning, each against a plain version, with what they ask."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import semspark as ss
from semspark.operators import pairs
from semspark.runtime.metrics import RunMetrics


def model(rule, spark=None, **options):
    metrics = RunMetrics(spark) if spark else None
    return ss.CallableLLM(rule, metrics=metrics, **options), metrics


def same_word(text):
    pair = json.loads(text)
    return {"answer": str(pair["first"]["name"] or "").split(" ")[0] == pair["second"]["word"]}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_equals_all_pairs(spark, how):
    """Hot inputs, nulls, clashing columns, rows without a partner; the model sees few of all pairs."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(40)]
    left = [(k, None if k % 29 == 0 else f"{words[0] if k % 3 == 0 else rng.choice(words)} {k % 4}") for k in range(300)]
    right = [(k, w) for k, w in enumerate(words[:30])] + [(90, words[0]), (91, None)]
    a = spark.createDataFrame(left, "id long, name string")
    b = spark.createDataFrame(right, "id long, word string")
    llm, metrics = model(same_word, spark)
    made = ss.sem_join(llm, a, b, prompt="begins the first with the second?", left_fields=["name"], right_fields=["word"], how=how, top_k=8)
    both = [(i, n, j, w) for i, n in left for j, w in right if n and w and n.split(" ")[0] == w]
    hit = {p[0] for p in both}
    want = {"inner": both, "left": both + [(i, n, None, None) for i, n in left if i not in hit], "left_semi": [r for r in left if r[0] in hit], "left_anti": [r for r in left if r[0] not in hit]}[how]
    assert sorted(map(str, (tuple(r) for r in made.collect()))) == sorted(map(str, want))
    assert made.columns == (["id", "name"] if "semi" in how or "anti" in how else ["id", "name", "id_right", "word"])
    distinct = len({n for _, n in left}) * len({w for _, w in right})
    assert 0 < metrics.values()["rows"] < distinct / 3


def test_join_of_empty_frames(spark):
    a = spark.createDataFrame([(1, "x y")], "id long, name string")
    b = spark.createDataFrame([], "word string")
    llm, _ = model(same_word)
    assert ss.sem_join(llm, a, b, prompt="p", left_fields=["name"]).collect() == []
    assert ss.sem_join(llm, a.limit(0), b, prompt="p", left_fields=["name"], how="left").collect() == []
    assert ss.sem_join(llm, a, b, prompt="p", left_fields=["name"], how="left_anti").count() == 1


@pytest.mark.parametrize(("k", "last"), [(1, 0), (7, 0), (7, 50), (40, 2000), (1000, 2000), (1000, 100)])
def test_top_rows_are_those_of_the_order(spark, monkeypatch, k, last):
    """Ties and repeated inputs go by id; answers that cannot be read count as False; few more rows are asked than are there."""
    monkeypatch.setattr(pairs, "LAST", last)
    rng = random.Random(k)
    rows = [(i, rng.choice([None, *range(400)])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v int").withColumns({"rank_": F.lit(1), "input": F.lit(2)})

    def more(text):
        pair = json.loads(text)
        if pair["first"]["v"] is None:
            raise ValueError("no answer")
        return {"answer": pair["second"]["v"] is None or pair["first"]["v"] > pair["second"]["v"]}

    llm, metrics = model(more, spark)
    got = ss.sem_top_k(llm, df, prompt="more?", k=k, id_col="id", input_fields=["v"], max_retries=0)
    want = sorted(rows, key=lambda r: (-1 if r[1] is None else -r[1] - 2, r[0]) if r[1] is not None else (1, r[0]))[:k]
    assert [(r.id, r.v, r.rank) for r in got.orderBy("rank").collect()] == [(i, v, n) for n, (i, v) in enumerate(want, 1)]
    if k <= 7:
        assert metrics.values()["rows"] < 4 * 401
    assert ss.sem_top_k(llm, df.limit(0), prompt="more?", k=k, id_col="id", input_fields=["v"]).collect() == []


def tally(text):
    """Counts letters of rows, or adds up such counts."""
    total = Counter()
    for row in json.loads(text):
        total.update(row["counts"] if "counts" in row else Counter(row["t"] or "-"))
    return {"answer": {"counts": dict(total)}}


def test_aggregates_of_any_size(spark):
    """A hot group far larger than a prompt, rows longer than a prompt, a null group, repeated rows."""
    rng = random.Random(5)
    rows = [("hot" if k % 3 else rng.choice(["a", "b", None]), "".join(rng.choice("xyz") for _ in range(rng.randint(0, 12))) or None) for k in range(900)]
    rows += [("long", "x" * 3000), ("long", "y"), ("one", "z")] + [("b", "same")] * 50
    df = spark.createDataFrame(rows, "g string, t string").withColumn("n_rows", F.lit("clash")).repartition(3)

    llm, metrics = model(tally, spark)
    made = ss.sem_agg(llm, df, prompt="tally", group_columns=["g"], input_fields=["t"], budget=60).collect()
    want, sizes = {}, Counter(g for g, _ in rows)
    for g, t in rows:
        want.setdefault(g, Counter()).update(t or "-")
    assert {r.g: Counter(json.loads(r.summary)["counts"]) for r in made} == want
    assert {r.g: r.n_rows for r in made} == sizes and all(r.errors == 0 for r in made)
    assert metrics.values()["rows"] < len(rows)
    whole = ss.sem_agg(llm, df, prompt="tally", input_fields=["t"], budget=60).collect()
    assert len(whole) == 1 and Counter(json.loads(whole[0].summary)["counts"]) == sum(want.values(), Counter())
    assert ss.sem_agg(llm, df.limit(0), prompt="tally", group_columns=["g"]).collect() == []


def test_lists_without_an_answer_are_counted(spark):
    df = spark.createDataFrame([("a", "bad"), ("b", "good"), ("b", "fine")], "g string, t string")

    def rule(text):
        if "bad" in text:
            raise ValueError("no")
        return {"answer": {"counts": {"n": len(json.loads(text))}}}

    got = {r.g: (r.summary, r.errors) for r in ss.sem_agg(ss.CallableLLM(rule), df, prompt="p", group_columns=["g"], max_retries=0).collect()}
    assert got["a"] == (None, 1) and got["b"] == ('{"counts": {"n": 2}}', 0)


def test_groups_by_labels(spark):
    """Labels come from a sample and are merged; every row gets one; one that cannot be labelled gets null."""

    def rule(text):
        row = json.loads(text)
        if isinstance(row, list):
            return {"answer": sorted({label.lower() for label in row})}
        if row["n"] == 13:
            raise ValueError("no")
        word = ["small", "middle", "large"][min(2, row["n"] // 10)]
        return {"answer": word if "labels are" in prompt[0] else word.upper() if row["n"] % 2 else word}

    prompt = [""]
    df = spark.createDataFrame([(k, k % 37) for k in range(400)], "id long, n long").withColumns({"text": F.lit("clash"), "label": F.lit("old")})
    labels = ss.discover_labels(ss.CallableLLM(rule), df, prompt="size", input_fields=["n"], sample=37, max_retries=0)
    assert labels == ["large", "middle", "small"]
    prompt[0] = "labels are"
    llm, metrics = model(rule, spark)
    got = ss.sem_group_by(llm, df, prompt="size", input_fields=["n"], labels=labels, max_retries=0)
    assert sorted((r.id, r.label) for r in got.collect() if r.n != 13) == [(k, labels[::-1][min(2, k % 37 // 10)]) for k in range(400) if k % 37 != 13]
    assert {r.label for r in got.where("n = 13").collect()} == {None} and set(got.columns) == set(df.columns)
    assert metrics.values()["rows"] == 38  # one for each input, and the unanswered one again
    assert ss.sem_group_by(llm, df.limit(0), prompt="size", input_fields=["n"]).collect() == []


def test_labels_of_many_inputs_are_not_broadcast_in_copies(spark):
    """Rows get their labels by shuffles, however small the file of labels is."""
    llm, _ = model(lambda text: {"answer": "odd" if json.loads(text)["id"] % 2 else "even"})
    df = spark.range(3000)
    got = ss.sem_group_by(llm, df, prompt="parity", labels=["odd", "even"])
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()
    assert got.groupBy("label").count().collect() and got.where("(id % 2 = 1) <> (label = 'odd')").isEmpty()
