"""Plans over several frames, registered functions, windows, and the counts of their steps."""

import logging
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from semspark.agent import Agent, PlanError, StepCounts, register_function, register_table_function, run_plan
from semspark.operators.asof import asof_join
from semspark.runtime.clients import ScriptedLLM


def steps(*named):
    return [{"operation": name, "params": params} for name, params in named]


@pytest.mark.parametrize("span_rows", [1 << 20, 40])
def test_asof_join_takes_the_last_row_that_is_not_later(spark, span_rows):
    """A hot key, ties, nulls in key and order, keys of one side only, clashing columns; in one span and in many."""
    rng = random.Random(span_rows)
    key = lambda: rng.choice(["hot", "hot", "a", "b", None, "only left"])
    left = [(i, key(), rng.choice([None, *range(300)])) for i in range(500)]
    right = [(i, k if (k := key()) != "only left" else "only right", rng.choice([None, *range(0, 300, 7)])) for i in range(200)]
    a = spark.createDataFrame(left, "id long, k string, t int").repartition(3)
    b = spark.createDataFrame(right, "id long, key string, t int").repartition(3)
    got = asof_join(a, b, by=["k"], on="t", right_by=["key"], span_rows=span_rows)
    assert got.columns == ["id", "k", "t", "id_right", "t_right"]
    want = []
    for i, k, t in left:
        own = [(rt, j) for j, rk, rt in right if rk == k and k is not None and t is not None and rt is not None and rt <= t]
        best = max((rt for rt, _ in own), default=None)
        j = max((j for rt, j in own if rt == best), default=None)
        want.append((i, k, t, j, best))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert asof_join(a.limit(0), b, by=["k"], on="t", right_by=["key"]).collect() == []
    assert asof_join(a, b.limit(0), by=["k"], on="t", right_by=["key"], columns=["id"]).where("id_right is not null").count() == 0
    dated = asof_join(a.select("id", F.date_add(F.lit("2024-01-01").cast("date"), F.coalesce("t", F.lit(0))).alias("day")).withColumn("one", F.lit(1)), spark.sql("select 1 as one, date'2024-03-01' as day, 'x' as v"), by=["one"], on="day", columns=["v"])
    assert dated.where("(day >= '2024-03-01') <> (v is not null)").count() == 0


def test_functions_of_plans(spark):
    """A frame may have a column x (or X); registered functions are typed, and no others are allowed."""

    @register_function("test_twice", "long")
    def twice(numbers: pa.Array) -> pa.Array:
        return pc.multiply(numbers, 2)

    @register_table_function("test_upto", "n int")
    class Upto:
        def eval(self, n: int):
            for k in range(n or 0):
                yield (k,)

    df = spark.createDataFrame([(1, 10, "a"), (2, None, "b"), (0, 30, None)], "id long, X long, made string")
    run = lambda *s, **o: run_plan(steps(*s), df, **o)
    apply = lambda new, source, function, **o: ("apply_function", {"new_column": new, "source_column": source, "function": function, **o})
    got = run(apply("y", "id", "x * 2 + id"), apply("z", "X", "test_twice", dtype="string"), apply("x2", "id", "test_twice(x) + 1"))
    assert got.columns == ["id", "X", "made", "y", "z", "x2"]
    assert [tuple(r) for r in got.collect()] == [(1, 10, "a", 3, "20", 3), (2, None, "b", 6, None, 5), (0, 30, None, 0, "60", 1)]
    assert [tuple(r) for r in run(apply("X", "id", "x + 1")).collect()] == [(1, 2, "a"), (2, 3, "b"), (0, 1, None)]
    rows = run(("table_function", {"function": "test_upto", "arguments": ["id"]}), ("select_columns", {"columns": ["id", "n"]}))
    assert sorted(map(tuple, rows.collect())) == [(1, 0), (2, 0), (2, 1)]
    outer = run(("table_function", {"function": "test_upto", "arguments": ["id"], "outer": True}))
    assert sorted((r.id, r.n) for r in outer.collect() if r.n is not None) == [(1, 0), (2, 0), (2, 1)] and outer.count() == 4
    for bad in (apply("y", "id", "java_method('java.lang.System', 'exit')"), apply("y", "id", "no_such(x)"), ("table_function", {"function": "explode", "arguments": ["id"]}), apply("x", "id", "x")):
        with pytest.raises(PlanError):
            run(bad)
    for taken in ("upper", "test_twice", "Bad Name"):
        with pytest.raises(ValueError):
            register_function(taken, "int")(twice)


def test_windows_and_frames(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 5, 7), ("b", 1, 1), ("a", 9, 2)], "g string, t int, v int")
    other = spark.createDataFrame([("a", "first"), ("c", "third")], "name string, label string")
    run = lambda *s: run_plan(steps(*s), df, frames={"names": other})
    own = {"partition_by": ["g"], "order_by": ["t"]}
    got = run(("shift", {"column": "v", "new_column": "old", "periods": 1, "fill": -1, **own}), ("shift", {"column": "v", "new_column": "next", "periods": -1, **own}), ("window_agg", {"column": "v", "new_column": "near", "function": "sum", "within": [-3, 0], **own}), ("window_agg", {"column": "v", "new_column": "all", "function": "count", "rows": [None, None], **own}), ("sort_values", {"columns": ["g", "t"]}))
    assert [tuple(r) for r in got.collect()] == [("a", 1, 5, -1, None, 5, 3), ("a", 2, None, 5, 7, 5, 3), ("a", 5, 7, -1, 2, 7, 3), ("a", 9, 2, 7, None, 2, 3), ("b", 1, 1, -1, None, 1, 1)]
    joined = run(("join", {"right": "names", "on": "g", "right_on": "name", "how": "left"}), ("sort_values", {"columns": ["g", "t"]}))
    assert joined.columns == ["g", "t", "v", "label"] and [r.label for r in joined.collect()] == ["first"] * 4 + [None]
    assert run(("join", {"right": "names", "on": "g", "right_on": "name", "how": "left_anti"})).count() == 1
    for bad in (("join", {"right": "nobody", "on": "g"}), ("join", {"right": "names", "on": "g"}), ("window_agg", {"column": "v", "new_column": "n", "function": "nunique", **own}), ("asof_join", {"right": "names", "by": "g", "on": "t"})):
        with pytest.raises(PlanError):
            run(bad)


def test_steps_are_counted_without_a_job_of_their_own(spark, caplog):
    df = spark.range(100).withColumn("g", F.col("id") % 7)
    counts = StepCounts()
    plan = steps(("select_rows", {"condition": "id >= 30"}), ("drop_duplicates", {"columns": ["g"]}), ("add_column", {"new_column": "h", "expression": "g + 1"}))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    made = run_plan(plan, df, counts=counts)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before
    assert made.count() == 7
    assert counts.rows() == [("input", 100), ("select_rows", 70), ("drop_duplicates", 7), ("add_column", 7)]
    caplog.set_level(logging.WARNING)
    again = StepCounts()
    replies = ['[{"operation": "select_rows", "params": {"condition": "nope > 1"}}]', '[{"operation": "select_rows", "params": {"condition": "id < 5"}}]']
    llm = ScriptedLLM(replies)
    assert Agent(llm).do("few", df, frames={"spare": df}, counts=again, verbose=True).count() == 5
    assert again.rows() == [("input", 100), ("select_rows", 5)] and "Frame spare" in llm.prompts[0]
    assert sum("plan:" in r.message for r in caplog.records) == 2 and any("step 0: select_rows" in r.message for r in caplog.records)


def test_carried_rows_go_through_the_driver_once_at_most(spark, monkeypatch):
    """Rows handed on to later spans are broadcast without copies, or not at all."""
    from semspark.operators import asof

    a = spark.range(2000).select("id", (F.col("id") % 50).alias("k"), (F.col("id") * 7 % 900).cast("int").alias("t"))
    b = spark.range(500).select((F.col("id") % 50).alias("k"), (F.col("id") * 11 % 900).cast("int").alias("t"), F.col("id").alias("v"))
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    got = asof_join(a, b, by=["k"], on="t", span_rows=500)
    assert "Broadcast" in plan(got) and "Generate" not in plan(got)
    monkeypatch.setattr(asof, "CARRIED", 0)
    spread = asof_join(a, b, by=["k"], on="t", span_rows=500)
    assert "Broadcast" not in plan(spread) and "Generate" in plan(spread)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spread.collect())) and got.count() == 2000
