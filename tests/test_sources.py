import codecs
import datetime
import os

import pandas as pd
import pytest

import semspark as ss
from semspark.agent import run_plan
from semspark.runtime import shared
from semspark.runtime.shipping import ship
from semspark.sources import readers

ORDERS = "Region,Order Date,Total Revenue,Total Profit\r\nAsia,1/31/2015,200.0,50.0\r\nEurope,12/1/2016,100.0,\r\n"


def test_csv_with_byte_order_mark_and_crlf(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(codecs.BOM_UTF8 + ORDERS.encode())
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Region", "Order Date", "Total Revenue", "Total Profit"] and dict(df.dtypes)["Total Revenue"] == "double"
    plan = [{"type": "dask", "operation": "add_column", "params": {"new_column": "ProfitMargin", "expression": "`Total Profit` / `Total Revenue` * 100"}}]
    out = run_plan(plan, df)
    assert out.columns[-1] == "ProfitMargin" and [r.ProfitMargin for r in out.collect()] == [25.0, None]
    plan = [{"type": "dask", "operation": "add_column", "params": {"new_column": "Year", "expression": "year(to_date(`Order Date`, 'M/d/yyyy'))"}}]
    assert [r.Year for r in run_plan(plan, df).collect()] == [2015, 2016]


def test_csv_globs_schemas_and_quoted_lines(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.csv").write_text(f'id,zip,text\n{k},0123,"a ""quoted"", line\nand more"\n')
    df = readers.read_csv(spark, str(tmp_path / "p*.csv"), "id long, zip string, text string", multiline=True)
    rows = sorted(df.collect())
    assert [r.id for r in rows] == [0, 1, 2] and all(r.zip == "0123" and r.text == 'a "quoted", line\nand more' for r in rows)
    readers.write_csv(df, str(tmp_path / "out"))
    again = readers.read_csv(spark, str(tmp_path / "out"), df.schema, multiline=True)
    assert sorted(again.collect()) == rows


def test_pandas_and_partitions(spark):
    pdf = pd.DataFrame({"item": ["apple", "carrot", "plum", "onion"], "price": [1, 2, 3, 4]})
    df = readers.from_pandas(spark, pdf, npartitions=3)
    assert df.rdd.getNumPartitions() == 3
    kept = ss.finalize(ss.filter(prompt="a vegetable")(ss.CallableLLM(lambda t: {"__filter__": "carrot" in t or "onion" in t}), df))
    assert sorted(r.item for r in kept.collect()) == ["carrot", "onion"]
    assert readers.from_pandas(spark, pdf).count() == 4


def test_parquet_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, kind string")
    readers.write_parquet(df, str(tmp_path / "t"), partition_by=["kind"])
    assert sorted(os.listdir(tmp_path / "t"))[-2:] == ["kind=a", "kind=b"]
    assert sorted((r.id, r.kind) for r in readers.read_parquet(spark, str(tmp_path / "t")).collect()) == [(1, "a"), (2, "b")]
    readers.write_table(df, "semspark_test_table")
    try:
        assert sorted(readers.read_table(spark, "semspark_test_table").collect()) == sorted(df.collect())
    finally:
        spark.sql("drop table semspark_test_table")


def test_local_databases(spark, tmp_path):
    day = datetime.date(2024, 1, 2)
    df = spark.createDataFrame([(1, 'a "b"', 1.5, day), (2, None, None, None)], 'id long, `the text` string, x double, day date')
    file = str(tmp_path / "x.duckdb")
    readers.write_duckdb(df, file, "t 1")
    readers.write_duckdb(df, file, "t 1")
    with pytest.raises(Exception, match="exists"):
        readers.write_duckdb(df, file, "t 1", overwrite=False)
    got = readers.read_duckdb(spark, file, "t 1")
    assert got.columns == df.columns and sorted(got.collect()) == sorted(df.collect())
    plain, file = df.drop("day"), str(tmp_path / "x.sqlite")
    readers.write_sqlite(plain, file, "t")
    assert sorted(readers.read_sqlite(spark, file, "t", "id long, `the text` string, x double").collect()) == sorted(plain.collect())


def test_scratch_tables_go(spark):
    folder = shared.shared_dir(spark).removeprefix("file://")
    kept = shared.new_path(spark, "kept")
    with shared.scratch(spark):
        made = shared.written(spark.range(5).toDF("n"), "gone")
        made.write.parquet(kept)
        inside = set(os.listdir(folder))
    left = set(os.listdir(folder))
    assert any(x.startswith("gone-") for x in inside) and len(inside - left) == 1
    assert spark.read.parquet(kept).count() == 5


def test_batches_of_written_tables_are_bounded_by_bytes(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"bytes": pa.array([b.nbytes])})

    before = spark.conf.get(shared.BATCH_CONF)
    rows = spark.range(0, 9000, 1, 1).selectExpr("id", "repeat('x', 2000) AS text")
    made = shared.written(rows.mapInArrow(sizes, "bytes long"), "sizes").collect()
    assert sum(r.bytes for r in made) > 18_000_000 and max(r.bytes for r in made) < 2 * shared.BATCH_BYTES
    assert spark.conf.get(shared.BATCH_CONF) == before


def test_shared_folder_is_needed_off_one_machine(spark, monkeypatch):
    class Away:
        conf = type("C", (), {"get": lambda self, k, d=None: None, "set": lambda self, k, v: None})()
        sparkContext = type("S", (), {"master": "spark://host:7077", "_jsc": spark.sparkContext._jsc})()

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError, match="share"):
            shared.shared_dir(Away())


def test_package_can_be_shipped(spark):
    import zipfile

    names = zipfile.ZipFile(ship(spark)).namelist()
    assert "semspark/operators/semantic.py" in names
