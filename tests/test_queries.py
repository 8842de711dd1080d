"""Every query of the engine gives the rows of its own SQL, on the smallest tables."""

import datetime
import decimal
import glob
import os

import pytest

from semspark.plans.queries import ORACLE_SQL, QUERIES

TABLES = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables are not there")
def test_queries_give_the_rows_of_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file).removesuffix('.parquet')} AS SELECT * FROM '{file}'")
    unlike = []
    for name, query in QUERIES.items():
        df = query(spark, TABLES)
        got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
        found = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
        if sorted(names) != sorted(df.columns) or got != want:
            unlike.append(name)
    assert unlike == []


def test_jdbc_tables_are_read_in_parts(spark):
    """On a database inside this JVM, which is all that a test can have."""
    from semspark.sources import readers

    df = spark.createDataFrame([(k, f"name {k}", k / 2) for k in range(50)], "id long, name string, x double")
    url, driver = "jdbc:derby:memory:semspark;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    readers.write_jdbc(df, url, "things", driver=driver)
    readers.write_jdbc(df.where("id < 40"), url, "things", driver=driver)
    got = readers.read_jdbc(spark, url, "things", partition=("id", 0, 40, 4), driver=driver)
    assert got.rdd.getNumPartitions() == 4
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == [(k, f"name {k}", k / 2) for k in range(40)]
