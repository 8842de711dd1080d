"""Reading and writing of tables; Spark does the work, these give the usual defaults."""

from __future__ import annotations

import itertools
import os

from pyspark.sql import DataFrame, SparkSession

from ..runtime.shared import new_path

#: Rows that are taken from a local database at once.
FETCH_ROWS = 50_000


def read_csv(spark: SparkSession, path: str | list[str], schema=None, multiline: bool = False) -> DataFrame:
    """A CSV file, or all that a glob names. With a header; a byte order mark is dropped. Give a schema for large data."""
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A table of a database with a JDBC driver on the class path (PostgreSQL, SQLite, DuckDB ...).

    ``partition`` (column, lower, upper, parts) reads it in parallel.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, lower, upper, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.load()


def from_pandas(spark: SparkSession, pdf, npartitions: int | None = None) -> DataFrame:
    df = spark.createDataFrame(pdf)
    return df.repartition(npartitions) if npartitions else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_table(df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None) -> None:
    """``df`` as a catalog table, in the warehouse or at ``path``, which outlives the table's name."""
    writer = df.write.mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "overwrite", **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def _quoted(name: str) -> str:
    return ".".join('"' + part.replace('"', '""') + '"' for part in name.split("."))


def _local(path: str) -> str:
    if "://" in path.removeprefix("file://"):
        raise ValueError(f"local databases are read and written through a folder that the driver sees as a file path, not {path}")
    return path.removeprefix("file://").removeprefix("file:")


def local_file(spark: SparkSession, name: str) -> str:
    """A path for a new local database inside the shared folder."""
    folder = _local(new_path(spark, "database"))
    os.makedirs(folder)
    return os.path.join(folder, name)


def read_duckdb(spark: SparkSession, database: str, table: str) -> DataFrame:
    """A table of a DuckDB file. DuckDB writes it to the shared folder as Parquet, which Spark reads; nothing passes
    through the driver's memory as a whole."""
    import duckdb

    path = new_path(spark, "duckdb")
    os.makedirs(_local(path))
    with duckdb.connect(database, read_only=True) as con:
        con.execute(f"COPY (SELECT * FROM {_quoted(table)}) TO '{_local(path)}/part.parquet' (FORMAT parquet)")
    return spark.read.parquet(path)


def write_duckdb(df: DataFrame, database: str, table: str, overwrite: bool = True) -> None:
    """``df`` as a table of a DuckDB file. Without ``overwrite`` an existing table is an error."""
    import duckdb

    path = new_path(df.sparkSession, "duckdb")
    df.write.parquet(path)
    with duckdb.connect(database) as con:
        con.execute(f"CREATE {'OR REPLACE ' if overwrite else ''}TABLE {_quoted(table)} AS SELECT * FROM read_parquet('{_local(path)}/*.parquet')")


def read_sqlite(spark: SparkSession, database: str, table: str, schema: str) -> DataFrame:
    """A table of an SQLite file, whose columns have the names and Spark types of ``schema``. It is read in parts of
    bounded size, which go to the shared folder."""
    import sqlite3

    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(spark.createDataFrame([], schema).schema)
    path = new_path(spark, "sqlite")
    os.makedirs(_local(path))
    con = sqlite3.connect(f"file:{database}?mode=ro", uri=True)
    try:
        rows = con.execute(f"SELECT {', '.join(_quoted(n) for n in kinds.names)} FROM {_quoted(table)}")
        with pq.ParquetWriter(f"{_local(path)}/part.parquet", kinds) as out:
            while part := list(itertools.islice(rows, FETCH_ROWS)):
                out.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds.types, strict=True)], schema=kinds))
    finally:
        con.close()
    return spark.read.schema(schema).parquet(path)


def write_sqlite(df: DataFrame, database: str, table: str, overwrite: bool = True) -> None:
    """``df``, of plain column types, as a table of an SQLite file, in parts of bounded size."""
    import sqlite3

    names = ", ".join(_quoted(c) for c in df.columns)
    con = sqlite3.connect(database)
    try:
        if overwrite:
            con.execute(f"DROP TABLE IF EXISTS {_quoted(table)}")
        con.execute(f"CREATE TABLE {_quoted(table)} ({names})")
        rows = (tuple(r) for r in df.toLocalIterator())
        while part := list(itertools.islice(rows, FETCH_ROWS)):
            con.executemany(f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * len(df.columns))})", part)
        con.commit()
    finally:
        con.close()
