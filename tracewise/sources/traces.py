"""Trace tables from Parquet, or from the profiler's SQLite files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewise.schemas import SCHEMAS, SQLITE_TABLES, TraceTables
from tracewise.session import path_exists
from tracewise.sources.layout import is_layout, read_layout
from tracewise.sources.power import read_power
from tracewise.sources.sqlite import SqliteTraceSource


def read_parquet_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table of all runs, from ``<root>/<table>/run_id=<run>/``."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{root}/{table}")


def read_sqlite_table(
    spark: SparkSession, root: str, table: str, rows_per_partition: int | None = None
) -> DataFrame:
    """One table of all runs, from ``<root>/**/<run>.sqlite``."""
    spark.dataSource.register(SqliteTraceSource)
    reader = spark.read.format("sqlite_trace").option("path", root).option("table", table)
    if rows_per_partition:
        reader = reader.option("rowsPerPartition", rows_per_partition)
    return reader.load()


def is_parquet_trace(spark: SparkSession, root: str) -> bool:
    return path_exists(spark, f"{root}/spans")


def read_trace(spark: SparkSession, root: str) -> TraceTables:
    """All tables under ``root``: laid out for joins, as plain Parquet, or the profiler's files."""
    if is_layout(spark, root):
        return read_layout(spark, root)
    if is_parquet_trace(spark, root):
        tables = {t: read_parquet_table(spark, root, t) for t in SCHEMAS}
        return TraceTables(**tables)
    tables = {t: read_sqlite_table(spark, root, t) for t in SQLITE_TABLES}
    return TraceTables(**tables, power=read_power(spark, root))


def write_trace(tables: TraceTables, root: str, mode: str = "errorifexists") -> None:
    """Save the tables in the Parquet layout, for repeated analysis at scale."""
    for name in SCHEMAS:
        df = getattr(tables, name)
        if df is not None:
            df.hint("rebalance", "run_id").write.mode(mode).partitionBy("run_id").parquet(f"{root}/{name}")
