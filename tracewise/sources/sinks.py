"""Writing of results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracewise.plans.reports import with_headers
from tracewise.session import delete_path, full_path, path_exists, rename_path


def check_output(spark: SparkSession, input: str, output: str, override: bool = False) -> None:
    """Refuse an output that exists, unless ``override`` is set, or that overlaps the input."""
    a, b = (f"{full_path(spark, p)}/" for p in (input, output))
    if a.startswith(b) or b.startswith(a):
        raise ValueError(f"output {output} and input {input} overlap")
    if path_exists(spark, output) and not override:
        raise ValueError(f"output {output} exists, set override to replace it")


def replace_output(spark: SparkSession, new: str, output: str) -> None:
    """Put a complete folder in the place of another one, or of none."""
    old = f"{output.rstrip('/')}.old-{uuid.uuid4().hex[:8]}"
    if path_exists(spark, output):
        rename_path(spark, output, old)
    rename_path(spark, new, output)
    delete_path(spark, old)


def write_report(name: str, report: DataFrame, output: str) -> None:
    """A report as CSV with its display headers. A small one becomes one file."""
    with_headers(name, report).write.csv(f"{output}/{name}.csv", header=True)


def write_table(df: DataFrame, path: str, csv: bool = False) -> DataFrame:
    """A full table as Parquet by run, and as CSV if asked for; read back from there."""
    # Rows of a run come together, in files of a good size, however many tasks had them.
    df.hint("rebalance", "run_id").write.partitionBy("run_id").parquet(path)
    schema = df.schema
    saved = df.sparkSession.read.schema(schema).parquet(path)
    if csv:
        saved.write.csv(f"{path}.csv", header=True)
    return saved
