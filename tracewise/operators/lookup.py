"""Lookup of names, and the last-step filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def string_lookup(df: DataFrame, string_ids: DataFrame, id_column: str, name: str) -> DataFrame:
    """``df`` with the text of ``id_column``; NULL for an id without one.

    Names may be of any size: Spark broadcasts them below its threshold in bytes.
    """
    names = string_ids.select("run_id", F.col("id").alias(id_column), F.col("value").alias(name))
    return df.join(names, ["run_id", id_column], "left")


def left_out_runs(df: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Runs without a row in the last step of all runs: ``run_id`` and their own last step."""
    steps = df if steps is None else steps
    last = steps.agg(F.max("step_id")).scalar()
    return (
        steps.groupBy("run_id").agg(F.max("step_id").alias("last_step"))
        .filter(F.col("last_step").isNull() | (F.col("last_step") < last))
    )


def last_step(df: DataFrame, steps: DataFrame | None = None, per_run: bool = False) -> DataFrame:
    """Rows of the last step.

    The last step is the largest one of all runs together, so runs with fewer
    steps drop out; ``per_run`` takes each run's own. ``steps`` is a cheaper
    frame with the same steps to read the maximum from.
    """
    steps = df if steps is None else steps
    if per_run:
        last = steps.groupBy("run_id").agg(F.max("step_id").alias("step_id"))
        return df.join(last, ["run_id", "step_id"], "left_semi")
    return df.filter(F.col("step_id") == steps.agg(F.max("step_id")).scalar())
