"""Which runs have a trace and which have power samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.sources.power import POWER_SUFFIX


def run_inventory(traces: DataFrame, power: DataFrame) -> DataFrame:
    """One row per ``run_id`` in either frame, with what was found for it."""
    has = lambda df, name: df.select("run_id").distinct().withColumn(name, F.lit(True))
    return (
        has(traces, "has_trace")
        .join(has(power, "has_power"), "run_id", "full_outer")
        .na.fill(False, ["has_trace", "has_power"])
        .withColumn("complete", F.col("has_trace") & F.col("has_power"))
    )


def _files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{suffix}")
        .load(root)
        .select("path", F.regexp_extract("path", rf"([^/]+)\Q{suffix}\E$", 1).alias("run_id"))
    )


def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    """Inventory of the ``<run>.sqlite`` and ``<run>_power_draw.csv`` files under ``root``."""
    return run_inventory(_files(spark, root, ".sqlite"), _files(spark, root, POWER_SUFFIX))


def require_complete(inventory: DataFrame) -> None:
    """Raise if there are no runs, or if one lacks its trace or its power samples."""
    counts = inventory.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("complete")).alias("incomplete")
    ).first()
    if not counts["runs"]:
        raise ValueError("no runs found")
    if counts["incomplete"]:
        examples = [r["run_id"] for r in inventory.filter(~F.col("complete")).take(10)]
        raise ValueError(
            f"{counts['incomplete']} runs lack a trace or power samples, such as {examples}"
        )
