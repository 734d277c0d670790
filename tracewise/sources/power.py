"""Power samples: one text file per run, one column per GPU, no timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POWER_SUFFIX = "_power_draw.csv"


#: Counts of ``power_quality`` that stand for lost values.
POWER_FAULTS = ["samples_without_header", "cells_without_gpu", "unreadable_cells"]


def _samples(spark: SparkSession, root: str) -> DataFrame:
    """``run_id``, ``sample_idx``, ``gpus`` and ``cells`` of every sample; ``gpus`` may be NULL.

    Files are read by lines and may be split: what a split needs from the
    earlier ones, the last header and the number of samples, is computed per
    split and passed on.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{POWER_SUFFIX}")
        .text(root)
        .filter(F.trim("value") != "")
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            F.trim("value").alias("value"),
        )
        .withColumn("is_header", F.col("value").startswith("GPU-"))
    )
    # One row per split. The windows below hold a split at most.
    splits = lines.groupBy("file", "block").agg(
        F.max_by(
            F.when(F.col("is_header"), F.col("value")),
            F.when(F.col("is_header"), F.col("line")),
        ).alias("last_header"),
        F.count_if(~F.col("is_header")).alias("samples"),
    )
    earlier = (
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    splits = splits.select(
        "file",
        "block",
        F.last("last_header", ignorenulls=True).over(earlier).alias("header_before"),
        F.coalesce(F.sum("samples").over(earlier), F.lit(0)).alias("samples_before"),
    )
    upto = (
        Window.partitionBy("file", "block")
        .orderBy("line")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    header = F.last(F.when(F.col("is_header"), F.col("value")), ignorenulls=True).over(upto)
    return (
        lines.withColumn("header", header)
        .withColumn("sample", F.count_if(~F.col("is_header")).over(upto))
        .filter(~F.col("is_header"))
        .join(splits, ["file", "block"])
        .select(
            F.regexp_extract("file", rf"([^/]+){POWER_SUFFIX}$", 1).alias("run_id"),
            (F.col("samples_before") + F.col("sample") - 1).alias("sample_idx"),
            F.split(F.coalesce("header", "header_before"), ",").alias("gpus"),
            F.split("value", ",").alias("cells"),
        )
    )


def read_power(spark: SparkSession, root: str) -> DataFrame:
    """Samples of all runs as rows: run, sample number, GPU, watts.

    A line starting with ``GPU-`` names the columns of the lines after it; a
    file may have several, as the sampler appends. An empty or unreadable cell
    is NULL. ``power_quality`` counts those, samples before the first header
    and cells beyond it.
    """
    cell = F.get(F.col("cells"), F.col("position"))
    return _samples(spark, root).select(
        "run_id", "sample_idx", "cells", F.posexplode("gpus").alias("position", "gpu_uuid")
    ).select(
        "run_id",
        "sample_idx",
        F.trim("gpu_uuid").alias("gpu_uuid"),
        cell.try_cast("double").alias("watts"),
    )


def power_quality(spark: SparkSession, root: str) -> DataFrame:
    """Per run, the samples and those values of them that ``read_power`` cannot give."""
    gpus = F.coalesce(F.size("gpus"), F.lit(0))
    named = F.slice("cells", 1, F.greatest(gpus, F.lit(0)))
    bad = F.filter(named, lambda c: (F.trim(c) != "") & c.try_cast("double").isNull())
    has_header = F.col("gpus").isNotNull()
    return _samples(spark, root).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(~has_header).alias("samples_without_header"),
        F.sum(F.when(has_header, F.greatest(F.size("cells") - gpus, F.lit(0))).otherwise(0))
        .alias("cells_without_gpu"),
        F.sum(F.when(has_header, F.size(bad)).otherwise(0)).alias("unreadable_cells"),
    )
