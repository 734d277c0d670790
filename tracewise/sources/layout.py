"""Trace tables laid out for the joins between them: one bucket has all rows of a process.

Spans, host calls, kernels and copies of a worker share its run and process, which
are part of every join key. Tables are saved once in buckets of the two, so the
joins of every later analysis need no shuffle, and what they give stays in place for
the next one. A bucket cannot be split, so a layout with a process of many times
the rows of a usual bucket is saved without buckets: its joins are shuffled, where
adaptive execution splits what is hot.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.functions.scalars import process_of
from tracewise.schemas import SCHEMAS, TraceTables
from tracewise.session import path_exists

BUCKET_KEYS = ["run_id", "pid"]
# Joins have more keys than the buckets; Spark asks for all of them unless told otherwise.
BUCKET_SETTING = "spark.sql.requireAllClusterKeysForCoPartition"
PLACED = ["spans", "runtime", "kernels", "copies"]
# Rows of all four tables in a bucket, and how many times as many one process may have.
ROWS_PER_BUCKET = 2 << 20
HOT_PROCESS = 4

_DESCRIPTION = "layout.json"


def bucketed_table(spark: SparkSession, path: str, ddl: str, buckets: int) -> DataFrame:
    """Files in buckets as a table of the session's catalog, which only knows where they are."""
    name = f"tracewise_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{c}`" for c in BUCKET_KEYS)
    location = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({columns}) INTO {buckets} BUCKETS"
        f" LOCATION '{location}'"
    )
    return spark.table(name)


def write_bucketed(df: DataFrame, path: str, buckets: int) -> tuple[DataFrame, str]:
    """``df`` saved in buckets and read back, and its name in the catalog; a task should hold few of them."""
    spark = df.sparkSession
    name = f"tracewise_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *BUCKET_KEYS).option("path", path).saveAsTable(name)
    return spark.table(name), name


def _placed(tables: TraceTables) -> dict[str, DataFrame]:
    return {
        t: getattr(tables, t).select(*SCHEMAS[t].names, process_of(getattr(tables, t)).alias("pid")) for t in PLACED
    }


def choose_buckets(tables: TraceTables, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """How many buckets these tables need, or 0 if a process is too large for one."""
    spark = tables.spans.sparkSession
    each = [df.groupBy(*BUCKET_KEYS).agg(F.count("*").alias("rows")) for df in _placed(tables).values()]
    processes = reduce(DataFrame.unionByName, each).groupBy(*BUCKET_KEYS).agg(F.sum("rows").alias("rows"))
    found = processes.agg(F.sum("rows").alias("all"), F.max("rows").alias("most")).first()
    rows, most = found["all"] or 0, found["most"] or 0
    # more than there are cores, as processes are not spread evenly over few buckets
    buckets = max(4 * spark.sparkContext.defaultParallelism, math.ceil(rows / rows_per_bucket))
    return buckets if most * buckets <= HOT_PROCESS * rows or rows <= rows_per_bucket else 0


def write_layout(tables: TraceTables, root: str, buckets: int | None = None) -> None:
    """Save the tables under ``root``; ``buckets`` as ``choose_buckets`` gives it if that is None."""
    spark = tables.spans.sparkSession
    if path_exists(spark, root):
        raise ValueError(f"{root} exists")
    buckets = choose_buckets(tables) if buckets is None else buckets
    saved = {"buckets": buckets, "tables": {}}
    frames = _placed(tables) | {"string_ids": tables.string_ids}
    if tables.power is not None:
        frames["power"] = tables.power
    for name, df in frames.items():
        path = f"{root}/{name}"
        if buckets and name in PLACED:
            # one file for each bucket
            _, known_as = write_bucketed(df.repartition(buckets, *BUCKET_KEYS), path, buckets)
            spark.sql(f"DROP TABLE {known_as}")  # the files stay
        else:
            df.hint("rebalance").write.parquet(path)
        saved["tables"][name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    # written last: a layout without its description is no layout
    spark.createDataFrame([(json.dumps(saved),)], "value string").coalesce(1).write.text(f"{root}/{_DESCRIPTION}")


def is_layout(spark: SparkSession, root: str) -> bool:
    return path_exists(spark, f"{root}/{_DESCRIPTION}/_SUCCESS")


def read_layout(spark: SparkSession, root: str) -> TraceTables:
    """Tables from ``write_layout``. Sets ``BUCKET_SETTING`` in the session if they are in buckets."""
    saved = json.loads(spark.read.text(f"{root}/{_DESCRIPTION}").first()["value"])
    buckets = saved["buckets"]
    if buckets:
        spark.conf.set(BUCKET_SETTING, "false")
    found = {}
    for name, ddl in saved["tables"].items():
        path = f"{root}/{name}"
        if buckets and name in PLACED:
            found[name] = bucketed_table(spark, path, ddl, buckets)
        else:
            found[name] = spark.read.schema(ddl).parquet(path)
    return TraceTables(**found, buckets=buckets)
