"""Running totals over a whole table in a global order.

A window without a partition would bring all rows into one task. Here rows are
range-partitioned, each partition is summed, and the sums of the partitions
before it are added to the total inside it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.session import Staging


def running_total(
    df: DataFrame,
    order_by: Sequence[str],
    amount: Column,
    name: str,
    staging: Staging,
    per: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` up to and including each row.

    ``order_by`` must identify a row, so that equal values cannot pile up in one
    range. With ``per``, a total starts again for each group; a group may be of
    any size, as ranges cut through it.
    """
    order = [*per, *order_by]
    ranged = (
        df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    )
    # Written out with its partition number: a recomputed task may not see the
    # same ranges, and both passes below must.
    ranged = staging.table(
        f"ranged_{name}",
        ranged.withColumn("_part", F.spark_partition_id()).withColumn("_amount", amount),
    )
    # One row per partition and group that it touches.
    sums = ranged.groupBy("_part", *per).agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*per).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "_part", *per, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_part", *per).orderBy(*order_by)
    running = ranged.withColumn(
        name, F.sum("_amount").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    keys = ["_part", *per]
    renamed = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return (
        running.join(renamed, same)
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_part", "_amount", "_before", *[f"_{k}" for k in keys])
    )
