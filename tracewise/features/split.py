"""Split of samples by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.operators.running_total import running_total
from tracewise.session import Staging


def temporal_split(df: DataFrame, time: str, key: str, staging: Staging) -> DataFrame:
    """``df`` with ``stage``: ``train`` for all days before the last one, ``val``
    for the first half of the last day's rows, ``test`` for the second and
    ``undated`` for rows without a time.

    ``key`` identifies a row and orders rows of the same time. With an odd
    number of rows the middle one is in ``test``.
    """
    at = F.col(time)
    if df.schema[time].dataType.typeName() not in ("date", "timestamp", "timestamp_ntz"):
        raise ValueError(f"{time} is no date or timestamp")
    # The start of the last day, compared with the column itself so that files can be skipped.
    last_day = (
        df.agg(F.max(time).alias("last"))
        .select(F.to_date("last").cast(df.schema[time].dataType))
        .scalar()
    )
    earlier = F.when(at.isNull(), F.lit("undated")).otherwise(F.lit("train"))
    train = df.filter(at.isNull() | (at < last_day)).withColumn("stage", earlier)
    final = df.filter(at >= last_day)
    rows = final.agg(F.count(F.lit(1))).scalar()
    numbered = running_total(final, [time, key], F.lit(1).cast("bigint"), "_row", staging)
    halves = numbered.withColumn(
        "stage", F.when(F.col("_row") * 2 <= rows, F.lit("val")).otherwise(F.lit("test"))
    ).drop("_row")
    return train.unionByName(halves)
