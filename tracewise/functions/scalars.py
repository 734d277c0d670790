"""Identifiers, names, ratios and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.schemas import EVENT_TYPES, NANOSECOND

_ID_RANGE = 0x1000000


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def process_id(column: str) -> Column:
    """Process number packed in a global id. Integer division truncates to zero."""
    return F.expr(f"`{column}` div {_ID_RANGE} % {_ID_RANGE}")


def process_of(df: DataFrame) -> Column:
    """Process number of the rows of a trace table: its own column if it has been laid out by it."""
    if "pid" in df.columns:
        return F.col("pid")
    return process_id("globalTid" if "globalTid" in df.columns else "globalPid")


def thread_id(column: str) -> Column:
    return F.col(column) % F.lit(_ID_RANGE)


def duration(start: str = "start", end: str = "end") -> Column:
    return F.col(end) - F.col(start)


def event_type_name(code: Column) -> Column:
    """Name of a span type; NULL for an unknown code."""
    return _literal_map(EVENT_TYPES)[code]


def per_second(amount: Column, nanoseconds: Column) -> Column:
    """Amount per second; NULL where no time passed."""
    return F.try_divide(amount.cast("double"), nanoseconds * F.lit(NANOSECOND))


def percentage(part: Column, whole: Column) -> Column:
    """Share of ``whole`` in percent; NULL where ``whole`` is 0."""
    return F.try_divide(part, whole) * F.lit(100)


def axis_label(name: Column) -> Column:
    return F.initcap(F.translate(name, "_", " "))
