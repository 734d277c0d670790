"""Interval-containment join.

An interval is inside another when it starts strictly after it and ends
strictly before it. As a plain join this compares every row with every interval
of the same key. Here each outer interval is filed under time buckets of a width
that fits its duration. The widths, powers of two, follow the durations that the
outer side has: the longest gets one that it fits into, which also serves those
down to 1/64 of it, the longest of the rest gets the next, and so on. Then

* an outer row becomes one or two rows, whatever its duration,
* an inner row becomes one row per width, usually one or two, and
* it meets only outer intervals near it that are not much shorter than the
  bucket, even when short and long ones are mixed.

The join is an equi-join, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Durations that share a width differ by at most two to this power.
_SPREAD = 7


def _exponent(duration: Column) -> Column:
    """Position of the highest bit of a duration; grows with it."""
    bits = F.floor(F.log2(F.greatest(duration, F.lit(1))))
    return F.least(bits, F.lit(62)).cast("int")


def _widths(exponents: Column) -> Column:
    """Bits of the bucket widths for a set of exponents, widest first."""
    return F.aggregate(
        F.reverse(F.array_sort(exponents)),
        F.array().cast("array<int>"),
        lambda widths, e: F.when(
            (F.size(widths) == 0) | (e < F.element_at(widths, -1) - _SPREAD),
            F.array_append(widths, e + 1),
        ).otherwise(widths),
    )


def _bucket(time: str, width: str = "_width") -> Column:
    return F.expr(f"shiftright(`{time}`, {width})")


def _widths_of(exponents: DataFrame) -> Column:
    """Bucket widths for the ``_exponent`` of these rows: at most nine values, read by one
    small aggregation before the join."""
    return (
        exponents.agg(F.collect_set("_exponent").alias("exponents"))
        .select(_widths(F.col("exponents")))
        .scalar()
    )


def _filed(outer: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> tuple[DataFrame, Column]:
    """Outer rows under their one or two buckets, and the widths of these."""
    proper = outer.filter(F.col("end") > F.col("start")).select(
        *[F.col(k).alias(f"_outer_{k}") for k in keys],
        *carry,
        F.col("start").alias("_outer_start"),
        F.col("end").alias("_outer_end"),
        _exponent(F.col("end") - F.col("start")).alias("_exponent"),
    )
    widths = _widths_of(proper)
    filed = (
        proper.withColumn("_width", F.explode(widths))
        .filter(F.col("_exponent").between(F.col("_width") - _SPREAD, F.col("_width") - 1))
        .withColumn(
            "_bucket", F.explode(F.sequence(_bucket("_outer_start"), _bucket("_outer_end")))
        )
        .drop("_exponent")
    )
    return filed, widths


def contained_in(
    inner: DataFrame,
    outer: DataFrame,
    keys: Sequence[str],
    carry: Sequence[str],
    bounded: bool = False,
    large: bool = False,
) -> DataFrame:
    """Rows of ``inner`` with the ``carry`` columns of each outer row around them.

    Both sides have ``start`` and ``end``. Nested and overlapping outer rows all
    match. Intervals with a NULL end or ``end < start`` neither contain nor are
    contained. With ``bounded``, partitions of ``outer`` are known to fit in memory
    and are hashed instead of sorted. With ``large``, both sides are sorted, whatever
    size Spark guesses: it does not know how many rows a plan makes of one.
    """
    filed, widths = _filed(outer, keys, carry)
    # What surrounds an interval is longer, so narrower buckets cannot hold it.
    probes = (
        inner.filter(F.col("end") >= F.col("start"))
        .withColumn("_width", F.explode(widths))
        .filter(F.col("_width") > _exponent(F.col("end") - F.col("start")))
        .withColumnRenamed("_width", "_inner_width")
    )
    if bounded:
        filed = filed.hint("shuffle_hash")
    elif large:
        filed = filed.hint("merge")
    # An inner row has one bucket per width, so a pair meets only once. Its bucket follows
    # from its start and is not shuffled.
    same = [F.col(k) == F.col(f"_outer_{k}") for k in keys]
    same += [F.col("_inner_width") == F.col("_width"), _bucket("start", "_inner_width") == F.col("_bucket")]
    found = probes.join(filed, reduce(and_, same)).filter(
        (F.col("start") > F.col("_outer_start")) & (F.col("end") < F.col("_outer_end"))
    )
    # The keys first, as a join by names has them.
    return found.select(*keys, *[c for c in inner.columns if c not in keys], *carry)


# What tells where ``contained_chain`` has placed a row, besides the keys.
PLACE = ["_width", "_bucket"]


def contained_chain(
    inner: DataFrame,
    middle: DataFrame,
    outer: DataFrame,
    sizes: DataFrame,
    keys: Sequence[str],
    same: Sequence[str],
    carry: Sequence[str],
    tasks: int | None = None,
) -> DataFrame:
    """Rows of ``middle`` inside ``outer``, and those of ``inner`` inside these, each shuffled once.

    Every middle row comes with the ``carry`` columns of each outer row around it, once
    by itself, the columns of ``inner`` being NULL, and once with each inner row inside
    it. ``middle`` and ``outer`` have ``start`` and ``end``, ``inner`` has ``inner_start``
    and ``inner_end`` and no other name that they have but ``keys`` and ``same``, on which
    inner and middle rows agree too. ``sizes`` has the ``start`` and ``end`` of all middle
    rows, and may have more.

    What is inside a middle row is inside the outer one, so all three are placed by the
    buckets of the outer rows. A middle row that reaches over the end of its bucket is in
    the next one too, for the inner rows that start there. Inside a bucket of outer rows
    the inner rows meet the middle ones by buckets of the widths that these have, so
    outer rows may be many times as long. The result stays placed by ``keys`` and
    ``PLACE``; rows that have these in common are in one task. That is so with
    ``spark.sql.requireAllClusterKeysForCoPartition`` set to false; else inner and middle
    rows are shuffled once more. ``tasks`` is their number, if not that of the session.
    """
    number = [tasks] if tasks else []
    filed, widths = _filed(outer, keys, carry)
    # Of a time and what passed since less is to shuffle than of two times. The first key
    # of a join is the one that tells most rows apart, as it is sorted by that first.
    filed = filed.withColumn("_outer_length", F.col("_outer_end") - F.col("_outer_start")).drop("_outer_end")
    spread = (
        middle.filter(F.col("end") >= F.col("start"))
        .withColumn("_length", F.col("end") - F.col("start"))
        .withColumn("_middle_width", F.explode(widths))
        .filter(F.col("_middle_width") > _exponent(F.col("_length")))
        .withColumn("_next", F.explode(F.array(*[F.lit(n).cast("tinyint") for n in (0, 1)])))
        .filter(_bucket("start", "_middle_width") + F.col("_next") <= _bucket("end", "_middle_width"))
    )
    # Columns that vary together stand together, which shuffles less.
    others = [c for c in middle.columns if c not in ("start", "end", *keys)]
    at = _bucket("start", "_middle_width") + F.col("_next")
    spread = spread.select("start", "_length", *keys, "_middle_width", "_next", *others)
    spread = spread.repartition(*number, at, *keys, "_middle_width")
    filed = filed.repartition(*number, "_bucket", *[f"_outer_{k}" for k in keys], "_width")
    equal = [at == F.col("_bucket"), *[F.col(k) == F.col(f"_outer_{k}") for k in keys]]
    equal += [F.col("_middle_width") == F.col("_width")]
    around = (
        spread.join(filed.hint("merge"), reduce(and_, equal))
        .withColumn("end", F.col("start") + F.col("_length"))
        .filter(
            (F.col("start") > F.col("_outer_start"))
            & (F.col("end") < F.col("_outer_start") + F.col("_outer_length"))
        )
    )

    # One row for itself, where it starts, and those under which inner rows look for it.
    size = _exponent(F.col("end") - F.col("start"))
    narrow = _widths_of(sizes.filter(F.col("end") > F.col("start")).select(size.alias("_exponent")))
    fits = F.get(F.filter("_widths", lambda w: size.between(w - _SPREAD, w - 1)), F.lit(0))
    alone = F.struct(F.lit(None).cast("int").alias("width"), F.lit(None).cast("bigint").alias("bucket"))
    slots = F.transform(
        F.sequence(_bucket("start", "_fits"), _bucket("end", "_fits")),
        lambda bucket: F.struct(F.col("_fits").alias("width"), bucket.alias("bucket")),
    )
    none = F.array().cast("array<struct<width:int,bucket:bigint>>")
    around = around.withColumn("_widths", narrow).withColumn("_fits", fits).withColumn(
        "_slot",
        F.explode(
            F.concat(
                F.when(F.col("_next") == 0, F.array(alone)).otherwise(none),
                F.when(F.col("end") > F.col("start"), slots).otherwise(none),
            )
        ),
    )

    named = inner.withColumnsRenamed({k: f"_inner_{k}" for k in (*keys, *same)})
    length = _exponent(F.col("_inner_length"))
    home = _bucket("inner_start", "_inner_width")
    placed = (
        named.filter(F.col("inner_end") >= F.col("inner_start"))
        .withColumn("_inner_length", F.col("inner_end") - F.col("inner_start"))
        .select("_inner_length", *[c for c in named.columns if c != "inner_end"])
        .withColumn("_inner_width", F.explode(widths))
        .filter(F.col("_inner_width") > length)
        .repartition(*number, home, *[f"_inner_{k}" for k in keys], "_inner_width")
    )
    probes = placed.withColumn("_narrow", F.explode(narrow)).filter(F.col("_narrow") > length)
    equal = [
        F.col("_slot.bucket") == _bucket("inner_start", "_narrow"),
        F.col("_bucket") == home,
        *[F.col(f"_outer_{k}") == F.col(f"_inner_{k}") for k in keys],
        F.col("_width") == F.col("_inner_width"),
        *[F.col(k) == F.col(f"_inner_{k}") for k in same],
        F.col("_slot.width") == F.col("_narrow"),
    ]
    inner_end = F.col("inner_start") + F.col("_inner_length")
    inside = (F.col("inner_start") > F.col("start")) & (inner_end < F.col("end"))
    found = (
        around.join(probes.hint("merge"), reduce(and_, [*equal, inside]), "left")
        .filter(F.col("_slot.width").isNull() | F.col("inner_start").isNotNull())
        .withColumn("inner_end", inner_end)
    )
    return found.select(
        *[F.col(f"_outer_{k}").alias(k) for k in keys],
        *[c for c in middle.columns if c not in keys],
        *carry,
        *[c for c in inner.columns if c not in (*keys, *same)],
        *PLACE,
    )
