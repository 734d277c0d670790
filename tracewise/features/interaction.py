"""Pairwise interaction of the vectors of a sample."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def pairwise_dot(vectors: Column) -> Column:
    """Dot products of all pairs of the vectors in an array, in the order (1,0),
    (2,0), (2,1), (3,0) and so on; ``[]`` for fewer than two vectors.
    """

    def with_earlier(i: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), i - 1), lambda j: dot(F.get(vectors, i), F.get(vectors, j))
        )

    rows = F.transform(F.sequence(F.lit(1), F.size(vectors) - 1), with_earlier)
    # ``sequence`` would count down from 1 for fewer than two vectors.
    return F.when(F.size(vectors) < 2, F.array().cast("array<double>")).otherwise(F.flatten(rows))
