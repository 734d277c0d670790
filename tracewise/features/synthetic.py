"""Reproducible random click features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Random numbers held at a time for one table, whatever the bags' size.
BLOCK = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    """A hash of each 64-bit state; different states have different hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniform(samples: np.ndarray, stream: int, count: int, seed: int) -> np.ndarray:
    """``count`` numbers in [0, 1) per sample. They depend on the arguments only.

    All 64 bits of a sample's id count, so samples do not repeat.
    """
    h = _mix(samples.astype(np.uint64) + np.uint64(seed % 2**64))
    h = _mix(h + np.uint64(stream * 1_000_003))
    h = _mix(h[:, None] + np.arange(count, dtype=np.uint64) * np.uint64(10_007))
    return (h >> np.uint64(11)) / float(1 << 53)


def smallest_distinct(values: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` smallest different values of each row, in order; an error if there are fewer."""
    ordered = np.sort(values, axis=1)
    new = np.ones(ordered.shape, dtype=bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    place = np.cumsum(new, axis=1)
    if len(place) and (not place.shape[1] or place[:, -1].min() < count):
        raise ValueError(f"a table has fewer than {count} distinct ids for a sample")
    return ordered[new & (place <= count)].reshape(len(values), count)


def synthetic_features(
    samples: DataFrame,
    dense_size: int,
    table_sizes: Sequence[int],
    ids_per_lookup: int,
    seed: int = 0,
) -> DataFrame:
    """``sample_id``, ``dense`` and ``bags``, one list of distinct ids per table.

    The ids of a bag are the smallest ``ids_per_lookup`` of ``ids_per_lookup`` x
    (number of tables) random ones, in order. Raises where those have fewer
    distinct values. A sample without an id has neither features nor bags.
    """
    sizes = list(table_sizes)
    candidates = ids_per_lookup * len(sizes)
    rows_at_once = max(1, BLOCK // max(1, candidates))

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def lists(values, length, rows, mask=None):
            offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * length)
            return pa.ListArray.from_arrays(offsets, values, mask=mask)

        for batch in batches:
            for first in range(0, batch.num_rows, rows_at_once):
                ids = batch.column(0).slice(first, rows_at_once)
                # A copy, as a mask must not have an offset.
                none = pa.array(ids.is_null().to_numpy(zero_copy_only=False))
                x = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                n = len(x)
                dense = lists(pa.array(uniform(x, 0, dense_size, seed).ravel()), dense_size, n, none)
                tables = [
                    smallest_distinct(
                        np.rint(uniform(x, t + 1, candidates, seed) * (size - 1)).astype(np.int64),
                        ids_per_lookup,
                    )
                    for t, size in enumerate(sizes)
                ]
                flat = np.stack(tables, axis=1).ravel() if tables else np.empty(0, np.int64)
                each = lists(pa.array(flat), ids_per_lookup, n * len(sizes))
                bags = lists(each, len(sizes), n, none)
                yield pa.RecordBatch.from_arrays([ids, dense, bags], names=["sample_id", "dense", "bags"])

    schema = T.StructType(
        [
            T.StructField("sample_id", T.LongType()),
            T.StructField("dense", T.ArrayType(T.DoubleType())),
            T.StructField("bags", T.ArrayType(T.ArrayType(T.LongType()))),
        ]
    )
    return samples.select(F.col("sample_id").cast("bigint")).mapInArrow(make, schema)
