"""Best-fit packing by a configuration linear program.

A configuration is a multiset of lengths that fits into one sequence. The linear
program asks for the fewest sequences whose configurations cover the histogram of
lengths. It is solved by multiplicative weights: lengths that lag behind gain
weight, a knapsack dynamic program prices the best configuration for every
length, and all that come close to the best are used for a small share of the
demand. Rounding takes whole sequences of the configurations, and best fit
places the few pieces that are left. All of it works on counts, so the plan does
not grow with the number of pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.common import staged
from tracewise.llm.text import word_tokens

CAPACITY = 4096
END = 1


def knapsack(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every capacity the largest value of lengths that fit, and the length to take first (0: none).

    ``value[l]`` is the value of length l, minus infinity for lengths that there are not.
    """
    capacity = len(value) - 1
    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gains = value[1 : c + 1] + best[c - 1 :: -1] if c > 1 else value[1:2] + best[:1]
        k = int(gains.argmax())
        if gains[k] > best[c - 1]:
            best[c], first[c] = gains[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, first


def _filled(first: np.ndarray, capacity: int) -> list[int]:
    """The lengths that the dynamic program takes for a capacity."""
    out = []
    while capacity > 0:
        length = int(first[capacity])
        if length:
            out.append(length)
            capacity -= length
        else:
            capacity -= 1
    return out


def solve(
    counts: dict[int, int], capacity: int, rounds: int = 80, eta: float = 4.0, near: float = 0.003
) -> dict[tuple[int, ...], float]:
    """Amounts of configurations (lengths, largest first) that cover each length about once over.

    Weights start at the dual solution that prices a token the same everywhere.
    """
    lengths = np.array(sorted(counts), np.int64)
    demand = np.array([counts[n] for n in lengths.tolist()], float)
    place = np.full(capacity + 1, -1)
    place[lengths] = np.arange(len(lengths))
    covered = np.zeros(len(lengths))
    amounts: dict[tuple[int, ...], float] = defaultdict(float)
    for r in range(1, rounds + 1):
        value = np.full(capacity + 1, -np.inf)
        value[lengths] = lengths / capacity * np.exp(-eta * (covered - (r - 1) / rounds))
        best, first = knapsack(value)
        reach = value[lengths] + best[capacity - lengths]
        order = np.argsort(-reach, kind="stable")
        used = 0
        for i in order.tolist():
            if reach[i] < (1 - near) * best[capacity] and used:
                break
            if covered[i] >= r / rounds:
                continue
            length = int(lengths[i])
            config = Counter([length, *_filled(first, capacity - length)])
            share = min(1 / rounds, r / rounds - covered[i])
            amount = share * demand[i] / config[length]
            for other, n in config.items():
                covered[place[other]] += amount * n / demand[place[other]]
            amounts[tuple(sorted(config.elements(), reverse=True))] += amount
            used += 1
    return amounts


def round_down(amounts: dict[tuple[int, ...], float], counts: dict[int, int]) -> tuple[list, dict[int, int]]:
    """Whole sequences of each configuration that the counts allow, and the counts that are left.

    Full configurations go first: what they leave is what best fit has to place.
    """
    left, out = dict(counts), []
    for pass_ in ("floor", "one more"):
        for config, amount in sorted(amounts.items(), key=lambda x: (-sum(x[0]), -x[1], x[0])):
            need = Counter(config)
            able = min(left[n] // k for n, k in need.items())
            times = min(able, int(amount)) if pass_ == "floor" else min(able, max(1, int(amount)))
            if times:
                out.append((config, times))
                for n, k in need.items():
                    left[n] -= k * times
    return out, {n: k for n, k in left.items() if k}


def best_fit(bins: list[tuple[tuple[int, ...], int]], counts: dict[int, int], capacity: int) -> list:
    """Places lengths, largest first, into the fullest sequences that take them, in whole groups.

    A group of equal sequences is split when only some of them get a piece, so
    the work grows with the groups and not with the pieces.
    """
    by_gap: dict[int, list] = defaultdict(list)
    for config, times in bins:
        by_gap[capacity - sum(config)].append((config, times))
    gaps = sorted(g for g in by_gap)

    def put(gap: int, group: tuple) -> None:
        if not by_gap[gap]:
            at = bisect_left(gaps, gap)
            if at == len(gaps) or gaps[at] != gap:
                insort(gaps, gap)
        by_gap[gap].append(group)

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(gaps, length)
            while at < len(gaps) and not by_gap[gaps[at]]:
                gaps.pop(at)
            if at == len(gaps):
                per = min(capacity // length, n)
                full, rest = divmod(n, per)
                put(capacity - per * length, ((length,) * per, full))
                if rest:
                    put(capacity - rest * length, ((length,) * rest, 1))
                break
            gap = gaps[at]
            config, times = by_gap[gap].pop()
            per = min(gap // length, n)
            full = min(n // per, times)
            if times > full:
                by_gap[gap].append((config, times - full))
            put(gap - per * length, (config + (length,) * per, full))
            n -= per * full
    return [group for gap in sorted(by_gap) for group in by_gap[gap]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how many sequences have them; every piece has its place in one."""
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    bins, left = round_down(solve(counts, capacity), counts)
    return best_fit(bins, left, capacity)


def _slots(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset) of runs of sequences with a place for it."""
    runs, ranks, sequence = defaultdict(list), Counter(), 0
    for config, times in bins:
        offset = 0
        for length in config:
            runs[length].append((ranks[length], sequence, offset))
            ranks[length] += times
            offset += length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in runs.items()}


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """All columns, with ``sequence_id`` and ``offset``; lengths must be from 1 to ``capacity``.

    Items of equal length are interchangeable: they are numbered in the order of
    the staged table and take the places of the plan by number. An empty table
    gives an empty result. Columns of the input with the names of results give way.
    """
    kept = [c for c in items.columns if c.lower() not in ("sequence_id", "offset", "_part", "_local")]
    items = items.select(*kept)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            values = batch.column(kept.index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(values) and not (1 <= values.min() and values.max() <= capacity):
                raise ValueError(f"lengths must be from 1 to {capacity}")
            local = seen[values] + pd.Series(values).groupby(values).cumcount().to_numpy()
            np.add.at(seen, values, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], [*kept, "_local"])

    numbered = items.mapInArrow(number, T.StructType([*items.schema.fields, T.StructField("_local", T.LongType())]))
    numbered = staged(numbered.withColumn("_part", F.spark_partition_id()), "pack-items")
    sizes = numbered.groupBy("_part", length).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(length).orderBy("_part")) - F.col("_n")
    sizes = staged(sizes.select("_part", length, "_n", before.alias("_before")), "pack-sizes")
    # at most one row for each length there can be
    histogram = {r[0]: r[1] for r in sizes.groupBy(length).agg(F.sum("_n")).collect()}
    slots = _slots(plan(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*kept, "sequence_id", "offset"]
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False)
            ranks = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
            for n in np.unique(values).tolist():
                mine, runs = values == n, slots[n]
                run = runs[np.searchsorted(runs[:, 0], ranks[mine], side="right") - 1]
                sequence[mine] = run[:, 1] + ranks[mine] - run[:, 0]
                offset[mine] = run[:, 2]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names)

    ranked = numbered.join(sizes.drop("_n"), ["_part", length]).select(
        *kept, (F.col("_before") + F.col("_local")).alias("_rank")
    )
    new = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ranked.mapInArrow(place, T.StructType([*items.schema.fields, *new]))


def pieces(
    documents: DataFrame, file: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """Token pieces of documents: ``piece``, ``start``, ``length`` and ``ids_crc32`` for each id.

    A document is its ids and the end id; null and blank texts have the end only.
    Only documents longer than ``capacity`` are cut. ``file`` names a byte-level tokenizer
    that lowers case, drops white space and never looks across it; others are refused.
    """
    fields = [documents.schema[id]] + [
        T.StructField(c, T.IntegerType() if c == "piece" else T.LongType())
        for c in ("piece", "start", "length", "ids_crc32")
    ]
    end = END.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(file)
        for batch in batches:
            rows = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids = encode.of(t.as_py() or b"") + end
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    rows.append((key, k, start, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], [f.name for f in fields]
            )

    return documents.select(id, text).mapInArrow(cut, T.StructType(fields))
