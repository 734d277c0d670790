"""What several operators share: staged tables, ranks, joins that survive hot keys."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewise.session import Staging

#: A key counts as hot from this share of all rows on, so there are at most as many hot keys.
HOT_KEYS = 1000

#: Edges that a task connects at a time.
BLOCK_EDGES = 1 << 18

#: White space of the word definition, as a character class.
SPACE = r"[\x20\x09-\x0D]"


@lru_cache(maxsize=4)
def _staging(spark: SparkSession) -> Staging:
    return Staging(spark)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut in the lineage that outlives executors."""
    return _staging(df.sparkSession).table(name, df)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder in the shared one that nothing has used."""
    import uuid

    return f"{_staging(spark).root}/{name}-{uuid.uuid4().hex}"


def positional(df: DataFrame, *names: str) -> tuple[DataFrame, list[str | None]]:
    """``df`` with its columns called ``c0``, ``c1``, ..., and what the named ones are called now (null: not there).

    No column of the user's own can clash with an internal name then; ``toDF`` gives the
    old names back. Names are looked up as they are, then without regard to case.
    """
    have = df.columns
    lower = [c.lower() for c in have]
    places = [
        have.index(n) if n in have else lower.index(n.lower()) if n.lower() in lower else None for n in names
    ]
    return df.toDF(*[f"c{i}" for i in range(len(have))]), [None if i is None else f"c{i}" for i in places]


def hashable(df: DataFrame) -> list[str]:
    """The columns that can be hashed: those without maps and variants in them."""
    return [f.name for f in df.schema if not re.search(r"\bmap<|\bvariant\b", f.dataType.simpleString())]


def words(text: Column) -> Column:
    """The words of a text, in order; none of a null or blank one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def with_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``rank`` (bigint from 0) in the given order.

    Range partitions are counted and numbered on their own, so no task sees more
    than one of them; the order should be total, or ties are in any order.
    """
    parts = staged(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name
    )
    sizes = parts.groupBy("_part").count()  # a row for each partition
    before = sizes.select(
        "_part",
        (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"),
    )
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        parts.join(F.broadcast(before), "_part")
        .withColumn("rank", F.col("_before") + local - 1)
        .drop("_part", "_before")
    )


def join_keyed(
    rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, how: str = "inner"
) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has one row for a key.

    ``count`` names the column of ``keyed`` with the number of rows that have the
    key (an upper bound will do), ``total`` their sum. Keys with at least
    1/HOT_KEYS of that, of which there are HOT_KEYS at most, are broadcast; the
    others have small groups and are joined by a shuffle. Both inputs are read
    twice: pass staged tables. Keys must not be null.
    """
    is_hot = F.col(count) * HOT_KEYS >= F.lit(total)
    hot = keyed.filter(is_hot).drop(count)
    cold = keyed.filter(~is_hot).drop(count)
    return (
        rows.join(F.broadcast(hot.select(key)), key, "left_anti")
        .join(cold, key, how)
        .unionByName(rows.join(F.broadcast(hot), key))
    )


def forests(edges: DataFrame, blocks: int) -> DataFrame:
    """Edges ``u``, ``v`` (bigint) that connect what those of a block connect: each node with the smallest one.

    A task takes a few hundred thousand edges at a time, so it needs the same room
    for any number of them; blocks are partitions put together.
    """

    def connect(batches: Iterator) -> Iterator:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent[x]) != x:
                parent[x] = x = parent[up]
            return x

        def taken():
            nodes = list(parent)
            out = pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"]
            )
            parent.clear()
            return out

        held = 0
        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
                parent[max(a, b)] = min(a, b)
            held += batch.num_rows
            if held >= BLOCK_EDGES:
                yield taken()
                held = 0
        if parent:
            yield taken()

    return edges.select("u", "v").coalesce(blocks).mapInArrow(connect, "u bigint, v bigint")


def block_components(edges: DataFrame, name: str) -> DataFrame:
    """As ``connected_components``, for a staged table of edges between bigint nodes.

    Blocks of edges are connected in their tasks first. Edges that fill one block
    are done then; the forests of several go through the alternating steps, with
    fewer edges and rounds than the edges themselves.
    """
    blocks = -(-edges.count() * 2 // BLOCK_EDGES) or 1
    found = staged(forests(edges, blocks), name)
    if blocks == 1:
        return found.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return connected_components(found, name)


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of ``edges`` (u, v: not null).

    Alternating large-star and small-star steps: edges turn towards the smallest
    neighbour until nothing changes. Every step is written to the shared folder;
    the driver sees a count and a checksum only.
    """

    def turned(e: DataFrame, total: int) -> DataFrame:
        least = staged(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), name)
        return join_keyed(e, least, "u", "n", total)

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = staged(e.filter("u != v").distinct(), name)
    seen = state(e)
    while seen[0]:
        both = staged(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), name)
        large = turned(both, 2 * seen[0]).filter("v > u").select(
            F.col("v").alias("u"), F.least("m", "u").alias("v")
        )
        large = staged(large.distinct(), name)
        small = turned(large, seen[0])
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        e = staged(small.distinct(), name)
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
