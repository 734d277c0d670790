"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target t and size s is worth t / s copies. The whole
part is certain; the fractions of a source play duels: words move at random from
one document to the other until one fraction is 0 or 1, which keeps both the
expected copies of every document and the words of the source. Blocks of
documents are settled on their own, and what is left of each (one document at
most) goes up a tree of further rounds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.llm.common import hashable, join_keyed, staged, with_rank

#: Fixed by the contract of the mix: weights by rank of the source, the share of
#: all words to take and the copies a document may have.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
COPIES = 2

#: Documents of a block, and blocks of a node of the tree.
BLOCK = 4096
FAN = 1024

_MASK = (1 << 64) - 1


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, copies=COPIES) -> DataFrame:
    """``target`` of each row (source, source_size), shared out by weight.

    Sources in the order of their code points, null last, take the weights in
    turn. None gets more than ``copies`` times its size; the rest is shared again
    by weight. The driver sees sums only, once for each round of sharing.
    """
    order = [F.col("source").asc_nulls_last()]
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))
    ranked = staged(
        with_rank(sizes, order, "mix-sources").withColumn("weight", weight.cast("double")), "mix-weights"
    )
    most = F.lit(copies) * F.col("source_size")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full_before = 0.0, -1
    while True:
        full = (F.lit(level) * F.col("weight") >= most) if full_before >= 0 else F.lit(False)
        taken, open_weight, n_full = ranked.agg(
            F.coalesce(F.sum(F.when(full, most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.coalesce(F.sum(full.cast("int")), F.lit(0)),
        ).first()
        if n_full == full_before or not open_weight:
            break
        level, full_before = (share * total - taken) / open_weight, n_full
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), most.cast("double"))).drop(
        "weight"
    )


def _random(a: int, b: int) -> float:
    """A number from [0, 1) that depends on two keys only."""
    x = (a * 0x9E3779B97F4A7C15 + b) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def duel(p: float, size: int, q: float, other: int, u: float) -> tuple[float, float]:
    """Fractions p and q of two documents after words moved until one is 0 or 1."""
    gain = min((1 - p) * size, q * other)  # words the first can win
    loss = min(p * size, (1 - q) * other)
    if u * (gain + loss) < loss:
        if gain == (1 - p) * size:
            return 1.0, q - gain / other
        return p + gain / size, 0.0
    if loss == p * size:
        return 0.0, q + loss / other
    return p - loss / size, 1.0


def settle(keys: list[int], sizes: list[int], parts: list[float], last: bool) -> list[float]:
    """Fractions turned to 0 or 1 by duels in the given order; one may stay open unless ``last``."""
    parts = list(parts)
    at = None
    for i, part in enumerate(parts):
        if not 0 < part < 1:
            continue
        if at is not None:
            p, q = duel(parts[at], sizes[at], part, sizes[i], _random(keys[at] & _MASK, keys[i] & _MASK))
            # rounding errors must not leave a fraction beyond its ends
            parts[at], parts[i] = min(max(p, 0.0), 1.0), min(max(q, 0.0), 1.0)
        if 0 < parts[i] < 1:
            at = i
        elif at is not None and not 0 < parts[at] < 1:
            at = None
    if last and at is not None:
        parts[at] = float(parts[at] >= 0.5)
    return parts


def _round(last: bool):
    def blocks(rows: pd.DataFrame) -> pd.DataFrame:
        # large documents first: small ones are left to even out the words
        rows = rows.sort_values(["size", "_key"], ascending=[False, True])
        parts = settle(rows["_key"].tolist(), rows["size"].tolist(), rows["_part"].tolist(), last)
        return rows.assign(_part=parts)

    return blocks


def copies(documents: DataFrame, size: Column, source: str = "source", **shares) -> DataFrame:
    """All columns, with ``size``, ``source_size``, ``target`` (of the source) and ``copies``.

    Documents without words have no copies. A null source is a source like any
    other. The rounding depends on the values of a row only, so reruns agree;
    rows that are equal in all columns are settled together in one block.
    Columns of the input with these names, in any case, give way.
    """
    new = ("size", "source_size", "target", "copies")
    kept = [c for c in documents.columns if c.lower() not in new]
    # other names while the work is done, so that none of the user's can clash with an internal one
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    plain = hashable(documents.select(*own))
    rows = documents.select(*own, size.cast("bigint").alias("size"), F.col(f"`{source}`").alias("source"))
    rows = rows.withColumn("_key", F.xxhash64(F.lit(7), *plain))
    light = staged(rows.select("_key", "size", "source"), "mix-rows")
    sources = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    targets = staged(source_targets(sources, **shares), "mix-targets")

    # a source as a number, so that a null one joins like the others
    number = F.coalesce(F.xxhash64("source"), F.lit(0))
    number = F.when(F.col("source").isNull(), F.lit(-1)).otherwise(number)
    light = staged(light.withColumn("_source", number).drop("source"), "mix-light")
    targets = targets.withColumn("_source", number)
    total, most = targets.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    per_word = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    worth = targets.select(
        "_source", "source_size", "target", per_word.alias("_worth"), "_n",
        F.ceil(F.col("_n") / BLOCK).alias("_blocks"),
    )
    worth = staged(worth.withColumn("_count", F.col("_n")), "mix-worth")
    valued = join_keyed(light, worth, "_source", "_count", total).select(
        "_key", "size", "_source", "source_size", "target",
        F.when(F.col("size") > 0, F.floor("_worth")).otherwise(0).cast("int").alias("_whole"),
        F.when(F.col("size") > 0, F.col("_worth") - F.floor("_worth")).otherwise(0.0).alias("_part"),
        F.pmod(F.hash("_key"), F.greatest("_blocks", F.lit(1))).cast("bigint").alias("_block"),
    )

    done, blocks = [], -(-most // BLOCK)
    while True:
        last = blocks <= 1
        settled = staged(
            valued.groupBy("_source", "_block").applyInPandas(_round(last), valued.schema), "mix-round"
        )
        is_open = (F.col("_part") > 0) & (F.col("_part") < 1)
        done.append(settled.filter(~is_open))
        if last:
            break
        blocks = -(-blocks // FAN)
        valued = settled.filter(is_open).withColumn("_block", F.floor(F.col("_block") / FAN).cast("bigint"))
    decided = done[0]
    for more in done[1:]:
        decided = decided.unionByName(more)
    # rows with one key are equal, so any of them may have any of their copies
    numbered = decided.select(
        "_key", "source_size", "target", (F.col("_whole") + F.col("_part")).cast("int").alias("copies")
    )
    return _by_place(rows.drop("source"), numbered).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *new
    )


def _by_place(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Joins on the key and, for equal rows, on their places among themselves."""
    place = F.row_number().over(Window.partitionBy("_key").orderBy("copies"))
    decided = decided.withColumn("_place", place)
    own = F.row_number().over(Window.partitionBy("_key").orderBy("size"))
    # as a difference, so that the key alone partitions both sides and the rows move once
    same_place = F.col("_own") - F.col("_place") == 0
    joined = rows.withColumn("_own", own).withColumnRenamed("_key", "_row").join(
        decided, (F.col("_row") == F.col("_key")) & same_place
    )
    return joined.drop("_key", "_row", "_place", "_own")
