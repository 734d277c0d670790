"""SimHash near-duplicates by pigeonring filtering.

A fingerprint of 64 bits is cut into m segments on a ring. If two fingerprints
differ in at most t bits, there is a segment from which every chain of l
consecutive segments differs in at most l * t / m bits (the pigeonring
principle). The longest chains that must be equal are the join key; the longer
ones are checked one after the other before the full distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.common import connected_components, join_keyed, staged
from tracewise.llm.text import word_blocks

SEED = 42
#: Odd numbers of segments give the longest keys for the number of keys: 27 or 28 bits here.
SEGMENTS = 7
#: Fingerprints with equal keys are compared pair by pair up to this number; beyond
#: it every fingerprint looks up the ones near it, which costs the same for each.
PAIRWISE = 512

def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as an unsigned number. Texts without words have 0."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for block in word_blocks((text or "").encode().lower()):  # bytes: A-Z and ASCII space only
        tail += block
        k = len(tail) - shingle + 1
        if k > 0:
            rows = zip(*(tail[i : i + k] for i in range(shingle)))
            hashes = np.fromiter((digest(b" ".join(row), SEED) for row in rows), np.uint64, k)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(k, 8), axis=1, bitorder="little")
            ones += np.add.reduce(bits, axis=0, dtype=np.int64)
            n += k
            tail = tail[k:]
    if not n and tail:
        return digest(b" ".join(tail), SEED)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text column as a bigint (the same bits, signed)."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        made = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(made.view(np.int64))

    return of(text)


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _rotated(bits: Column, by: int) -> Column:
    return F.shiftleft(bits, by).bitwiseOR(F.shiftrightunsigned(bits, 64 - by)) if by else bits


def chains(segments: int, distance: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For every start: the first bit (from the top) and for every chain its bits and its budget."""
    sizes = [64 // segments + (i < 64 % segments) for i in range(segments)]
    return [
        (
            sum(sizes[:i]),
            [
                (sum(sizes[(i + j) % segments] for j in range(length)), length * distance // segments)
                for length in range(1, segments + 1)
            ],
        )
        for i in range(segments)
    ]


def links(nodes: DataFrame, distance: int, segments: int = SEGMENTS, pairwise: int = PAIRWISE) -> DataFrame:
    """All pairs a < b of the distinct numbers in ``fp`` that differ in 1 to ``distance`` bits."""
    ring = chains(segments, distance)
    equal = [max((bits for bits, budget in chain if budget == 0), default=0) for _, chain in ring]
    if not all(equal):
        raise ValueError(f"{segments} segments are too few for a distance of {distance}")
    key = [F.shiftrightunsigned(_rotated(F.col("fp"), at), 64 - e) for (at, _), e in zip(ring, equal)]
    keyed = nodes.select("fp", F.posexplode(F.array(*key)).alias("start", "key"))
    sizes = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = staged(keyed.join(sizes, ["start", "key"]), "simhash-keys")

    few = shared.filter(F.col("n") <= pairwise)
    a = few.select("start", "key", F.col("fp").alias("a"))
    b = few.select("start", "key", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    passes = F.lit(False)
    for i, (at, chain) in enumerate(ring):
        turned, ok = _rotated(differ, at), F.col("start") == i
        for bits, budget in chain[:-1]:
            if bits > equal[i]:
                ok &= F.bit_count(F.shiftrightunsigned(turned, 64 - bits)) <= budget
        passes |= ok
    near = a.join(b, ["start", "key"]).filter("a < b").filter(passes & (F.bit_count(differ) <= distance))

    # Keys of many: each fingerprint with every change of the bits outside its key.
    masks = []
    for i, (at, _) in enumerate(ring):
        free = [63 - (at + bit) % 64 for bit in range(equal[i], 64)]
        for k in range(1, distance + 1):
            for bits in combinations(free, k):
                value = sum(1 << bit for bit in bits)
                masks.append((i, value - (1 << 64) if value >> 63 else value))
    masks = nodes.sparkSession.createDataFrame(masks, "start int, mask bigint")
    many = shared.filter(F.col("n") > pairwise).select("start", F.col("fp").alias("a"))
    changed = many.join(F.broadcast(masks), "start").select(
        "a", F.col("a").bitwiseXOR(F.col("mask")).alias("b")
    )
    looked_up = changed.filter("a < b").join(nodes.select(F.col("fp").alias("b")), "b")
    return near.select("a", "b").unionByName(looked_up.select("a", "b")).distinct()


def near_duplicates(
    documents: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2
) -> DataFrame:
    """All columns but the text, with ``fp`` (bigint) and ``component_id``, the smallest id reachable.

    Texts with one fingerprint are one node. Null and blank texts have the
    fingerprint 0 and link like any other. Rows with a null id count as members
    that never give a component its name; a component of only such rows has a
    null one. Columns named ``fp`` or ``component_id`` give way.
    """
    kept = [c for c in documents.columns if c.lower() not in (text.lower(), "fp", "component_id")]
    rows = staged(documents.select(*[F.col(f"`{c}`") for c in kept], fingerprints(F.col(text), shingle).alias("fp")), "simhash-rows")
    nodes = staged(
        rows.groupBy("fp").agg(F.min(id).alias("first"), F.count("*").alias("n")), "simhash-nodes"
    )
    edges = links(nodes.select("fp"), distance).select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = connected_components(edges, "simhash-components")
    linked = found.join(nodes.withColumnRenamed("fp", "node"), "node")
    least = staged(linked.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("size")),
                   "simhash-least")
    total = least.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    found = staged(found, "simhash-found")
    named = join_keyed(found, least, "component", "size", total).select(F.col("node").alias("fp"), "least")
    keyed = staged(
        nodes.join(named, "fp", "left").select(
            "fp", "n", F.coalesce("least", "first").alias("component_id")
        ),
        "simhash-named",
    )
    return join_keyed(rows, keyed, "fp", "n", rows.count())
