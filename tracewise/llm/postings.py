"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample, with prices that keep the lists even.
Every vector goes to the list of its nearest centroid and, near a boundary, to
others whose centroid is almost as near. A query finds its centroids in a graph
held in memory and reads the lists whose distance is within a ratio of the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.llm.common import staged

#: The sample that centroids are fitted on, in rows and in numbers, and the lists they may make at most.
SAMPLE_ROWS, SAMPLE_NUMBERS, MAX_LISTS = 20_000, 8_000_000, 2_000
#: Vectors for each list aimed at, copies of a boundary vector, and the ratios of distances.
LIST_SIZE, COPIES, COPY_RATIO, SEARCH_RATIO = 256, 4, 1.06, 1.30
#: Vectors and queries of one task at most (by hash, so about).
PART_VECTORS, PART_QUERIES = 20_000, 2_000


@dataclass
class Centroids:
    """Centroids of length 1 and, for each, its nearest others."""

    vectors: np.ndarray
    graph: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> Centroids:
        """k-means on directions; a list that is too long raises its price."""
        random = np.random.default_rng(seed)
        at = sample[random.choice(len(sample), lists, replace=False)]
        price, mean = np.zeros(lists), len(sample) / lists
        for r in range(rounds):
            owner = np.concatenate(
                [(s @ at.T - price).argmax(axis=1) for s in np.array_split(sample, len(sample) // 4096 + 1)]
            )
            size = np.bincount(owner, minlength=lists)
            total = np.zeros_like(at)
            np.add.at(total, owner, sample)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            at = np.where(norm > 0, total / np.maximum(norm, 1e-12), at)
            price = np.clip(price + 0.02 * (size / mean - 1) / (1 + r / 4), -0.2, 0.2)
        return cls.of(at)

    @classmethod
    def of(cls, at: np.ndarray, degree: int = 16) -> Centroids:
        near = at @ at.T
        np.fill_diagonal(near, -2)
        k = max(1, min(degree, len(at) - 1))
        return cls(at, np.argsort(-near, axis=1, kind="stable")[:, :k] if len(at) > 1 else np.zeros((1, 1), int))

    def search(self, x: np.ndarray, beam: int = 64, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near each row, nearest first, and their distances: best first through the graph."""
        n, lists = len(x), len(self.vectors)
        beam = min(beam, lists)
        entries = np.unique(np.linspace(0, lists - 1, min(lists, 32)).astype(int))
        ids = np.tile(entries, (n, 1))
        seen = np.zeros((n, lists), bool)
        seen[:, entries] = True
        rows = np.arange(n)[:, None]
        near = x @ self.vectors[entries].T
        done = np.zeros((n, lists), bool)
        while True:
            order = np.argsort(-near, axis=1, kind="stable")[:, :beam]
            ids, near = ids[rows, order], near[rows, order]
            fresh = ~done[rows, ids] & np.isfinite(near)
            if not fresh.any():
                break
            # the nearest ones that have not been expanded yet
            pick = np.argsort(~fresh, axis=1, kind="stable")[:, :step]
            chosen, real = ids[rows, pick], fresh[rows, pick]
            done[np.broadcast_to(rows, chosen.shape)[real], chosen[real]] = True
            more = np.where(real[:, :, None], self.graph[chosen], -1).reshape(n, -1)
            known = (more < 0) | seen[rows, np.maximum(more, 0)]
            more = np.where(known, -1, more)
            # the same centroid may be reached twice in one step
            more.sort(axis=1)
            more[:, 1:][more[:, 1:] == more[:, :-1]] = -1
            real = more >= 0
            seen[np.broadcast_to(rows, more.shape)[real], more[real]] = True
            value = np.full(more.shape, -np.inf)
            at = np.nonzero(real)
            value[at] = np.einsum("ij,ij->i", x[at[0]], self.vectors[more[at]])
            ids = np.concatenate([ids, np.maximum(more, 0)], axis=1)
            near = np.concatenate([near, value], axis=1)
        distance = np.sqrt(np.maximum(2 - 2 * near, 0))
        return np.where(np.isfinite(near), ids, -1), np.where(np.isfinite(near), distance, np.inf)

    def lists_of(self, x: np.ndarray, copies: int, ratio: float) -> list[np.ndarray]:
        """The lists of each vector: the nearest, and almost as near ones that lie in other directions."""
        ids, distance = self.search(x, beam=16)
        out = []
        for row, d in zip(ids, distance):
            kept = [row[0]]
            for i, di in zip(row[1:], d[1:]):
                if len(kept) == copies or di > ratio * d[0] + 1e-9:
                    break
                apart = np.sqrt(np.maximum(2 - 2 * self.vectors[kept] @ self.vectors[i], 0))
                if (apart > 0.5 * di).all():
                    kept.append(i)
            out.append(np.array(kept))
        return out

    def probes(self, x: np.ndarray, ratio: float, beam: int) -> list[np.ndarray]:
        """The lists that a query reads."""
        ids, distance = self.search(x, beam=beam)
        return [row[(d <= ratio * d[0] + 1e-9) & (row >= 0)] for row, d in zip(ids, distance)]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null, no number that is not finite, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def search(
    table: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding",
    search_ratio: float = SEARCH_RATIO, beam: int = 64,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the id and ``score`` (cosine) of the k nearest found for each query.

    Rows without an id or a usable vector take no part, nor do vectors of another
    length than the commonest (of equally common ones, the longest). Rows with
    one id and one vector count once. Ties go to the smaller id. A query's own id
    is never among its results.
    """
    found = table.filter(F.col(id).isNotNull() & usable(F.col(vector)))
    found = found.select(
        F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")
    )
    lengths = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if lengths is None:
        return table.sparkSession.createDataFrame([], result)
    width, total = lengths
    found = staged(found.filter(F.size("v") == width).distinct(), "ann-vectors")

    # Of equal vectors only the k + 1 smallest ids can be among the nearest of a query.
    group = Window.partitionBy("v").orderBy("id")
    distinct = found.withColumn("_r", F.row_number().over(group)).filter(F.col("_r") <= k + 1).drop("_r")
    rows = min(SAMPLE_ROWS, SAMPLE_NUMBERS // width)
    taken = found.select("v").orderBy(F.xxhash64("id")).limit(rows).collect()  # bounded by SAMPLE_NUMBERS
    sample = _unit(np.array([r[0] for r in taken], np.float64))
    lists = max(1, min(MAX_LISTS, len(sample) // 8, -(-total // LIST_SIZE)))
    centroids = Centroids.fit(np.unique(sample, axis=0), min(lists, len(np.unique(sample, axis=0))))

    def assign(ratio: float, copies: int | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), 512):
                    part = batch.iloc[start : start + 512]
                    x = _unit(_matrix(part["v"]))
                    own = centroids.lists_of(x, copies, ratio) if copies else centroids.probes(x, ratio, beam)
                    n = [len(o) for o in own]
                    yield pd.DataFrame(
                        {"list": np.concatenate(own), "id": part["id"].repeat(n), "v": part["v"].repeat(n)}
                    )

        return run

    kind = "list int, id bigint, v array<double>"
    posted = staged(distinct.select("id", "v").mapInPandas(assign(COPY_RATIO, COPIES), kind), "ann-lists")
    asked = staged(found.filter("q").select("id", "v").mapInPandas(assign(search_ratio, None), kind), "ann-queries")

    # lists and their queries in parts of a bounded size; there are MAX_LISTS lists at most
    size = posted.groupBy("list").count().withColumnRenamed("count", "_n")
    size = size.join(asked.groupBy("list").count().withColumnRenamed("count", "_m"), "list")
    parts = staged(
        size.select("list", F.ceil(F.col("_n") / PART_VECTORS).cast("int").alias("_np"),
                    F.ceil(F.col("_m") / PART_QUERIES).cast("int").alias("_mp")),
        "ann-parts",
    )
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = posted.join(F.broadcast(parts), "list").select("list", "id", "v", part("_np").alias("a"), every("_mp").alias("b"))
    right = asked.join(F.broadcast(parts), "list").select("list", "id", "v", part("_mp").alias("b"), every("_np").alias("a"))

    def nearest(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(vectors["v"]), vectors["id"].to_numpy()
        out = []
        if len(vectors):
            norm = np.sqrt((x * x).sum(axis=1))
            for start in range(0, len(queries), 128):
                some = queries.iloc[start : start + 128]
                q = _matrix(some["v"])
                close = (q @ x.T) / norm
                close[ids[None, :] == some["id"].to_numpy()[:, None]] = -np.inf
                for key, row, mine in zip(some["id"].tolist(), close, q):
                    size = np.sqrt((mine * mine).sum())
                    edge = np.partition(row, -k)[-k] if len(row) >= k else -np.inf
                    near = np.nonzero((row >= edge - 1e-6 * size) & (row > -np.inf))[0]
                    # the same order of additions for every pair: equal vectors have equal scores
                    score = (x[near] * mine).sum(axis=1) / (norm[near] * size)
                    best = np.lexsort((ids[near], -score))[:k]
                    out += zip([key] * len(best), ids[near][best].tolist(), score[best].tolist())
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    met = left.groupBy("list", "a", "b").cogroup(right.groupBy("list", "a", "b"))
    pairs = met.applyInPandas(nearest, "query_id bigint, vec_id bigint, score double")
    # an id may come from several lists, or with several vectors: its best score counts
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
