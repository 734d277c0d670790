"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A of the fit list are never decomposed in one place. A pass over
them gives the Gram matrix of A R^-1, for the triangular factor R found so far, as
sums that are combined before their shuffle; the driver factors that small matrix
and multiplies its factor to R. The first Gram matrix is shifted before its
Cholesky factorisation, so that a badly conditioned one has a factor as well. After
two more passes A R^-1 is orthonormal to working precision. The singular values
and right vectors of R are those of A, with none of the precision lost that squaring
A would cost.

Where rows do not span all dimensions, the shift keeps the solves defined; the last
Gram matrix then has eigenvalues next to 0, and its square root takes the place of
its Cholesky factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.common import staged

#: Steps of one unit of an entry.
SCALE = 256
#: Components with less than this share of the whole variance are none.
LEAST_SHARE = 1e-14
#: Passes that make rows orthonormal; the first one is shifted.
PASSES = 3
#: Rows whose products are added up at a time.
BLOCK = 4096


def _whole(vector: Column) -> Column:
    """A vector as whole numbers; NULL if it is null or empty or has an entry that is null or not finite."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    steps = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))
    return F.when((F.size(vector) > 0) & finite & ~F.exists(vector, lambda c: F.isnan(c.cast("double"))), steps)


def _matrix(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, width)


def _gram(fit: DataFrame, width: int, mean: np.ndarray, inverse: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The Gram matrix of (x - mean) in the dimensions ``kept`` times ``inverse``, over all rows of ``fit``."""
    size = inverse.shape[1]
    i, j = np.triu_indices(size)
    sent = fit.sparkSession.sparkContext.broadcast((mean[kept], inverse, kept, i, j))

    def products(batches: Iterator) -> Iterator:
        import pyarrow as pa

        mean, inverse, kept, i, j = sent.value
        total, any_rows = np.zeros((size, size)), False
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for at in range(0, len(x), BLOCK):
                y = (x[at : at + BLOCK, kept] - mean) @ inverse
                total += y.T @ y
                any_rows = True
        if any_rows:
            arrays = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "g"])

    rows = fit.mapInArrow(products, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))
    found = rows.toPandas()  # one row for each pair of dimensions
    gram = np.zeros((size, size))
    gram[found["i"], found["j"]] = found["g"]
    return np.triu(gram) + np.triu(gram, 1).T


def _factor(gram: np.ndarray, rows: int, shifted: bool) -> np.ndarray:
    """R with R^T R = ``gram``, upper triangular; shifted by what rounding can take from it, if asked."""
    width = len(gram)
    if shifted:
        least = 11 * (rows * width + width * (width + 1)) * np.finfo(float).eps / 2
        gram = gram + np.eye(width) * (least * max(np.linalg.norm(gram, 2), np.finfo(float).tiny))
    return np.linalg.cholesky(gram).T


def _inverse(r: np.ndarray) -> np.ndarray:
    """Of an upper triangular matrix, by substitution from the last row up."""
    inverse = np.zeros_like(r)
    for k in reversed(range(len(r))):
        row = -r[k, k + 1 :] @ inverse[k + 1 :]
        row[k] += 1
        inverse[k] = row / r[k, k]
    return inverse


def _lengths(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """The length of each centred column."""
    entry = F.col("entry") - F.element_at(F.array(*[F.lit(float(m)) for m in mean]), F.col("k") + 1)
    rows = fit.select(F.posexplode("x").alias("k", "entry")).groupBy("k").agg(F.sum(entry * entry).alias("s"))
    found = rows.toPandas().sort_values("k")  # one row for each dimension
    return np.sqrt(found["s"].to_numpy(float))


def triangular(
    fit: DataFrame, width: int, n: int, mean: np.ndarray, lengths: np.ndarray, kept: np.ndarray, passes: int = PASSES
) -> np.ndarray:
    """R of the centred rows in ``kept``: R^T R is their Gram matrix, though it is never taken apart itself."""
    # Dimensions are brought to one length first, so that the shift is small for each of them.
    r = np.diag(lengths[kept])
    for k in range(passes):
        gram = _gram(fit, width, mean, _inverse(r), kept)
        try:
            r = _factor(gram, n, shifted=k == 0) @ r
        except np.linalg.LinAlgError:  # rows that do not span all dimensions
            r = _factor(gram, n, shifted=True) @ r
    values, vectors = np.linalg.eigh(_gram(fit, width, mean, _inverse(r), kept))
    return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T @ r


def fit(rows: DataFrame, most: int | None = None) -> dict | None:
    """The whitening of the vectors of whole numbers in ``x``, all of one width; None if nothing varies.

    Equal vectors count once. Gives ``n``, ``sums``, ``components`` (a column
    each, by falling eigenvalue, the largest entry positive), ``values``, ``trace``
    and ``identity_error`` of the first ``most`` components that vary.
    """
    fit_list = staged(rows.select("x").distinct(), "whitening-fit")
    exact = fit_list.select(F.posexplode("x").alias("k", "entry")).groupBy("k").agg(
        F.sum(F.col("entry").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")
    ).orderBy("k").collect()  # one row for each dimension
    if not exact:
        return None
    n, width = exact[0]["n"], len(exact)
    sums = [int(row["s"]) for row in exact]
    mean = np.array([s / n for s in sums])
    lengths = _lengths(fit_list, mean)
    # a column that does not vary is no more than its rounding
    kept = np.flatnonzero(lengths > 1e-12 * np.sqrt(n) * np.maximum(np.abs(mean), 1))
    if not len(kept):
        return None
    r = triangular(fit_list, width, n, mean, lengths, kept)
    _, singular, right = np.linalg.svd(r)
    values = singular**2 / n
    trace = float(values.sum())
    k = int((values > LEAST_SHARE * trace).sum())
    k = min(k, most) if most is not None else k
    components = right[:k].T
    components = components * np.sign(components[np.abs(components).argmax(axis=0), np.arange(k)])
    whitened = components / np.sqrt(values[:k])
    error = np.abs(_gram(fit_list, width, mean, whitened, kept) / n - np.eye(k)).max()
    padded = np.zeros((width, k))
    padded[kept] = components
    return {
        "n": n, "sums": sums, "components": padded, "values": values[:k], "trace": trace, "identity_error": float(error),
    }


def whiten(
    embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", most: int | None = None
) -> DataFrame:
    """Each usable row with its components: one row for each of the first ``most``.

    An entry c becomes floor(256 c). A row takes no part if its vector is null or
    empty, holds an entry that is null or not finite, or is not as long as most
    usable ones are (the longer length of two equally frequent). Components, by
    falling variance of the different vectors, are those that vary: none for a
    table with one vector, which like an empty table gives no row. Repeated rows
    and null ids are kept. Other columns do not matter. A floor that leaves 64 bits
    or a deviation of more than 38 digits is an error.

    Returns ``id``, ``component``, ``n`` (different vectors), ``deviation`` (sum over
    dimensions of (n x - S)^2, exact), ``whitened``, ``explained``,
    ``identity_error``.
    """
    rows = embeddings.select(F.col(id).alias("id"), _whole(F.col(vector)).alias("x")).filter("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("length")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    width = usual[0]["length"] if usual else 0
    rows = rows.filter(F.size("x") == width)
    id_type = embeddings.schema[id].dataType.simpleString()
    schema = f"id {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(rows, most) if usual else None
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id)
    sent = embeddings.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = sent.value
        n, k = model["n"], len(model["values"])
        by = model["components"] / np.sqrt(model["values"])
        mean = np.array([s / model["n"] for s in model["sums"]])
        explained = model["values"] / model["trace"]
        most_sum = max(map(abs, model["sums"]))
        for batch in batches:
            x = _matrix(batch.column(1), width)
            largest = int(np.abs(x.astype(float)).max(initial=0)) + 1
            if (n * largest + most_sum) ** 2 * width < 1 << 63:
                deviation = np.square(n * x - np.array(model["sums"], np.int64)).sum(axis=1)
            else:  # whole numbers of any size
                far = n * x.astype(object) - np.array(model["sums"], object)
                deviation = [Decimal(int(d)) for d in (far * far).sum(axis=1)]
            deviation = pa.array(deviation).cast(pa.decimal128(38))
            whitened = (x - mean) @ by
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    deviation.take(each),
                    pa.array(whitened.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, model["identity_error"])),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema).withColumnRenamed("id", id)
