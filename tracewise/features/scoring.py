"""Batch scoring with dense layers, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Layers = Sequence[tuple[np.ndarray, np.ndarray]]

# Layer weights travel with the tasks, so their size is bounded.
MAX_WEIGHT_BYTES = 256 << 20


def _rows(column, width: int | None, name: str) -> tuple[np.ndarray, np.ndarray, int]:
    """The rows of a list column that are not NULL, whether each row is, and their length.

    All must have ``width`` entries, or as many as each other if that is None.
    """
    import pyarrow.compute as pc

    null = column.is_null().to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(column.drop_null()).to_numpy(zero_copy_only=False)
    if width is None:
        width = int(lengths[0]) if len(lengths) else 0
    if len(lengths) and (lengths.min() != width or lengths.max() != width):
        raise ValueError(f"{name} has {lengths.min()} to {lengths.max()} entries instead of {width}")
    return column.drop_null().flatten(), null, width


def _with_lists(batch, name: str, x: np.ndarray, null: np.ndarray):
    """``batch`` with the rows of ``x`` as lists; NULL where ``null`` is true."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(~null) * x.shape[1]]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()), mask=pa.array(null))
    return pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, name])


def _checked(layers: Layers, max_bytes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    layers = [(np.asarray(w, dtype=float), np.asarray(b, dtype=float)) for w, b in layers]
    size = sum(w.nbytes + b.nbytes for w, b in layers)
    if size > max_bytes:
        raise ValueError(f"layer weights take {size} bytes, more than {max_bytes}")
    for (w, _), (following, _) in zip(layers, layers[1:], strict=False):
        if w.shape[0] != following.shape[1]:
            raise ValueError("the output width of a layer must be the input width of the next")
    for w, b in layers:
        if b.shape != (w.shape[0],):
            raise ValueError("a layer needs one bias per output")
    return layers


def score_mlp(
    df: DataFrame,
    vector: str,
    layers: Layers,
    output: str = "score",
    max_bytes: int = MAX_WEIGHT_BYTES,
) -> DataFrame:
    """``df`` with ``output``: ``vector`` through linear layers, each with ReLU.

    A layer is ``(weights[out, in], bias[out])``; the last one has ReLU as well.
    A NULL vector has a NULL score; one of another width than the first layer is
    an error. Weights of more than ``max_bytes`` are refused.
    """
    checked = _checked(layers, max_bytes)
    width = checked[0][0].shape[1]
    weights = df.sparkSession.sparkContext.broadcast(checked)

    def score(batches: Iterator) -> Iterator:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(vector))
            values, null, _ = _rows(column, width, vector)
            x = np.asarray(values, dtype=float).reshape(-1, width)
            for w, b in weights.value:
                x = np.maximum(x @ w.T + b, 0)
            yield _with_lists(batch, output, x, null)

    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(score, schema)


def interact(df: DataFrame, vectors: str, output: str) -> DataFrame:
    """``df`` with ``output``: the pairwise dot products of an array of vectors.

    The numbers of ``pairwise_dot``, as one matrix product per sample and batch.
    All rows must have the same number of vectors of the same width, which is
    checked, or be NULL.
    """

    def products(batches: Iterator) -> Iterator:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(vectors))
            each, null, count = _rows(column, None, vectors)
            values, missing, width = _rows(each, None, f"a vector of {vectors}")
            if missing.any():
                raise ValueError(f"{vectors} has a NULL vector")
            x = np.asarray(values, dtype=float).reshape((~null).sum(), count, width)
            i, j = np.tril_indices(count, -1)
            yield _with_lists(batch, output, (x @ x.transpose(0, 2, 1))[:, i, j], null)

    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(products, schema)


def score_model(
    samples: DataFrame, pooled: DataFrame, tables: int, bottom: Layers, top: Layers
) -> DataFrame:
    """Scores of samples from their dense features and pooled embeddings.

    ``samples`` is ``(sample_id, dense)``; ``pooled`` is ``(sample_id, table_id,
    pooled)`` for ``tables`` tables, as wide as the output of the ``bottom``
    layers, where no row means an empty bag. That output and the pooled vectors
    interact, and the output followed by the interactions goes through the
    ``top`` layers. A row of another table, and two rows of one sample and
    table, are errors.
    """
    width = np.shape(bottom[-1][0])[0]
    empty = F.array_repeat(F.lit(0.0), width)
    table = F.col("table_id").cast("bigint")
    # Each row sets its table's bit, so as many bits as rows means that all are different and known.
    bits = [
        F.bit_count(
            F.coalesce(
                F.bit_or(
                    F.when(
                        table.between(first, min(first + 63, tables) - 1),
                        F.expr(f"shiftleft(1L, cast(table_id - {first} AS int))"),
                    )
                ),
                F.lit(0).cast("bigint"),
            )
        )
        for first in range(0, tables, 63)
    ]
    # A sample has one row per table; its tables become columns, in order.
    columns = [f"_table{t}" for t in range(tables)]
    by_table = pooled.groupBy("sample_id").agg(
        *[
            F.any_value(F.when(F.col("table_id") == t, F.col("pooled")), ignoreNulls=True).alias(c)
            for t, c in enumerate(columns)
        ],
        (F.count(F.lit(1)) == sum(bits, F.lit(0))).alias("_proper"),
    )
    dense = score_mlp(samples.select("sample_id", "dense"), "dense", bottom, "bottom")
    bags = [F.coalesce(F.col(c).cast("array<double>"), empty) for c in columns]
    wrong = F.raise_error(
        F.concat(
            F.lit(f"pooled has tables beyond {tables} or twice for sample "),
            F.coalesce(F.col("sample_id").cast("string"), F.lit("NULL")),
        )
    )
    vectors = F.when(F.col("bottom").isNotNull(), F.array("bottom", *bags))
    joined = dense.join(by_table, "sample_id", "left").select(
        "sample_id",
        "bottom",
        F.when(F.coalesce("_proper", F.lit(True)), vectors)
        .otherwise(wrong.cast("array<array<double>>"))
        .alias("vectors"),
    )
    interacted = interact(joined, "vectors", "interaction").select(
        "sample_id", F.concat("bottom", "interaction").alias("concatenated")
    )
    scored = score_mlp(interacted, "concatenated", top, "score")
    return scored.select("sample_id", "score")
