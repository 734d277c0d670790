"""Bags of embedding ids: flattening, offsets, hashing and pooling."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.operators.running_total import running_total
from tracewise.session import Staging


def explode_bags(features: DataFrame) -> DataFrame:
    """``(sample_id, table_id, ids)`` from ``bags``, one row per sample and table."""
    return features.select("sample_id", F.posexplode("bags").alias("table_id", "ids"))


def flatten_bags(bags: DataFrame) -> DataFrame:
    """``(sample_id, table_id, pos, idx)`` from ``(sample_id, table_id, ids)``."""
    return bags.select("sample_id", "table_id", F.posexplode("ids").alias("pos", "idx"))


def bag_sizes(bags: DataFrame) -> DataFrame:
    """``(sample_id, table_id, size)`` from ``(sample_id, table_id, ids)``."""
    return bags.select("sample_id", "table_id", F.size("ids").cast("bigint").alias("size"))


def bag_offsets(sizes: DataFrame, staging: Staging) -> DataFrame:
    """Where each sample's ids start in the list of all ids of its table.

    ``sizes`` is ``(sample_id, table_id, size)``; samples are in the order of
    their id.
    """
    # Written first: ordering reads its input twice, and bags may be costly to make.
    sizes = staging.table("bag_sizes", sizes)
    totals = running_total(
        sizes, ["sample_id"], F.col("size"), "upto", staging, per=["table_id"]
    )
    return totals.select(
        "table_id", "sample_id", "size", (F.col("upto") - F.col("size")).alias("offset")
    )


def hash_ids(df: DataFrame, sizes: int | Mapping[str, int], columns: list[str] | None = None):
    """``df`` with id columns reduced to their table sizes.

    ``sizes`` is one size for all of ``columns`` or a size per column.
    """
    if isinstance(sizes, int):
        sizes = dict.fromkeys(columns, sizes)
    return df.withColumns({c: F.pmod(F.col(c), F.lit(n)) for c, n in sizes.items()})


# Vectors that are summed at a time in a task.
_BLOCK_BYTES = 32 << 20


def _packed(embeddings: DataFrame, width: int) -> DataFrame:
    """``(table_id, idx, packed, found)`` with each vector as the bytes of its numbers."""
    whole = isinstance(embeddings.schema["vector"].dataType.elementType, T.IntegralType)
    fields = [embeddings.schema["table_id"], embeddings.schema["idx"]]
    more = [T.StructField("packed", T.BinaryType()), T.StructField("found", T.BooleanType())]

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            vectors = batch.column(2)
            lengths = pc.list_value_length(vectors.drop_null()).to_numpy(zero_copy_only=False)
            if len(lengths) and (lengths.min() != width or lengths.max() != width):
                wrong = lengths[lengths != width][0]
                raise ValueError(f"vector is not {width} wide but {wrong}")
            numbers = vectors.drop_null().flatten().cast(pa.int64() if whole else pa.float64()).fill_null(0)
            present = vectors.is_valid().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(present) * width * 8]).astype(np.int32)
            data = pa.py_buffer(numbers.to_numpy(zero_copy_only=False).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends.tobytes()), data])
            columns = [batch.column(0), batch.column(1), packed, pa.array(np.ones(len(batch), bool))]
            yield pa.RecordBatch.from_arrays(columns, names=["table_id", "idx", "packed", "found"])

    return embeddings.select("table_id", "idx", "vector").mapInArrow(pack, T.StructType(fields + more))


def _added(table, width: int, kind: str):
    """One row for each sample and table of these, in the order of their first one: sums of the rest."""
    import pyarrow as pa
    import pyarrow.compute as pc

    codes = np.zeros(len(table), np.int64)
    for name in ("sample_id", "table_id"):
        keys = table[name].combine_chunks().dictionary_encode()
        if isinstance(keys, pa.ChunkedArray):
            keys = keys.combine_chunks()
        codes = codes * (len(keys.dictionary) + 1) + keys.indices.fill_null(len(keys.dictionary)).to_numpy()
    _, first, group = np.unique(codes, return_index=True, return_inverse=True)
    place = np.empty(len(first), np.int64)
    place[np.argsort(first)] = np.arange(len(first))
    group, first = place[group], np.sort(first)
    missing = np.bincount(group, weights=table["missing"].to_numpy(), minlength=len(first)).astype(np.int64)

    packed = table["packed"].combine_chunks()
    size = pc.binary_length(packed).to_numpy(zero_copy_only=False)
    ends = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, packed.offset * 4)
    data = np.frombuffer(packed.buffers()[2] or b"", kind)[ends[0] // 8 : ends[-1] // 8].reshape(-1, width)
    of = group[size > 0]
    order = np.argsort(of, kind="stable")
    starts = np.flatnonzero(np.diff(of[order], prepend=-1))
    sums = np.zeros((len(first), width), kind)
    if len(order):
        most = float(np.abs(data.astype(float)).max()) * len(data)
        if kind == "i8" and most >= 2**63 and np.abs(np.add.reduceat(data[order].astype(float), starts)).max() >= 2**62:
            raise OverflowError("sums of a bag leave 64 bits")
        sums[of[order][starts]] = np.add.reduceat(data[order], starts)
    bounds = (np.arange(len(first) + 1) * width * 8).astype(np.int32)
    total = pa.Array.from_buffers(
        pa.binary(), len(first), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(sums.tobytes())]
    )
    rows = pa.array(first)
    return pa.table([table["sample_id"].take(rows), table["table_id"].take(rows), pa.array(missing), total],
                    names=["sample_id", "table_id", "missing", "packed"])


def embedding_bag_sum(ids: DataFrame, embeddings: DataFrame, width: int) -> DataFrame:
    """Sum of the embeddings of each bag.

    ``ids`` is ``(sample_id, table_id, idx)``, with a NULL ``idx`` for an empty
    bag, ``embeddings`` is ``(table_id, idx, vector)`` with ``width`` numbers.
    Adds ``missing``, the number of ids without an embedding; those add nothing,
    nor does a NULL vector or number. A vector of another width is an error, and so
    are whole numbers whose sum leaves 64 bits.

    A vector travels as one value, and blocks of them are added up in the tasks:
    first those that a task of the join has for a bag, then what is left, in the
    order of bags, of which a task holds a block and one bag. A popular id is a
    hot key on the side of the bags only, where adaptive execution can split it,
    and a large bag has one row for each block before it is shuffled.
    """
    whole = isinstance(embeddings.schema["vector"].dataType.elementType, T.IntegralType)
    kind = "i8" if whole else "f8"
    keys = ["sample_id", "table_id"]
    # sums have the types of the keys of the bags
    key_types = T.StructType([ids.schema[k] for k in keys])
    between = T.StructType([*key_types, T.StructField("missing", T.LongType()), T.StructField("packed", T.BinaryType())])
    number = T.LongType() if whole else T.DoubleType()
    result = T.StructType([*key_types, T.StructField("pooled", T.ArrayType(number)), T.StructField("missing", T.LongType())])
    rows_at_once = max(1, _BLOCK_BYTES // (8 * width))

    def block(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= rows_at_once:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held)

    def combine(batches: Iterator) -> Iterator:
        for table in block(batches):
            yield from _added(table, width, kind).to_batches()

    def finish(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def lists(table):
            numbers = np.frombuffer(b"".join(table["packed"].to_pylist()), kind)
            bounds = pa.array((np.arange(len(table) + 1) * width).astype(np.int32))
            pooled = pa.ListArray.from_arrays(bounds, pa.array(numbers))
            return pa.table([table["sample_id"], table["table_id"], pooled, table["missing"]],
                            names=[*keys, "pooled", "missing"]).to_batches()

        last = None
        for table in block(batches):
            table = pa.table(table.columns, names=table.column_names)  # no field is marked as never NULL
            found = _added(table if last is None else pa.concat_tables([last, table]), width, kind)
            yield from lists(found.slice(0, len(found) - 1))
            last = found.slice(len(found) - 1)  # it may go on in the next block
        if last is not None:
            yield from lists(last)

    missing = (F.col("idx").isNotNull() & F.col("found").isNull()).cast("bigint")
    joined = ids.join(_packed(embeddings, width), ["table_id", "idx"], "left").select(
        *keys, missing.alias("missing"), F.coalesce("packed", F.lit(b"")).alias("packed")
    )
    partial = joined.mapInArrow(combine, between)
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(finish, result)
