"""Decoding of the JSON text of spans, and the byte sizes of tensors in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewise.functions.scalars import _literal_map
from tracewise.schemas import DTYPE_BYTES, PAYLOAD


def decode_payload(text: Column) -> Column:
    """The text as a struct; NULL fields where it is not the expected JSON."""
    return F.from_json(text, PAYLOAD)


def tensor_bytes(tensor: Column) -> Column:
    """Bytes of one ``[shape, dtype]``: 0 for ``[]``, NULL for an unknown dtype.

    A product beyond 64 bits raises.
    """
    shape = F.from_json(F.get(tensor, F.lit(0)), "array<bigint>")
    elements = F.aggregate(shape, F.lit(1).cast("bigint"), lambda n, dim: n * dim)
    element_bytes = _literal_map(DTYPE_BYTES)[F.get(tensor, F.lit(1))]
    return F.when(F.size(tensor) == 0, F.lit(0).cast("bigint")).otherwise(elements * element_bytes)


def tensors_bytes(tensors: Column) -> Column:
    """Bytes of a list of tensors: 0 for ``[]``, NULL if any member's size is unknown."""
    return F.aggregate(tensors, F.lit(0).cast("bigint"), lambda n, t: n + tensor_bytes(t))
