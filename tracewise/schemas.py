"""Table schemas, fixed vocabularies and the bundle of trace tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The profiler's numeric span types.
EVENT_TYPES = {
    33: "NvtxCategory",
    34: "NvtxMark",
    39: "NvtxThread",
    59: "NvtxPushPopRange",
    60: "NvtxStartEndRange",
    75: "NvtxDomainCreate",
    76: "NvtxDomainDestroy",
}
PUSH_POP_RANGE = 59

# Bytes per element of the tensor types a span may name.
DTYPE_BYTES = {"float32": 4, "float16": 2, "int32": 4}

# The host calls that belong to each kind of device work.
CALL_PATTERNS = {"copy": "%Memcpy%", "launch": "%LaunchKernel%"}
EVENT_CALLS = {
    "input": "copy",
    "compute": "launch",
    "communication": "launch",
    "output": "copy",
}

# The layers reported separately.
LAYERS = ["bottom_mlp", "embedding", "interaction", "top_mlp"]

# Table names in the profiler's SQLite export.
SQLITE_TABLES = {
    "spans": "NVTX_EVENTS",
    "runtime": "CUPTI_ACTIVITY_KIND_RUNTIME",
    "kernels": "CUPTI_ACTIVITY_KIND_KERNEL",
    "copies": "CUPTI_ACTIVITY_KIND_MEMCPY",
    "string_ids": "StringIds",
}

# Layout of the JSON object in a span's text. A tensor is [shape, dtype]; its
# two parts have different types, so both are read as text here.
PAYLOAD = (
    "event string, name string, rank bigint, local_rank bigint, step bigint, "
    "batch_size bigint, tensor array<string>, weights array<array<string>>, "
    "send_tensors array<array<string>>, recv_tensors array<array<string>>"
)

NANOSECOND = 1e-9

STEP_KEYS = ["run_id", "step_id", "rank", "local_rank"]


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


SCHEMAS = {
    "spans": _table(
        run_id=T.StringType(),
        globalTid=T.LongType(),
        eventType=T.IntegerType(),
        start=T.LongType(),
        end=T.LongType(),
        text=T.StringType(),
    ),
    "runtime": _table(
        run_id=T.StringType(),
        globalTid=T.LongType(),
        start=T.LongType(),
        end=T.LongType(),
        correlationId=T.LongType(),
        nameId=T.IntegerType(),
    ),
    "kernels": _table(
        run_id=T.StringType(),
        globalPid=T.LongType(),
        start=T.LongType(),
        end=T.LongType(),
        correlationId=T.LongType(),
    ),
    "copies": _table(
        run_id=T.StringType(),
        globalPid=T.LongType(),
        start=T.LongType(),
        end=T.LongType(),
        correlationId=T.LongType(),
        bytes=T.LongType(),
    ),
    "string_ids": _table(run_id=T.StringType(), id=T.IntegerType(), value=T.StringType()),
    "power": _table(
        run_id=T.StringType(),
        sample_idx=T.LongType(),
        gpu_uuid=T.StringType(),
        watts=T.DoubleType(),
    ),
}


@dataclass(frozen=True)
class TraceTables:
    """The tables of all runs; every one carries ``run_id``.

    In ``buckets`` by run and process, if there are any, they also carry ``pid``.
    """

    spans: DataFrame
    runtime: DataFrame
    kernels: DataFrame
    copies: DataFrame
    string_ids: DataFrame
    power: DataFrame | None = None
    buckets: int = 0
