"""Worker level: one wide row per run, step and worker."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.functions.scalars import per_second, percentage
from tracewise.schemas import LAYERS, STEP_KEYS

# Device time by report name, in report order.
PARTS = {
    "input": "input_device_duration",
    "bottom_mlp": "bottom_mlp_device_duration",
    "embedding": "embedding_device_duration",
    "communication": "communication_transfer_device_duration",
    "interaction": "interaction_device_duration",
    "top_mlp": "top_mlp_device_duration",
    "output": "output_device_duration",
}
OFFLINE_PARTS = {name: c for name, c in PARTS.items() if name not in ("input", "output")}


def _total(columns) -> Column:
    return reduce(add, [F.col(c) for c in columns])


def _one_event(condition: Column, prefix: str, columns: dict[str, str]) -> list[Column]:
    return [
        F.sum(F.when(condition, F.col(source))).alias(f"{prefix}_{target}")
        for source, target in columns.items()
    ]


def worker_layers(stats: DataFrame) -> DataFrame:
    """All events of a worker side by side, by one conditional aggregation.

    Several communications in one step are added up.
    """
    event, layer = F.col("event_name"), F.col("layer")
    io = {
        "host_duration": "host_duration",
        "host_bytes": "host_bytes",
        "device_duration": "device_duration",
        "device_bytes": "device_bytes",
        "throughput": "throughput",
    }
    communication = {
        "host_duration": "host_duration",
        "send_bytes": "send_bytes",
        "recv_bytes": "recv_bytes",
        "wait": "wait_device_duration",
        "transfer": "transfer_device_duration",
    }
    compute = {
        "host_bytes": "weights",
        "host_duration": "host_duration",
        "device_duration": "device_duration",
    }
    columns = _one_event(event == "input", "input", io)
    columns += _one_event(event == "communication", "communication", communication)
    for name in LAYERS:
        columns += _one_event((event == "compute") & (layer == name), name, compute)
    columns += _one_event(event == "output", "output", io)
    return stats.groupBy(*STEP_KEYS, "globalTid").agg(*columns)


def _with_layers(inference_stats: DataFrame, layers: DataFrame) -> DataFrame:
    """Each inference row with the layers of its worker's step and thread.

    Layers are already placed by worker and step. An equality of threads would be one more
    key of the join, for which they would be placed again, so it is asked in two halves.
    """
    keys = [*STEP_KEYS, "globalTid"]
    layers = layers.select(
        *[F.col(k).alias(f"_{k}") for k in keys], *[c for c in layers.columns if c not in keys]
    )
    same = [F.col(k) == F.col(f"_{k}") for k in STEP_KEYS]
    same += [F.col("globalTid") <= F.col("_globalTid"), F.col("globalTid") >= F.col("_globalTid")]
    joined = inference_stats.join(layers, reduce(and_, same), "left")
    others = [c for c in joined.columns if c not in keys and c not in [f"_{k}" for k in keys]]
    return joined.select(*keys, *others)


def worker_stats(inference_stats: DataFrame, stats: DataFrame) -> DataFrame:
    """Time, bytes and weights of every worker and step; 0 where it had none. Keys stay NULL."""
    joined = _with_layers(inference_stats, worker_layers(stats)).withColumn(
        "communication_throughput",
        per_second(
            F.col("communication_send_bytes") + F.col("communication_recv_bytes"),
            F.col("communication_transfer_device_duration"),
        ),
    )
    joined = joined.na.fill(0, [c for c in joined.columns if c not in (*STEP_KEYS, "globalTid")])
    totals = joined.withColumns(
        {
            "device_duration": _total([*PARTS.values(), "communication_wait_device_duration"]),
            "device_duration_without_wait": _total(PARTS.values()),
            "device_duration_without_wait_and_io": _total(OFFLINE_PARTS.values()),
        }
    )
    server, offline = "device_duration_without_wait", "device_duration_without_wait_and_io"
    return totals.withColumns(
        {
            **{
                f"server_{name}_percentage": percentage(F.col(c), F.col(server))
                for name, c in PARTS.items()
            },
            **{
                f"offline_{name}_percentage": percentage(F.col(c), F.col(offline))
                for name, c in OFFLINE_PARTS.items()
            },
        }
    )
