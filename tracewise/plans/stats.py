"""Host and device statistics per step, worker, event and layer.

All events are aggregated together; the statistics of one event are a filter on
a grouping column, which Spark pushes below the aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions.scalars import _literal_map, per_second
from tracewise.operators.containment import PLACE, contained_chain
from tracewise.plans.calls import call_codes, split_wait, work_time
from tracewise.plans.spans import STEP_COLUMNS
from tracewise.schemas import EVENT_CALLS, STEP_KEYS

# Inputs and outputs are not told apart by name, so their layer is ''.
LAYER_KEYS = [*STEP_KEYS, "event_name", "layer"]
# In the order that sorts fastest: the first few bytes of a step tell most rows apart, those of a run few.
_SORTED_KEYS = ["step_id", *[k for k in LAYER_KEYS if k != "step_id"]]
_EVENTS = list(EVENT_CALLS)


def _with_layer(df: DataFrame) -> DataFrame:
    layered = F.col("event_name").isin("compute", "communication")
    return df.withColumn("layer", F.when(layered, F.col("event_value")).otherwise(F.lit("")))


def _first_span(*columns: str) -> Column:
    """These columns of the earliest span; of spans that start together the one that ends first."""
    at = F.struct("start", "end", "globalTid")
    return F.min_by(F.struct(*columns), F.when(F.col("start").isNotNull(), at))


def _first_thread() -> Column:
    at = F.when(F.col("start").isNotNull(), F.struct("start", "globalTid"))
    return F.min_by("globalTid", at).alias("globalTid")


def host_stats(steps: DataFrame) -> DataFrame:
    """Span side. ``duration`` is that of the earliest span; bytes are sums."""
    return (
        _with_layer(steps.filter(F.col("event_name").isin(_EVENTS)))
        .groupBy(*_SORTED_KEYS)
        .agg(
            _first_span("globalTid", "duration").alias("_first"),
            F.sum("duration").alias("duration_sum"),
            F.sum("bytes").alias("bytes"),
            F.sum("send_bytes").alias("send_bytes"),
            F.sum("recv_bytes").alias("recv_bytes"),
        )
        .select("*", "_first.*")
        .drop("_first")
    )


def device_stats(device: DataFrame) -> DataFrame:
    """Device side. ``wait`` and ``transfer`` are set for communication only."""
    work = (
        _with_layer(device.filter(F.col("event_name").isin("input", "compute", "output")))
        .groupBy(*_SORTED_KEYS)
        .agg(
            _first_thread(),
            F.sum("bytes").alias("bytes"),
            F.sum("duration").alias("duration"),
            F.avg("throughput").alias("throughput"),
        )
    )
    return work.unionByName(communication_device_stats(device), allowMissingColumns=True)


def communication_device_stats(device: DataFrame) -> DataFrame:
    kernels = split_wait(device.filter(F.col("event_name") == "communication"))
    return (
        _with_layer(kernels)
        .groupBy(*_SORTED_KEYS)
        .agg(
            _first_thread(),
            F.sum("wait").alias("wait"),
            F.sum("transfer").alias("transfer"),
        )
    )


def _of(stats: DataFrame, event: str, *columns) -> DataFrame:
    value = [F.col("layer").alias("event_value")] if event in ("compute", "communication") else []
    return stats.filter(F.col("event_name") == event).select(
        *STEP_KEYS, "globalTid", "event_name", *value, *columns
    )


def step_input_host_stats(host: DataFrame) -> DataFrame:
    return _of(host, "input", "duration", "duration_sum", "bytes")


def step_output_host_stats(host: DataFrame) -> DataFrame:
    return _of(host, "output", "duration", "duration_sum", "bytes")


def step_compute_host_stats(host: DataFrame) -> DataFrame:
    return _of(host, "compute", "duration", "duration_sum", F.col("bytes").alias("weights"))


def step_communication_host_stats(host: DataFrame) -> DataFrame:
    return _of(host, "communication", "duration", "duration_sum", "send_bytes", "recv_bytes")


def step_input_device_stats(device: DataFrame) -> DataFrame:
    return _of(device, "input", "bytes", "duration", "throughput")


def step_output_device_stats(device: DataFrame) -> DataFrame:
    return _of(device, "output", "bytes", "duration", "throughput")


def step_compute_device_stats(device: DataFrame) -> DataFrame:
    return _of(device, "compute", "duration")


def step_communication_wait_device_stats(communication: DataFrame) -> DataFrame:
    return _of(communication, "communication", F.col("wait").alias("duration"))


def step_communication_transfer_device_stats(communication: DataFrame) -> DataFrame:
    return _of(communication, "communication", F.col("transfer").alias("duration"))


def layer_stats(
    steps: DataFrame, device: DataFrame, events: Sequence[str] = tuple(EVENT_CALLS)
) -> DataFrame:
    """Host and device side of every event that has both, in one aggregation.

    Spans and device work are combined by their keys instead of being aggregated
    apart and joined. Few rows of a layer come from the same task of the joins before,
    so they are not reduced before the shuffle; it places the rows of a worker's step
    together, where the worker table needs them too.
    """
    spans = steps.filter(F.col("event_name").isin(*events)).select(
        *STEP_KEYS, "event_name", "event_value", "globalTid", "start", "end", "duration", "bytes",
        "send_bytes", "recv_bytes", F.lit(1).alias("spans"),
    )
    parts = [spans]
    worked = [event for event in events if event != "communication"]
    if worked:
        parts.append(
            device.filter(F.col("event_name").isin(*worked)).select(
                *STEP_KEYS, "event_name", "event_value", "throughput",
                F.col("duration").alias("device_duration"),
                F.col("bytes").alias("device_bytes"),
                F.lit(1).alias("works"),
            )
        )
    if "communication" in events:
        parts.append(
            split_wait(device.filter(F.col("event_name") == "communication")).select(
                *STEP_KEYS, "event_name", "event_value", "wait", "transfer", F.lit(1).alias("works")
            )
        )
    both = reduce(partial(DataFrame.unionByName, allowMissingColumns=True), parts)
    for column, kind in {"throughput": "double", "wait": "bigint", "transfer": "bigint",
                         "device_duration": "bigint", "device_bytes": "bigint"}.items():
        if column not in both.columns:
            both = both.withColumn(column, F.lit(None).cast(kind))
    return (
        _with_layer(both)
        .na.drop(subset=LAYER_KEYS)
        .repartition(*STEP_KEYS)
        .groupBy(*_SORTED_KEYS)
        .agg(
            F.count("spans").alias("spans"),
            F.count("works").alias("works"),
            _first_span("globalTid", "duration").alias("_first"),
            F.sum("duration").alias("host_duration_sum"),
            F.sum("bytes").alias("host_bytes"),
            F.sum("send_bytes").alias("send_bytes"),
            F.sum("recv_bytes").alias("recv_bytes"),
            F.sum("device_duration").alias("device_duration"),
            F.sum("device_bytes").alias("device_bytes"),
            F.avg("throughput").alias("throughput"),
            F.sum("wait").alias("wait"),
            F.sum("transfer").alias("transfer"),
        )
        .filter((F.col("spans") > 0) & (F.col("works") > 0))
        .withColumns({"globalTid": F.col("_first.globalTid"), "host_duration": F.col("_first.duration")})
        .drop("spans", "works", "_first")
    )


def layer_parts(
    spans: DataFrame, inference: DataFrame, sizes: DataFrame, calls: DataFrame, tasks: int | None = None
) -> DataFrame:
    """Host and device side of every layer, added up as far as its rows are in one task.

    ``spans`` are those of the events, with their bytes, ``calls`` those with the device
    work they started. Spans, steps and calls are each shuffled once, by thread and time;
    what is shuffled after that are these parts, few for a layer. Kernels of a
    communication are told apart, as how long each waited is not known yet. Events are
    numbers in the order of ``EVENT_CALLS``.
    """
    codes = _literal_map({event: n for n, event in enumerate(_EVENTS)})[F.col("event_name")]
    named = _with_layer(spans).withColumn("event", codes.cast("tinyint"))
    owners = named.select(
        "run_id", "globalTid", "start", "end", "send_bytes", "recv_bytes", "bytes", "event", "layer"
    )
    kinds = call_codes({n: EVENT_CALLS[event] for n, event in enumerate(_EVENTS)})
    owners = owners.withColumn("kind", kinds[F.col("event").cast("int")].cast("tinyint"))
    timed = calls.withColumn("inner_end", F.col("inner_start") + F.col("inner_length")).drop("inner_length")
    found = contained_chain(
        timed, owners, inference, sizes, ["run_id", "globalTid"], ["kind"], STEP_COLUMNS, tasks
    )
    work = F.col("inner_start").isNotNull()
    shared = work & (F.col("event") == _EVENTS.index("communication"))
    device = work & ~shared
    rate = F.when(device, per_second(F.col("work_bytes"), F.col("work_duration")))
    keys = ["step_id", "run_id", "globalTid", *PLACE, "rank", "local_rank", "event", "layer"]
    return (
        found.withColumns(
            {
                "kernel_start": F.when(shared, work_time("apart")),
                "kernel_duration": F.when(shared, F.col("work_duration")),
            }
        )
        .groupBy(*keys, "kernel_start", "kernel_duration")
        .agg(
            F.count(F.when(work, 1)).alias("works"),
            F.min(F.when(~work, F.struct("start", "end"))).alias("first"),
            F.sum(F.when(~work, F.col("end") - F.col("start"))).alias("duration_sum"),
            *[F.sum(F.when(~work, F.col(c))).alias(c) for c in ("bytes", "send_bytes", "recv_bytes")],
            F.sum(F.when(device, F.col("work_duration"))).alias("device_duration"),
            F.sum(F.when(device, F.col("work_bytes"))).alias("device_bytes"),
            F.sum(rate).alias("rates"),
            F.count(rate).alias("rated"),
        )
        # what the parts of a worker's step have in common stands together, and takes little room so
        .select(
            "step_id", "run_id", "globalTid", "rank", "local_rank", "works", "rated", "send_bytes",
            "recv_bytes", "bytes", "device_bytes", F.col("first.start").alias("first_start"),
            (F.col("first.end") - F.col("first.start")).alias("first_duration"), "duration_sum",
            "device_duration", "rates", "kernel_start", "kernel_duration", "event", "layer",
        )
    )


def layers_of_parts(parts: DataFrame, tasks: int | None = None) -> DataFrame:
    """``layer_stats`` from their parts, placed by step for all that follows.

    The last start of a communication is looked up among the parts of its step: kernels
    are not shuffled for it again. One sort serves that and the sums.
    """
    layer = ["step_id", "run_id", "event", "layer"]
    keys = [*layer, "rank", "local_rank"]
    joined = F.max("kernel_start").over(Window.partitionBy(*layer))
    start, end = F.col("kernel_start"), F.col("kernel_start") + F.col("kernel_duration")
    early = end <= F.col("_joined")
    names = _literal_map(dict(enumerate(_EVENTS)))
    return (
        parts.repartition(*([tasks] if tasks else []), "run_id", "step_id")
        .sortWithinPartitions(*keys)
        .withColumn("_joined", joined)
        .na.drop(subset=keys)
        .withColumns(
            {
                "wait": F.when(early, F.lit(0)).otherwise(F.col("_joined") - start) * F.col("works"),
                "transfer": F.when(early, F.col("kernel_duration")).otherwise(end - F.col("_joined"))
                * F.col("works"),
                "_first": F.when(
                    F.col("first_start").isNotNull(),
                    F.struct("first_start", "first_duration", "globalTid"),
                ),
            }
        )
        .groupBy(*keys)
        .agg(
            F.sum("works").alias("works"),
            F.min("_first").alias("_first"),
            F.sum("duration_sum").alias("host_duration_sum"),
            F.sum("bytes").alias("host_bytes"),
            F.sum("send_bytes").alias("send_bytes"),
            F.sum("recv_bytes").alias("recv_bytes"),
            F.sum("device_duration").alias("device_duration"),
            F.sum("device_bytes").alias("device_bytes"),
            F.try_divide(F.sum("rates"), F.sum("rated")).alias("throughput"),
            F.sum("wait").alias("wait"),
            F.sum("transfer").alias("transfer"),
        )
        # work is inside a span of its layer, so there is one
        .filter(F.col("works") > 0)
        .withColumns(
            {
                "event_name": names[F.col("event").cast("int")],
                "globalTid": F.col("_first.globalTid"),
                "host_duration": F.col("_first.first_duration"),
            }
        )
        .drop("event", "works", "_first")
    )


_HOST = ["host_duration", "host_duration_sum"]


def _layer_of(stats: DataFrame, event: str, *columns) -> DataFrame:
    return stats.filter(F.col("event_name") == event).select(*STEP_KEYS, "globalTid", *columns)


def step_input_stats(stats: DataFrame) -> DataFrame:
    return _layer_of(
        stats, "input", *_HOST, "host_bytes", "device_duration", "device_bytes", "throughput"
    )


def step_output_stats(stats: DataFrame) -> DataFrame:
    return _layer_of(
        stats, "output", *_HOST, "host_bytes", "device_duration", "device_bytes", "throughput"
    )


def step_compute_stats(stats: DataFrame) -> DataFrame:
    return _layer_of(
        stats, "compute", "event_name", F.col("layer").alias("event_value"),
        F.col("host_bytes").alias("weights"), *_HOST, "device_duration",
    )


def step_communication_wait_stats(stats: DataFrame) -> DataFrame:
    return _layer_of(
        stats, "communication", *_HOST, "send_bytes", "recv_bytes",
        F.col("wait").alias("device_duration"),
    )


def step_communication_transfer_stats(stats: DataFrame) -> DataFrame:
    return _layer_of(
        stats, "communication", *_HOST, "send_bytes", "recv_bytes",
        F.col("transfer").alias("device_duration"),
    )


def step_inference_stats(inference: DataFrame) -> DataFrame:
    return inference.select(
        "run_id", "step_id", "batch_size", "rank", "local_rank", "globalTid",
        F.col("start").alias("host_start"),
        F.col("end").alias("host_end"),
        F.col("duration").alias("host_duration"),
    )
