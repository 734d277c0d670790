"""Host API calls inside spans, and the device work they started."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.functions.scalars import _literal_map, duration, per_second, process_id, process_of, thread_id
from tracewise.operators.containment import contained_in
from tracewise.plans.spans import POSITION, STEP_COLUMNS
from tracewise.schemas import CALL_PATTERNS, EVENT_CALLS

STEP = ["run_id", *STEP_COLUMNS]
EVENT = ["event_name", "event_value"]


def call_names(string_ids: DataFrame) -> DataFrame:
    """Names of the calls that start device work, one row per kind they match."""
    kinds = [
        F.when(F.col("value").ilike(pattern), F.lit(kind))
        for kind, pattern in CALL_PATTERNS.items()
    ]
    wanted = [F.col("value").ilike(pattern) for pattern in CALL_PATTERNS.values()]
    return string_ids.filter(reduce(or_, wanted)).select(
        "run_id",
        F.col("id").alias("nameId"),
        F.col("value").alias("function_name"),
        F.explode(F.array_compact(F.array(*kinds))).alias("call_kind"),
    )


def _kinds(events: Sequence[str]) -> list[str]:
    return sorted({EVENT_CALLS[event] for event in events})


def call_codes(kinds: dict) -> Column:
    """A map from its keys to small numbers for their kinds of calls."""
    every = _kinds(EVENT_CALLS)
    return _literal_map({key: every.index(kind) for key, kind in kinds.items()})


def step_runtime(
    steps: DataFrame,
    runtime: DataFrame,
    string_ids: DataFrame,
    bounded: bool = False,
    events: Sequence[str] = tuple(EVENT_CALLS),
    large: bool = False,
    names: DataFrame | None = None,
) -> DataFrame:
    """Host calls inside input, compute, communication and output spans.

    The calls of all four in one join: copies for input and output, kernel
    launches for compute and communication. The kind is part of the join key.
    With fewer ``events``, calls of a kind that none of them has are not joined.
    ``names`` is ``call_names`` of the string ids if it is known already.
    """
    names = call_names(string_ids) if names is None else names
    names = names.filter(F.col("call_kind").isin(*_kinds(events)))
    calls = runtime.join(names, ["run_id", "nameId"]).select(
        "run_id", process_of(runtime).alias("pid"), "globalTid", "call_kind", "start", "end",
        "correlationId", "function_name",
    )
    # a thread has one process, which is not shuffled unless rows are placed by it
    keys = ["run_id", "pid", "globalTid", "call_kind"] if bounded else ["run_id", "globalTid", "call_kind"]
    wanted = {event: EVENT_CALLS[event] for event in events}
    owners = steps.withColumn("call_kind", _literal_map(wanted)[F.col("event_name")]).filter(
        F.col("call_kind").isNotNull()
    )
    inside = contained_in(
        calls if bounded else calls.drop("pid"), owners, keys, [*STEP_COLUMNS, *EVENT], bounded, large
    )
    return inside.withColumns({"pid": process_of(inside), "tid": thread_id("globalTid")}).select(
        *STEP, *POSITION, *EVENT, "start", "end", "correlationId", "function_name", "call_kind"
    )


def timed_calls(
    runtime: DataFrame, names: DataFrame, kernels: DataFrame, copies: DataFrame
) -> DataFrame:
    """Host calls with the device work they started, wherever they are.

    A call's times are ``inner_start`` and ``inner_length``, its kind is a number, and
    ``apart`` is its work's start as ``work_time`` has it: what follows a time takes less
    room than another time.
    """
    kinds = _kinds(EVENT_CALLS)
    code = call_codes({kind: kind for kind in kinds})[F.col("call_kind")].cast("tinyint")
    calls = runtime.join(names, ["run_id", "nameId"]).select(
        F.col("start").alias("inner_start"), duration().alias("inner_length"), "correlationId", "run_id",
        "globalTid", code.alias("kind"),
    )

    def activity(df, kind, size):
        return df.select(
            F.col("start").alias("work_start"),
            duration().alias("work_duration"),
            F.col("correlationId").alias("_correlationId"),
            F.col("run_id").alias("_run_id"),
            process_of(df).alias("_pid"),
            F.lit(kinds.index(kind)).cast("tinyint").alias("_kind"),
            size.alias("work_bytes"),
        )

    works = activity(kernels, "launch", F.lit(None).cast("bigint")).unionByName(
        activity(copies, "copy", F.col("bytes"))
    )
    # in this order the calls of a thread come together, and take less room
    same = (
        (F.col("run_id") == F.col("_run_id")) & (process_id("globalTid") == F.col("_pid"))
        & (F.col("kind") == F.col("_kind")) & (F.col("correlationId") == F.col("_correlationId"))
    )
    return calls.join(works.hint("merge"), same).select(
        "inner_start", "inner_length", work_time("work_start").alias("apart"),
        "work_duration", "run_id", "globalTid", "kind", "work_bytes",
    )


def work_time(time: str) -> Column:
    """``work_start`` by the bits in which it differs from its call's start, or back from these."""
    return F.col(time).bitwiseXOR(F.col("inner_start"))


def runtime_of(calls: DataFrame, event: str) -> DataFrame:
    value = ["event_value"] if event in ("compute", "communication") else []
    return calls.filter(F.col("event_name") == event).select(
        *STEP, *POSITION, "event_name", *value, "start", "end", "correlationId", "function_name"
    )


def step_device(
    calls: DataFrame,
    kernels: DataFrame,
    copies: DataFrame,
    bounded: bool = False,
    events: Sequence[str] = tuple(EVENT_CALLS),
    large: bool = False,
) -> DataFrame:
    """Device kernels and copies started by the calls, with the call's step and event.

    With ``bounded``, partitions of the calls are known to fit in memory, and both
    kinds are joined where they are. With fewer ``events``, only the kinds that their
    calls start are joined.
    """

    def activity(df, kind, size):
        return df.select(
            "run_id",
            process_of(df).alias("pid"),
            "correlationId",
            F.lit(kind).alias("call_kind"),
            "start",
            "end",
            size.alias("bytes"),
        )

    by_kind = {
        "launch": lambda: activity(kernels, "launch", F.lit(None).cast("bigint")),
        "copy": lambda: activity(copies, "copy", F.col("bytes")),
    }
    works = [by_kind[kind]() for kind in _kinds(events)]
    started = calls.select(*STEP, *POSITION, *EVENT, "correlationId", "function_name", "call_kind")
    keys = ["run_id", "pid", "call_kind", "correlationId"]
    if bounded:  # a union would give up the place of its rows
        hashed = started.hint("shuffle_hash")
        joined = reduce(DataFrame.unionByName, [work.join(hashed, keys) for work in works])
    else:
        work = reduce(DataFrame.unionByName, works)
        joined = started.join(work.hint("merge") if large else work, keys)
    return joined.select(
        *STEP, *POSITION, *EVENT, "function_name", "correlationId", "start", "end", "bytes",
        duration().alias("duration"),
        per_second(F.col("bytes"), duration()).alias("throughput"),
    )


def step_input_kernel(device: DataFrame) -> DataFrame:
    return device.filter(F.col("event_name") == "input").select(
        *STEP, *POSITION, "function_name", "event_name", "bytes", "correlationId", "duration",
        "throughput",
    )


def step_output_kernel(device: DataFrame) -> DataFrame:
    return device.filter(F.col("event_name") == "output").select(
        *STEP, "globalTid", "event_name", "bytes", "duration", "throughput"
    )


def step_compute_kernel(device: DataFrame) -> DataFrame:
    return device.filter(F.col("event_name") == "compute").select(
        *STEP, "globalTid", *EVENT, "function_name", "duration"
    )


def step_communication_kernel(device: DataFrame) -> DataFrame:
    return device.filter(F.col("event_name") == "communication").select(
        *STEP, "globalTid", *EVENT, "start", "end", "duration"
    )


def transfer_start(kernels: DataFrame) -> DataFrame:
    """When the last worker joined each communication."""
    return kernels.groupBy("run_id", "step_id", *EVENT).agg(F.max("start").alias("start"))


def split_wait(kernels: DataFrame) -> DataFrame:
    """Communication kernels with their time before and after the last worker joined.

    A kernel that ended by then had nothing to wait for. The start is found by
    an aggregation that combines before its shuffle and is joined back. The keys
    are joined as one struct: the aggregation is not distributed by that, so both
    sides of the join are shuffled for it and adaptive execution can split a
    communication with very many kernels. The other side has one row for each.
    """
    keys = ["run_id", "step_id", *EVENT]
    # A struct with a NULL equals itself, unlike the NULL.
    known = kernels.na.drop(subset=keys)
    joined = transfer_start(known).select(
        F.struct(*keys).alias("_communication"), F.col("start").alias("joined")
    )
    early = F.col("end") <= F.col("joined")
    return known.withColumn("_communication", F.struct(*keys)).join(joined, "_communication").select(
        *STEP, "globalTid", *EVENT, "start",
        F.when(early, F.lit(0)).otherwise(F.col("joined") - F.col("start")).alias("wait"),
        F.when(early, F.col("end") - F.col("start"))
        .otherwise(F.col("end") - F.col("joined"))
        .alias("transfer"),
    )


def step_communication_wait_kernel(kernels: DataFrame) -> DataFrame:
    return split_wait(kernels).select(*STEP, "globalTid", *EVENT, F.col("wait").alias("duration"))


def step_communication_transfer_kernel(kernels: DataFrame) -> DataFrame:
    return split_wait(kernels).select(
        *STEP, "globalTid", *EVENT, F.col("transfer").alias("duration")
    )
