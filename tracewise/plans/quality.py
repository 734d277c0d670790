"""Checks of the data: row counts between stages, and what could not be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.functions.payload import decode_payload, tensor_bytes, tensors_bytes
from tracewise.plans.calls import split_wait
from tracewise.schemas import EVENT_TYPES, PUSH_POP_RANGE

EVENTS = ["input", "output", "communication"]
# (event, stage) pairs whose row count must equal the event's span count.
_CHECKS = [
    ("input", "runtime"),
    ("input", "kernel"),
    ("output", "runtime"),
    ("output", "kernel"),
    ("communication", "runtime"),
    ("communication", "kernel"),
    ("communication", "wait_kernel"),
    ("communication", "transfer_kernel"),
]


def quality_checks(
    spans: DataFrame, steps: DataFrame, calls: DataFrame, device: DataFrame
) -> DataFrame:
    """One row per run and check: expected and actual rows, and whether they agree.

    Every run with a span has all checks, whatever was found in it.
    """
    def counts(df: DataFrame, stage: str) -> DataFrame:
        return (
            df.filter(F.col("event_name").isin(EVENTS))
            .groupBy("run_id", "event_name")
            .agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("stage", F.lit(stage))
        )

    split = split_wait(device.filter(F.col("event_name") == "communication"))
    none = spans.select("run_id").distinct().selectExpr(
        "run_id", "cast(NULL AS string) AS event_name", "0L AS rows", "'run' AS stage"
    )
    found = (
        none.unionByName(counts(steps, "range"))
        .unionByName(counts(calls, "runtime"))
        .unionByName(counts(device, "kernel"))
        .unionByName(counts(split.filter("wait IS NOT NULL"), "wait_kernel"))
        .unionByName(counts(split.filter("transfer IS NOT NULL"), "transfer_kernel"))
    )

    def rows(event: str, stage: str):
        wanted = (F.col("event_name") == event) & (F.col("stage") == stage)
        return F.coalesce(F.sum(F.when(wanted, F.col("rows"))), F.lit(0))

    def check(event: str, stage: str):
        return F.struct(
            F.lit(f"step_{event}_{stage}").alias("check"),
            rows(event, "range").alias("expected"),
            rows(event, stage).alias("actual"),
        )

    return (
        found.groupBy("run_id")
        .agg(F.array(*[check(e, s) for e, s in _CHECKS]).alias("checks"))
        .select("run_id", F.inline("checks"))
        .withColumn("passed", F.col("expected") == F.col("actual"))
    )


def decode_quality(spans: DataFrame, runtime: DataFrame, string_ids: DataFrame) -> DataFrame:
    """Per run, the rows the analysis cannot use or understand."""
    ranges = spans.withColumn("payload", decode_payload(F.col("text")))
    push_pop = F.col("eventType") == PUSH_POP_RANGE
    event = F.col("payload.event")
    unknown_size = (
        (event.isin("input", "output") & tensor_bytes(F.col("payload.tensor")).isNull())
        | ((event == "compute") & tensors_bytes(F.col("payload.weights")).isNull())
        | (
            (event == "communication")
            & (
                tensors_bytes(F.col("payload.send_tensors")).isNull()
                | tensors_bytes(F.col("payload.recv_tensors")).isNull()
            )
        )
    )
    # Missing, or not whole numbers.
    unusable_ids = (event == "inference") & (
        F.col("payload.step").isNull()
        | F.col("payload.rank").isNull()
        | F.col("payload.local_rank").isNull()
        | F.col("payload.batch_size").isNull()
    )
    text = F.col("text")
    of_spans = ranges.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if(~F.col("eventType").isin(list(EVENT_TYPES))).alias("unknown_event_type"),
        F.count_if(push_pop & (text.isNull() | (text == ""))).alias("empty_text"),
        F.count_if(push_pop & (text != "") & F.try_parse_json(text).isNull()).alias(
            "malformed_text"
        ),
        F.count_if(push_pop & unknown_size).alias("unknown_tensor_size"),
        F.count_if(push_pop & unusable_ids).alias("unusable_ids"),
        F.count_if(F.col("end").isNull()).alias("open_spans"),
        F.count_if(F.col("end") < F.col("start")).alias("reversed_spans"),
    )
    # Calls are counted per name before the names are looked up.
    names = string_ids.select("run_id", F.col("id").alias("nameId"), F.lit(True).alias("known"))
    of_calls = (
        runtime.groupBy("run_id", "nameId")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if(F.col("end") < F.col("start")).alias("reversed_calls"),
        )
        .join(names, ["run_id", "nameId"], "left")
        .groupBy("run_id")
        .agg(
            F.sum("calls").alias("calls"),
            F.sum(F.when(F.col("known").isNull(), F.col("calls")).otherwise(0)).alias(
                "unknown_name"
            ),
            F.sum("reversed_calls").alias("reversed_calls"),
        )
    )
    return of_spans.join(of_calls, "run_id", "full_outer").na.fill(0)
