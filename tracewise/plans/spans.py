"""Selection of spans: inference steps and what happened inside them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.functions.payload import decode_payload, tensor_bytes, tensors_bytes
from tracewise.functions.scalars import duration, process_of, thread_id
from tracewise.operators.containment import contained_in
from tracewise.schemas import PUSH_POP_RANGE

STEP_COLUMNS = ["step_id", "rank", "local_rank"]
POSITION = ["globalTid", "pid", "tid"]


def _span_keys(bounded: bool) -> list[str]:
    """Keys of spans of one thread. Its process follows from it, but tables can be placed by that."""
    return ["run_id", "pid", "globalTid"] if bounded else ["run_id", "globalTid"]


def _push_pop(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("eventType") == PUSH_POP_RANGE)


def decode_spans(spans: DataFrame) -> DataFrame:
    """Every span with its ids unpacked and its text decoded.

    The decoded text is the one row of a generator: a filter on it stays above, where
    Spark would else decode the text for the filter and again for the result.
    """
    decoded = spans.select("*", F.explode(F.array(decode_payload(F.col("text")))).alias("payload"))
    return decoded.select(
        "run_id",
        "globalTid",
        process_of(spans).alias("pid"),
        thread_id("globalTid").alias("tid"),
        "eventType",
        "start",
        "end",
        duration().alias("duration"),
        F.col("payload.event").alias("event_name"),
        F.col("payload.name").alias("event_value"),
        F.col("payload.step").alias("step_id"),
        "payload.rank",
        "payload.local_rank",
        "payload.batch_size",
        "payload.tensor",
        "payload.weights",
        "payload.send_tensors",
        "payload.recv_tensors",
        F.col("text").alias("event"),
    )


def _mentions(text: Column, *events: str) -> Column:
    """Whether a text can mean one of the events: without the word it takes a JSON escape."""
    return reduce(or_, [text.contains(event) for event in events]) | text.contains("\\")


def step_inference_range(spans: DataFrame) -> DataFrame:
    """One row per inference step and worker."""
    # Most spans are dropped before their JSON is parsed.
    candidates = _push_pop(spans).filter(_mentions(F.col("text"), "inference"))
    return (
        decode_spans(candidates)
        .filter(F.col("event_name") == "inference")
        .select(
            "run_id", *STEP_COLUMNS, *POSITION, "event_name", "event_value", "batch_size",
            "start", "end", "duration",
        )
    )


def _with_position(inside: DataFrame) -> DataFrame:
    """Rows with what follows from other columns, which is not shuffled; rows in buckets have ``pid``."""
    derived = {"pid": process_of(inside), "tid": thread_id("globalTid"), "duration": duration()}
    return inside.withColumns(derived)


def _in_step(
    spans: DataFrame, inference: DataFrame, *extra: str, bounded: bool = False, large: bool = False
) -> DataFrame:
    decoded = decode_spans(_push_pop(spans).filter(F.col("text") != ""))
    keys = _span_keys(bounded)
    inner = decoded.select(*keys, "event_name", "event_value", "start", "end", *extra)
    return _with_position(contained_in(inner, inference, keys, STEP_COLUMNS, bounded, large))


def step_range(
    spans: DataFrame, inference: DataFrame, bounded: bool = False, large: bool = False
) -> DataFrame:
    """Every span inside an inference step, at any depth, with its text."""
    return _in_step(spans, inference, "event", bounded=bounded, large=large).select(
        "run_id", *STEP_COLUMNS, *POSITION, "event_name", "event_value", "event",
        "start", "end", "duration",
    )


def _range_of(steps: DataFrame, event: str, *fields: str) -> DataFrame:
    value = ["event_value"] if event in ("compute", "communication") else []
    wanted = _mentions(F.col("event"), event) & (F.col("event_name") == event)
    return steps.filter(wanted).select(
        "run_id", *STEP_COLUMNS, *POSITION, "start", "end", "duration", "event_name", *value,
        *[F.get_json_object("event", f"$.{f}").alias(f) for f in fields],
    )


def step_input_range(steps: DataFrame) -> DataFrame:
    return _range_of(steps, "input", "tensor")


def step_output_range(steps: DataFrame) -> DataFrame:
    return _range_of(steps, "output", "tensor")


def step_compute_range(steps: DataFrame) -> DataFrame:
    return _range_of(steps, "compute", "weights")


def step_communication_range(steps: DataFrame) -> DataFrame:
    return _range_of(steps, "communication", "send_tensors", "recv_tensors")


def _texts(spans: DataFrame, events: Sequence[str] | None = None) -> DataFrame:
    """Spans with a text, that can mean one of the events if these are given."""
    texts = _push_pop(spans).filter(F.col("text") != "")
    return texts if events is None else texts.filter(_mentions(F.col("text"), *events))


def sizes(spans: DataFrame, events: Sequence[str]) -> DataFrame:
    """When the spans that can mean one of the events start and end; no JSON is parsed."""
    return _texts(spans, events).select("start", "end")


def sized_spans(spans: DataFrame, keys: Sequence[str], events: Sequence[str] | None = None) -> DataFrame:
    """Spans with the bytes their text describes instead of the text."""
    decoded = decode_spans(_texts(spans, events))
    if events is not None:
        decoded = decoded.filter(F.col("event_name").isin(*events))
    event = F.col("event_name")
    return decoded.select(
        *keys, "event_name", "event_value", "start", "end",
        F.when(event.isin("input", "output"), tensor_bytes(F.col("tensor")))
        .when(event == "compute", tensors_bytes(F.col("weights")))
        .alias("bytes"),
        F.when(event == "communication", tensors_bytes(F.col("send_tensors"))).alias("send_bytes"),
        F.when(event == "communication", tensors_bytes(F.col("recv_tensors"))).alias("recv_bytes"),
    )


def step_spans(
    spans: DataFrame,
    inference: DataFrame,
    bounded: bool = False,
    events: Sequence[str] | None = None,
    large: bool = False,
) -> DataFrame:
    """``step_range`` with the bytes its text describes instead of the text.

    ``bytes`` is the tensor of an input or output and the weights of a compute
    span. Sizes are computed before the join, so the text is never shuffled.
    With ``events``, other spans are left out before their JSON is parsed.
    """
    keys = _span_keys(bounded)
    inner = sized_spans(spans, keys, events)
    inside = contained_in(inner, inference, keys, STEP_COLUMNS, bounded, large)
    return _with_position(inside).select(
        "run_id", *STEP_COLUMNS, *POSITION, "event_name", "event_value", "start", "end",
        "duration", "bytes", "send_bytes", "recv_bytes",
    )
