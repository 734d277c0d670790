"""The scalar functions of trace analysis for SQL, as SQL functions: Spark inlines them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewise.schemas import DTYPE_BYTES, EVENT_TYPES

# The names that queries over traces know them by.
EVENT_TYPE_NAME, NAME_OF_ID = "nvtx_event_map", "string_map"
TENSOR_BYTES, TENSORS_BYTES = "tensor_to_bytes", "tensors_to_bytes"


def _map(values: dict) -> str:
    return "map(" + ", ".join(f"'{k}', {v}" if isinstance(k, str) else f"{k}, '{v}'" for k, v in values.items()) + ")"


def _bytes(tensor: str) -> str:
    """Bytes of a tensor given as an array of two texts: 0 if it is empty, NULL for an unknown type."""
    elements = f"aggregate(from_json(get({tensor}, 0), 'array<bigint>'), 1L, (n, d) -> n * d)"
    return f"CASE WHEN size({tensor}) = 0 THEN 0L ELSE {elements} * {_map(DTYPE_BYTES)}[get({tensor}, 1)] END"


def register_functions(spark: SparkSession, string_ids: DataFrame | None = None) -> None:
    """Make the functions available to ``spark.sql``.

    ``tensor_to_bytes`` and ``tensors_to_bytes`` take JSON text, ``nvtx_event_map``
    a span type; unknown ones are NULL. With ``string_ids``, ``string_map`` takes
    a run and a name id, as all runs are in one table; it becomes a left join.
    """
    functions = {
        f"{EVENT_TYPE_NAME}(code INT) RETURNS STRING": f"{_map(EVENT_TYPES)}[code]",
        f"{TENSOR_BYTES}(tensor STRING) RETURNS BIGINT": _bytes("from_json(tensor, 'array<string>')"),
        f"{TENSORS_BYTES}(tensors STRING) RETURNS BIGINT": (
            "aggregate(from_json(tensors, 'array<array<string>>'), 0L, "
            f"(total, t) -> total + {_bytes('t')})"
        ),
    }
    if string_ids is not None:
        string_ids.createOrReplaceTempView("string_ids")
        run = string_ids.schema["run_id"].dataType.simpleString()
        functions[f"{NAME_OF_ID}(run {run}, name_id INT) RETURNS STRING"] = (
            f"(SELECT min(value) FROM string_ids s WHERE s.run_id = {NAME_OF_ID}.run AND s.id = {NAME_OF_ID}.name_id)"
        )
    for signature, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
