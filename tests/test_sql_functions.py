"""The scalar functions from SQL, against the same in the DataFrame API."""

import pytest

from tracewise.functions.sql import register_functions


@pytest.mark.parametrize(
    "call, value",
    [
        ("""tensor_to_bytes('[[2, 3], "float16"]')""", 12),
        ("tensor_to_bytes('[]')", 0),
        ("""tensor_to_bytes('[[], "float32"]')""", 4),
        ("""tensor_to_bytes('[[0], "int32"]')""", 0),
        ("""tensor_to_bytes('[[2], "int64"]')""", None),
        ("tensor_to_bytes(NULL)", None),
        ("""tensors_to_bytes('[[[2, 3], "float16"], [[4], "int32"]]')""", 28),
        ("tensors_to_bytes('[]')", 0),
        ("""tensors_to_bytes('[[[2], "float16"], [[4], "int64"]]')""", None),
        ("nvtx_event_map(59)", "NvtxPushPopRange"),
        ("nvtx_event_map(1)", None),
    ],
)
def test_functions(spark, call, value):
    register_functions(spark)
    assert spark.sql(f"SELECT {call}").first()[0] == value


def test_functions_on_views_equal_the_queries(spark, traces):
    traces.create_views()
    inputs = spark.sql("SELECT run_id, tid, start, tensor_to_bytes(tensor) AS bytes FROM step_input_range")
    weights = spark.sql(
        "SELECT run_id, step_id, rank, event_value, sum(tensors_to_bytes(weights)) AS weights"
        " FROM step_compute_range GROUP BY ALL"
    )
    for df in (inputs, weights):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    sent = {(r.run_id, r.step_id, r.rank, r.event_value): r.weights for r in traces.view("step_compute_stats").collect()}
    assert sent == {(r.run_id, r.step_id, r.rank, r.event_value): r.weights for r in weights.collect()}
    bytes_of_inputs = sum(r.host_bytes for r in traces.view("step_input_stats").collect())
    assert bytes_of_inputs == sum(r.bytes for r in inputs.collect())
    names = spark.sql("SELECT string_map(run_id, nameId) AS name, count(*) AS calls FROM runtime GROUP BY ALL")
    assert sum(r.calls for r in names.collect()) == traces.tables.runtime.count()
    assert {r.name for r in names.collect()} == {r.value for r in traces.tables.string_ids.collect()}
    assert spark.sql("SELECT string_map(0L, 77)").first()[0] is None
