import re

import pytest
from pyspark.sql import functions as F
from test_calls import GID, NAMES, TID, span, step

from tracewise.operators.lookup import last_step, string_lookup
from tracewise.plans.analysis import TraceAnalysis
from tracewise.plans.report_job import require_quality
from tracewise.plans.reports import REPORTS
from tracewise.plans.worker import OFFLINE_PARTS, PARTS


def test_wait_and_transfer_make_up_the_kernel(traces):
    a = traces
    total = lambda name: a.view(name).agg(F.sum("duration")).first()[0]
    assert total("step_communication_wait_kernel") + total(
        "step_communication_transfer_kernel"
    ) == total("step_communication_kernel")


@pytest.mark.parametrize(("scenario", "parts"), [("server", PARTS), ("offline", OFFLINE_PARTS)])
def test_worker_shares_add_up(traces, scenario, parts):
    total = sum(F.col(f"{scenario}_{p}_percentage") for p in parts)
    off = traces.worker_stats.filter(F.abs(total - 100) > 1e-9)
    assert off.count() == 0


def test_system_sums_are_sums_of_workers(traces):
    w, s = traces.worker_stats, traces.system_stats
    for ours, theirs in (
        ("device_duration", "device_duration_sum"),
        ("input_device_bytes", "input_bytes"),
        ("embedding_weights", "embedding_weights"),
    ):
        assert w.agg(F.sum(ours)).first()[0] == s.agg(F.sum(theirs)).first()[0]


def test_staged_and_lazy_results_agree(traces):
    lazy = TraceAnalysis(traces.tables).system_stats
    staged = traces.system_stats
    columns = staged.columns
    assert sorted(map(tuple, lazy.select(columns).collect())) == sorted(
        map(tuple, staged.collect())
    )


def test_views_can_be_queried_by_name(traces, spark):
    traces.create_views()
    assert len(TraceAnalysis.view_names()) == 32
    rows = spark.sql(
        "SELECT count(*) FROM step_inference_stats JOIN worker_stats USING (run_id, step_id, rank)"
    ).first()[0]
    assert rows == 1500


def test_a_layer_without_kernels_counts_as_absent(analyse):
    weights = [[[4], "float32"]]
    a = analyse(
        spans=[
            step(),
            span(10, 100, event="compute", name="top_mlp", weights=weights),
            span(200, 300, event="compute", name="bottom_mlp", weights=weights),
            span(210, 220, event="compute", name="bottom_mlp", weights=weights),
            span(400, 500, event="compute", name="concatenation", weights=weights),
        ],
        runtime=[("r", TID, 205, 208, 1, 2), ("r", TID, 410, 420, 2, 2)],
        string_ids=NAMES,
        kernels=[("r", GID, 600, 650, 1), ("r", GID, 700, 790, 2)],
        power=[("r", 0, "GPU-a", 10.0), ("r", 1, "GPU-a", 30.0), ("r", 0, "GPU-b", 20.0)],
    )
    row = a.worker_stats.first()
    assert (row["top_mlp_weights"], row["top_mlp_host_duration"]) == (0, 0)
    # Two spans: bytes add up, the time is that of the first one.
    assert (row["bottom_mlp_weights"], row["bottom_mlp_host_duration"]) == (32, 100)
    # Concatenation is in no total.
    assert row["bottom_mlp_device_duration"] == row["device_duration"] == 50
    assert row["input_throughput"] == 0.0 and row["communication_throughput"] == 0.0
    system = a.system_stats.first()
    assert system["ips"] == 4 / (1000 * 1e-9)
    assert system["ipw"] == system["ips"] / 50.0
    assert system["input_throughput"] is None


def test_two_communications_of_a_step_add_up(analyse):
    send = [[[8], "float32"]]
    a = analyse(
        spans=[
            step(),
            span(10, 100, event="communication", name="x", send_tensors=send, recv_tensors=[]),
            span(200, 300, event="communication", name="y", send_tensors=send, recv_tensors=send),
        ],
        runtime=[("r", TID, 20, 30, 1, 2), ("r", TID, 210, 220, 2, 2)],
        string_ids=NAMES,
        kernels=[("r", GID, 40, 50, 1), ("r", GID, 230, 250, 2)],
    )
    (row,) = a.worker_stats.collect()
    assert row["communication_send_bytes"] == 64 and row["communication_recv_bytes"] == 32
    assert row["communication_transfer_device_duration"] == 30


def test_last_step_over_all_runs_or_per_run(analyse):
    a = analyse(spans=[step(number=0), step(2000, 3000, number=1), step(run="q", number=0)])
    w = a.worker_stats
    assert {(r["run_id"], r["step_id"]) for r in last_step(w).collect()} == {("r", 1)}
    assert {(r["run_id"], r["step_id"]) for r in last_step(w, per_run=True).collect()} == {
        ("r", 1), ("q", 0),
    }


def test_reports_are_ordered_and_complete(traces):
    for name, report in REPORTS.items():
        rows = traces.report(name).collect()
        assert list(rows[0].asDict()) == report.columns
        keys = [r[: 2 if report.level == "worker" else 1] for r in rows]
        assert keys == sorted(keys) and len(rows) == (20 if report.level == "worker" else 5)


def test_string_lookup_keeps_unknown_ids(make):
    calls = make("runtime", [("r", 1, 0, 1, 0, 1), ("r", 1, 0, 1, 1, 9), ("q", 1, 0, 1, 2, 1)])
    named = string_lookup(calls, make("string_ids", NAMES), "nameId", "name")
    assert {(r["correlationId"], r["name"]) for r in named.collect()} == {
        (0, "cudamemcpyasync"), (1, None), (2, None),
    }


def test_quality(analyse, traces):
    a = analyse(
        spans=[
            step(),
            span(10, 100, event="input", name="input", tensor=[[2], "float64"]),
            span(200, 300, event="input", name="input", tensor=[[2], "float16"]),
            ("r", TID, 59, 1, 2, "{"),
            ("r", TID, 59, 1, None, ""),
            ("r", TID, 77, 5, 2, None),
        ],
        runtime=[("r", TID, 20, 30, 1, 1), ("r", TID, 40, 30, 2, 99)],
        string_ids=NAMES,
        copies=[("r", GID, 40, 50, 1, 100)],
    )
    decoded = a.decode_quality().first().asDict()
    assert decoded == {
        "run_id": "r", "spans": 6, "unknown_event_type": 1, "empty_text": 1, "malformed_text": 1,
        "unknown_tensor_size": 1, "unusable_ids": 0, "open_spans": 1, "reversed_spans": 1, "calls": 2,
        "unknown_name": 1, "reversed_calls": 1,
    }
    checks = {r["check"]: (r["expected"], r["actual"], r["passed"]) for r in a.quality_checks().collect()}
    assert checks["step_input_runtime"] == (2, 1, False)
    assert checks["step_output_kernel"] == (0, 0, True)
    with pytest.raises(ValueError, match="row counts"):
        require_quality(a.quality_checks(), a.decode_quality())
    with pytest.raises(ValueError, match="unreadable"):
        require_quality(traces.quality_checks(), a.decode_quality())
    require_quality(traces.quality_checks(), traces.decode_quality())


def test_runs_without_spans_in_steps_have_all_checks(analyse):
    a = analyse(spans=[step(), span(10, 20, event="compute", name="top_mlp", weights=[]), step(run="q")])
    rows = a.quality_checks().collect()
    assert sorted({r["run_id"] for r in rows}) == ["q", "r"] and len(rows) == 16
    assert all((r["expected"], r["actual"], r["passed"]) == (0, 0, True) for r in rows)


def test_lost_transfer_rows_fail_a_check(analyse, monkeypatch):
    """The counts are those of the split itself, so a fault in it shows."""
    from tracewise.plans import quality

    a = analyse(
        spans=[step(), span(10, 100, event="communication", name="x", send_tensors=[], recv_tensors=[])],
        runtime=[("r", TID, 20, 30, 1, 2)],
        string_ids=NAMES,
        kernels=[("r", GID, 40, 50, 1)],
    )
    assert a.quality_checks().filter("NOT passed").count() == 0
    right = quality.split_wait
    broken = lambda kernels: right(kernels).withColumn("transfer", F.lit(None).cast("bigint"))
    monkeypatch.setattr(quality, "split_wait", broken)
    failed = a.quality_checks().filter("NOT passed").collect()
    assert [r["check"] for r in failed] == ["step_communication_transfer_kernel"]


def test_ids_of_another_type_are_counted(analyse):
    bad = '{"event": "inference", "step": "zero", "rank": 0, "local_rank": 0, "batch_size": 2}'
    a = analyse(spans=[step(number=0), ("r", TID, 59, 5000, 6000, bad)])
    assert a.decode_quality().first()["unusable_ids"] == 1
    assert sorted(str(r["step_id"]) for r in a.worker_stats.collect()) == ["0", "None"]
    with pytest.raises(ValueError, match="unreadable"):
        require_quality(a.quality_checks(), a.decode_quality())


def test_plan_prunes_and_pushes_down(traces):
    plan = traces.view("step_inference_range")._jdf.queryExecution().executedPlan().toString()
    assert "Parquet" in plan
    from tracewise.plans.spans import step_inference_range

    df = step_inference_range(traces.tables.spans).select("run_id", "step_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(eventType,59)" in plan and "BatchEvalPython" not in plan
    compute = traces.view("step_compute_host_stats")
    plan = compute._jdf.queryExecution().executedPlan().toString()
    # The filter on the event is below both parts of the aggregation.
    below = plan.rsplit("Aggregate", 1)[1]
    assert len(re.findall(r"\b(?:Hash|Sort)Aggregate\b", plan)) == 2 and re.search(r"event_name#\d+ = compute", below)
