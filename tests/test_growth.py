"""What queries write and join does not depend on guesses, and grows with the tables."""

import math
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from entry import fixture, queries
from tracewise.plans import analysis as analysis_module
from tracewise.plans import worker
from tracewise.plans.analysis import TraceAnalysis


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders of five steps, one of them twice, and one without a key."""
    root = str(tmp_path_factory.mktemp("tables"))
    keys = [(k,) for k in [*range(100), 7, None]]
    spark.createDataFrame(keys, "o_orderkey bigint").write.parquet(f"{root}/orders.parquet")
    events = [(n, n % 3, float(n)) for n in range(40)]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, value double").write.parquet(
        f"{root}/events.parquet"
    )
    return root


def written(spark):
    return {os.path.join(at, f) for at, _, files in os.walk(queries.staging(spark).root) for f in files}


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_query_that_reads_a_table_once_saves_none(spark, folder):
    before = written(spark)
    for name in ("api_like", "decode_spans", "decode_quality", "copy_throughput"):
        assert queries.all_queries()[name](spark, folder).count() > 0
    assert written(spark) == before


def test_rows_of_a_task_do_not_grow_with_the_orders(spark, folder, monkeypatch):
    usual = fixture.trace_tables(spark, folder).kernels
    assert usual.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(fixture, "_ORDERS_PER_TASK", 4)
    many = fixture.trace_tables(spark, folder).kernels
    assert many.rdd.getNumPartitions() == 26
    assert rows(many) == rows(usual)


@pytest.mark.parametrize(
    "name",
    ["step_compute_runtime", "step_compute_kernel", "step_communication_wait_kernel", "step_input_stats",
     "step_output_device_stats", "step_communication_transfer_stats", "step_communication_range"],
)
def test_a_view_of_one_event_equals_that_of_all(spark, folder, name):
    whole = TraceAnalysis(fixture.trace_tables(spark, folder))
    assert rows(queries.analysis(spark, folder).view(name)) == rows(whole.view(name)) != []


def test_only_names_are_broadcast_to_joins_of_all_steps(spark, folder):
    a = queries.analysis(spark, folder)
    assert "BroadcastHashJoin" not in plan_of(a.view("step_compute_range"))
    assert plan_of(a.view("step_compute_kernel")).count("BroadcastHashJoin") == 1


def test_results_of_all_events_and_of_the_last_step(spark, folder):
    whole, narrow = TraceAnalysis(fixture.trace_tables(spark, folder)), queries.analysis(spark, folder)
    assert rows(narrow.system_stats) == rows(whole.system_stats)
    assert rows(narrow.quality_checks()) == rows(whole.quality_checks())
    for per_run in (False, True):
        for name in ("system_ips", "worker_io"):
            assert rows(narrow.report(name, per_run)) == rows(whole.report(name, per_run)) != []
    # nothing of other steps was joined for the reports
    steps = narrow._last[False].step_spans
    last = whole.inference.agg(F.max("step_id")).first()[0]
    assert {r["step_id"] for r in steps.select("step_id").collect()} == {last}


def test_single_results_write_only_what_they_read_twice(spark, folder):
    queries.analysis.cache_clear()
    before = written(spark)
    a = queries.analysis(spark, folder)
    for result in (a.view("step_compute_stats"), a.worker_stats, a.system_stats):
        assert result.count() > 0
    new = {os.path.basename(os.path.dirname(f)).rsplit("-", 1)[0] for f in written(spark) - before}
    assert new == {"inference", "step_spans", "call_names", "timed_device"}
    assert not any("timed_device" in f for f in a._of_event("compute").timed_device.inputFiles())


@pytest.mark.parametrize("name", ["step_communication_runtime", "step_communication_transfer_device_stats"])
def test_calls_and_device_work_save_no_sizes_of_spans(spark, folder, name):
    queries.analysis.cache_clear()
    before = written(spark)
    found = queries.analysis(spark, folder).view(name)
    assert rows(found) == rows(TraceAnalysis(fixture.trace_tables(spark, folder)).view(name)) != []
    new = {os.path.dirname(f) for f in written(spark) - before if "/step_spans-" in f}
    assert len(new) == 1
    assert not {"bytes", "send_bytes", "recv_bytes"} & set(spark.read.parquet(*new).columns)


def test_the_text_of_a_span_is_decoded_once(spark, folder):
    steps = queries.analysis(spark, folder).view("step_inference_range")
    whole = TraceAnalysis(fixture.trace_tables(spark, folder)).view("step_inference_range")
    assert rows(steps) == rows(whole) != []
    assert plan_of(whole).count("from_json") == 1


def test_the_size_of_the_call_names_is_known(spark, folder):
    """Of tables that are plans Spark guesses the size, and it has broadcast the calls instead."""
    names = queries.analysis(spark, folder).call_names
    assert all("call_names" in f for f in names.inputFiles())
    plan = plan_of(queries.analysis(spark, folder).view("step_input_runtime"))
    built = plan[plan.index("BroadcastExchange"):].split("Exchange hashpartitioning")[0]
    assert "FileScan parquet" in built and "function_name" in built and "correlationId" not in built


def test_layers_of_workers_are_placed_once(spark, folder):
    a = queries.analysis(spark, folder)
    placed = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(a.worker_stats))
    assert placed and not any("globalTid" in keys and "rank" in keys for keys in placed)


def test_layers_of_another_thread_are_not_a_workers(spark):
    steps = spark.createDataFrame(
        [("r", 0, 1, 0, 0, thread, 0, 9, 9) for thread in (1, 2, None)],
        "run_id string, step_id int, batch_size int, rank int, local_rank int, globalTid long,"
        " host_start long, host_end long, host_duration long",
    )
    layers = spark.createDataFrame(
        [("r", 0, 0, 0, thread, size) for thread, size in ((1, 10), (3, 30), (None, 50))],
        "run_id string, step_id int, rank int, local_rank int, globalTid long, size long",
    )
    found = worker._with_layers(steps, layers)
    assert found.columns[:5] == ["run_id", "step_id", "rank", "local_rank", "globalTid"]
    assert {(r["globalTid"], r["size"]) for r in found.collect()} == {(1, 10), (2, None), (None, None)}


def test_spans_steps_and_calls_are_shuffled_once(spark, folder):
    """Before, spans and calls were shuffled for each of three joins, and device work three times more."""
    a = queries.analysis(spark, folder)
    for result, most in ((a.layer_parts, 3), (a.worker_stats, 5), (a.system_stats, 7)):
        placed = re.findall(r"Exchange hashpartitioning\((.*)", plan_of(result))
        # then the parts, the steps where they are not broadcast, and for the system two of power samples
        assert 3 <= len(placed) <= most
        assert not any(re.search("correlationId|kernel_start|event_name", keys) for keys in placed)


def test_what_was_shuffled_for_a_written_table_goes_with_its_job(spark, folder):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        blocks = manager.getAllBlocks()
        return {str(blocks.apply(n)) for n in range(blocks.size()) if str(blocks.apply(n)).startswith("shuffle")}

    queries.analysis.cache_clear()
    a = queries.analysis(spark, folder)
    a.inference, a.call_names
    before = shuffled()
    assert all("timed_device" in f for f in a.timed_calls.inputFiles())
    until = time.time() + 20
    while shuffled() - before and time.time() < until:  # they are deleted in the background
        time.sleep(0.2)
    assert not shuffled() - before


def odd_traces(spark, make):
    """Two workers of a step, and steps, spans, calls and kernels that are not as they should be."""
    from tracewise.schemas import SCHEMAS, TraceTables

    def tid(process):
        return process << 24 | 1

    def step(rank, number=0):
        return f'{{"event": "inference", "name": "inference", "rank": {rank}, "local_rank": {rank},' \
               f' "step": {number}, "batch_size": 4}}'

    shared = '{"event": "communication", "name": "all_to_all", "send_tensors": [[[4], "int32"]], "recv_tensors": []}'
    mlp = '{"event": "compute", "name": "bottom_mlp", "weights": [[[8], "float16"]]}'
    copied = '{"event": "input", "name": "input", "tensor": [[16], "float32"]}'
    spans, runtime, kernels, copies = [], [], [], []
    for process, (rank, number) in enumerate([(0, 0), (1, 0), ("null", 0), (0, 0), (2, "null"), (3, 1)], 1):
        t, at = tid(process), process * 7
        spans += [("r", t, 59, 0, 100_000, step(rank, number)), ("r", t, 59, 10 + at, 20_000, shared),
                  ("r", t, 59, 10 + at, 15_000, shared), ("r", t, 59, 30_000, 40_000, mlp),
                  ("r", t, 59, 30_000, 39_000, mlp), ("r", t, 59, 45_000, 45_000, mlp),
                  ("r", t, 59, 50_000, 60_000, copied), ("r", t, 59, 52_000, 58_000, copied),
                  ("r", t, 59, 70_000, 71_000, '{"event": "compute", "weights": []}'),
                  ("r", t, 59, 80_000, 90_000, '{"event": "output", "name": "output", "tensor": []}')]
        for n, (start, name) in enumerate([(100, 2), (200, 2), (16_000, 2), (31_000, 2), (53_000, 1), (54_000, 1),
                                           (70_500, 2), (95_000, 2), (81_000, 2), (31_500, 4)]):
            runtime.append(("r", t, start, start + 50, n, name))
            work = ("r", process << 24, start + 500 + at * n, start + 900 + at * n + rank_of(rank), n)
            copies.append((*work, 64)) if name == 1 else kernels.append(work)
        kernels += [("r", process << 24, None, 5, 0), ("r", process << 24, 700, None, 1), kernels[-1]]
    names = [("r", 1, "cudaMemcpyAsync"), ("r", 2, "cudaLaunchKernel"), ("r", 4, "MemcpyLaunchKernel")]
    rows = {"spans": spans + spans[:3], "runtime": runtime + runtime[:1], "kernels": kernels, "copies": copies,
            "string_ids": names, "power": [("r", 0, "g", 100.0)]}
    return TraceTables(**{name: make(name, rows[name]) for name in SCHEMAS})


def rank_of(rank):
    return rank if isinstance(rank, int) else 9


def test_worker_and_system_stats_of_odd_traces(spark, make, staging):
    """Shared results take the joins one by one; a result alone equals them."""
    tables = odd_traces(spark, make)
    whole, alone = TraceAnalysis(tables, staging), TraceAnalysis(tables, staging, share=False)
    for name in ("worker_stats", "system_stats"):
        assert rows(getattr(alone, name)) == rows(getattr(whole, name)) != []
    workers = alone.worker_stats.collect()
    assert any(r["communication_wait_device_duration"] for r in workers)
    assert any(r["input_throughput"] for r in workers)


def test_tasks_grow_with_the_calls(spark, folder, monkeypatch):
    monkeypatch.setattr(analysis_module, "_ROWS_PER_TASK", 50)
    queries.analysis.cache_clear()
    many = queries.analysis(spark, folder)
    assert many._tasks == math.ceil((many.timed_calls.count() + many.inference.count()) / 50) > 4
    assert rows(many.system_stats) == rows(TraceAnalysis(fixture.trace_tables(spark, folder)).system_stats)
    queries.analysis.cache_clear()
