import json

from tracewise.plans import calls
from tracewise.operators.lookup import string_lookup
from tracewise.plans.calls import call_names, split_wait

PID = 5
GID = PID << 24
TID = GID | 9


def span(start, end, run="r", tid=TID, kind=59, **payload):
    return (run, tid, kind, start, end, json.dumps(payload))


def step(start=0, end=1000, run="r", rank=0, number=0, batch=4, tid=TID):
    return span(start, end, run, tid, event="inference", name="inference", rank=rank,
                local_rank=rank, step=number, batch_size=batch)


NAMES = [("r", 1, "cudamemcpyasync"), ("r", 2, "cudaLaunchKernel_v7000"), ("r", 3, "cudaFree")]


def test_calls_go_to_spans_of_their_kind(analyse):
    a = analyse(
        spans=[
            step(),
            span(10, 100, event="input", name="input", tensor=[[2], "float16"]),
            span(200, 300, event="compute", name="top_mlp", weights=[]),
        ],
        runtime=[
            ("r", TID, 20, 30, 1, 1),  # copy in input, by a name in lower case
            ("r", TID, 40, 50, 2, 2),  # launch in input
            ("r", TID, 210, 220, 3, 2),  # launch in compute
            ("r", TID, 230, 240, 4, 1),  # copy in compute
            ("r", TID, 250, 260, 5, 3),  # neither
            ("r", TID, 270, 280, 6, 99),  # name unknown
            ("r", TID, 10, 30, 7, 1),  # touches the span's start
            ("r", TID + 1, 20, 30, 8, 1),  # other thread
            ("q", TID, 20, 30, 9, 1),  # other run
        ],
        string_ids=NAMES + [("q", 1, "cudaMemcpy")],
    )
    got = {(r["event_name"], r["correlationId"], r["function_name"]) for r in a.step_calls.collect()}
    assert got == {("input", 1, "cudamemcpyasync"), ("compute", 3, "cudaLaunchKernel_v7000")}
    assert [r["correlationId"] for r in a.view("step_input_runtime").collect()] == [1]


def test_a_name_of_both_kinds_counts_for_both(make):
    names = calls.call_names(make("string_ids", [("r", 1, "MemcpyLaunchKernel"), ("r", 2, None)]))
    assert {(r["nameId"], r["call_kind"]) for r in names.collect()} == {(1, "copy"), (1, "launch")}


def test_device_work_is_matched_by_run_process_and_correlation(analyse):
    a = analyse(
        spans=[step(), span(10, 100, event="input", name="input", tensor=[[2], "float16"])],
        runtime=[("r", TID, 20, 30, 1, 1)],
        string_ids=NAMES,
        copies=[
            ("r", GID, 40, 50, 1, 100),
            ("r", GID, 60, 60, 1, 7),  # no time: no throughput
            ("r", GID + (1 << 24), 40, 50, 1, 1),
            ("q", GID, 40, 50, 1, 1),
            ("r", GID, 40, 50, 2, 1),
        ],
        kernels=[("r", GID, 40, 50, 1)],
    )
    rows = {r["bytes"]: r["throughput"] for r in a.view("step_input_kernel").collect()}
    assert rows == {100: 100 / (10 * 1e-9), 7: None}
    stats = a.view("step_input_stats").collect()
    assert [(r["device_bytes"], r["device_duration"], r["host_bytes"]) for r in stats] == [(107, 10, 4)]


KERNEL = (
    "run_id string, step_id bigint, rank bigint, local_rank bigint, globalTid bigint,"
    " event_name string, event_value string, start bigint, end bigint, duration bigint"
)


def kernels(spark, *rows):
    return spark.createDataFrame(
        [("r", s, rank, rank, rank, "communication", v, a, b, b - a) for s, rank, v, a, b in rows],
        KERNEL,
    )


def test_wait_and_transfer(spark):
    df = kernels(
        spark,
        (1, 0, "x", 10, 50),  # starts early: waits until 30
        (1, 1, "x", 30, 60),  # the last to start
        (1, 2, "x", 5, 30),  # ends when the last one starts: all transfer
        (1, 0, "y", 7, 9),  # another communication of the step
        (2, 0, "x", 100, 130),  # alone
        (2, 0, None, 1, 2),  # without a name: not matched
    )
    got = sorted(
        (r["step_id"], r["rank"], r["event_value"], r["wait"], r["transfer"])
        for r in split_wait(df).collect()
    )
    assert got == [
        (1, 0, "x", 20, 20), (1, 0, "y", 0, 2), (1, 1, "x", 0, 30), (1, 2, "x", 0, 25),
        (2, 0, "x", 0, 30),
    ]


def test_a_hot_communication_is_split(spark):
    """Three quarters of the kernels in one communication: the join is split and complete."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 60_000, numPartitions=8).selectExpr(
            "concat('r', if(id % 4 < 3, 0, id % 7)) AS run_id",
            "if(id % 4 < 3, 1, id % 50) AS step_id", "id AS rank", "id AS local_rank",
            "id AS globalTid", "'communication' AS event_name",
            "if(id % 4 < 3, 'x', concat('v', id % 3)) AS event_value",
            "id % 1000 AS start", "id % 1000 + 5 + id % 700 AS end", "5 + id % 700 AS duration",
        )
        result = split_wait(df)
        rows = result.collect()
        plan = result._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan
    data = df.toPandas()
    joined = data.groupby(["run_id", "step_id", "event_value"])["start"].transform("max")
    data["wait"] = (joined - data.start).where(data.end > joined, 0)
    data["transfer"] = data.duration - data.wait
    assert sorted((r["rank"], r["wait"], r["transfer"]) for r in rows) == sorted(
        zip(data["rank"], data.wait, data.transfer, strict=True)
    )


def test_long_names_are_not_broadcast(spark, make):
    """The size of the names counts, not their number, and planning runs no job."""
    names = spark.range(3000).selectExpr(
        "'r' AS run_id", "cast(id AS int) AS id", "repeat(concat('cudaLaunchKernel', id), 500) AS value"
    )
    calls = make("runtime", [("r", TID, 0, 1, n, n) for n in range(50)])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10k")
    try:
        named = calls.join(call_names(names), ["run_id", "nameId"])
        plan = named._jdf.queryExecution().executedPlan().toString()
        looked_up = string_lookup(calls, names, "nameId", "name")
        other = looked_up._jdf.queryExecution().executedPlan().toString()
        assert named.count() == looked_up.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan and "Broadcast" not in other


def test_the_first_span_does_not_depend_on_the_order_of_rows(analyse):
    spans = [
        step(),
        span(10, 100, event="input", name="input", tensor=[[2], "float16"]),
        span(10, 50, event="input", name="input", tensor=[[2], "float16"]),
    ]
    for rows in (spans, spans[::-1]):
        host = analyse(spans=rows).view("step_input_host_stats").collect()
        assert [(r["duration"], r["duration_sum"]) for r in host] == [(40, 130)]


def test_spans_survive_bad_text_and_escapes(analyse):
    a = analyse(
        spans=[
            ("r", TID, 59, 0, 1000,
             '{"event": "\\u0069nference", "step": 3, "rank": 0, "local_rank": 0, "batch_size": 2}'),
            ("r", TID, 59, 10, 20, "not json"),
            ("r", TID, 59, 30, 40, ""),
            ("r", TID, 59, 50, 60, None),
            ("r", TID, 34, 70, 80, '{"event": "input"}'),
            ("r", TID, 59, 5, None, '{"event": "input"}'),
        ],
    )
    assert [r["step_id"] for r in a.inference.collect()] == [3]
    assert [(r["start"], r["event_name"]) for r in a.view("step_range").collect()] == [(10, None)]


def test_an_open_step_is_kept(analyse):
    a = analyse(spans=[step(end=None)])
    row = a.worker_stats.first()
    assert row["host_duration"] == 0 and row["batch_size"] == 4
    assert a.view("step_inference_range").first()["duration"] is None
