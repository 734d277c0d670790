"""Trace tables derived from the orders and events tables.

Every order is one worker's part of one step: 4 workers, 5 runs. The formulas
are in FIXTURES.md; ``oracle.py`` has the same ones for DuckDB.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.schemas import SCHEMAS, TraceTables
from tracewise.session import Staging
from tracewise.sources.layout import read_layout, write_layout

_WEIGHTS = '[[[64, 32], "float16"], [[32], "float16"]]'

# slot: (event, name, workers that have it, JSON fields after the name)
_SLOTS = {
    0: ("input", "input", "true", """'"tensor": [[', bs * 128, '], "float16"]'"""),
    1: ("input", "input", "rk > 0", """'"tensor": [[', bs, '], "int32"]'"""),
    2: ("compute", "bottom_mlp", "rk = 0", f"""'"weights": {_WEIGHTS}'"""),
    3: ("compute", "embedding", "rk > 0", f"""'"weights": {_WEIGHTS}'"""),
    4: ("compute", "embedding", "rk > 0", f"""'"weights": {_WEIGHTS}'"""),
    5: (
        "communication", "all_to_all", "true",
        """'"send_tensors": [[[', bs, ', 32], "float16"]], "recv_tensors": [[[', bs,"""
        """ ', 32], "float16"], [[0], "float16"]]'""",
    ),
    6: ("compute", "interaction", "rk < bs", """'"weights": []'"""),
    7: ("compute", "top_mlp", "rk < bs", f"""'"weights": {_WEIGHTS}'"""),
    8: ("output", "output", "rk < bs", """'"tensor": [[', bs, '], "float16"]'"""),
}


# One order becomes some 30 rows of trace.
_ORDERS_PER_TASK = 50_000


def _workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    # A small table is a single split, and the rows of a task must not grow with a large one.
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(orders.count() / _ORDERS_PER_TASK))
    return (
        orders.repartition(tasks)
        .selectExpr(
            "o_orderkey AS k",
            "o_orderkey % 4 AS rk",
            "o_orderkey div 4 % 5 AS run_id",
            "o_orderkey div 20 AS step",
        )
        .selectExpr(
            "*",
            "shiftleft(1L, cast(run_id AS int)) AS bs",
            "step * 10000000 + rk * 5000 + (k * 7919) % 3000 + 1000000 AS t0",
            "(1000 + rk) * 16777216 + (1000 + rk) AS globalTid",
            "(1000 + rk) * 16777216 AS globalPid",
        )
    )


def _step_spans(workers: DataFrame) -> DataFrame:
    """The spans of every worker's step: the step itself as slot -1, then what is in it."""
    allowed = " ".join(f"WHEN {n} THEN {w}" for n, (_, _, w, _) in _SLOTS.items())
    text = " ".join(
        f"""WHEN {n} THEN concat('{{"event": "{event}", "name": "{name}", ', {fields}, '}}')"""
        for n, (event, name, _, fields) in _SLOTS.items()
    )
    inference = """concat('{"event": "inference", "name": "inference", "rank": ', rk,
        ', "local_rank": ', rk, ', "step": ', step, ', "batch_size": ', bs, '}')"""
    return (
        workers.selectExpr("*", "explode(sequence(-1L, 8L)) AS slot")
        .filter(f"CASE slot {allowed} ELSE true END")
        .selectExpr("*", "if(slot < 0, t0, t0 + 1000 + slot * 900000) AS s")
        .selectExpr(
            "*",
            "if(slot < 0, t0 + 9000000, s + 200000 + (k * 104729 + slot * 1299709) % 500000) AS e",
            f"CASE slot WHEN -1 THEN {inference} {text} END AS text",
        )
    )


def _as(table: str, df: DataFrame, *expressions: str) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in SCHEMAS[table].fields}
    types["run_id"] = "bigint"
    df = df.selectExpr(*expressions)
    return df.select(*[F.col(c).cast(types[c]) for c in types])


def trace_tables(spark: SparkSession, sf_dir: str) -> TraceTables:
    """The derived tables as lazy plans."""
    workers = _workers(spark, sf_dir)
    spans_of_steps = _step_spans(workers)
    inner = spans_of_steps.filter("slot >= 0")

    # With decoys inside the first slot and the sixth.
    spans = spans_of_steps.selectExpr(
        "run_id", "globalTid",
        """explode(CASE slot
             WHEN 0 THEN array(
               named_struct('type', 59, 's', s, 'e', e, 'text', text),
               named_struct('type', 34, 's', s + 5, 'e', s + 6, 'text', '{"event": "input"}'),
               named_struct('type', 59, 's', s + 5, 'e', s + 6, 'text', cast(NULL AS string)))
             WHEN 5 THEN array(
               named_struct('type', 59, 's', s, 'e', e, 'text', text),
               named_struct('type', 59, 's', s + 7, 'e', s + 8, 'text', ''))
             ELSE array(named_struct('type', 59, 's', s, 'e', e, 'text', text))
           END) AS span""",
    )
    spans = _as("spans", spans, "run_id", "globalTid", "span.type AS eventType", "span.s AS start",
                "span.e AS end", "span.text")

    calls = inner.selectExpr(
        "*",
        """explode(CASE slot
             WHEN 7 THEN array(
               named_struct('s', s + 10000, 'e', s + 20000, 'c', k * 64 + slot * 4, 'n', 2),
               named_struct('s', s + 40000, 'e', s + 50000, 'c', k * 64 + slot * 4 + 1, 'n', 2),
               named_struct('s', s + 30000, 'e', s + 35000, 'c', k * 64 + slot * 4 + 2, 'n', 3))
             ELSE array(
               named_struct('s', s + 10000, 'e', s + 20000, 'c', k * 64 + slot * 4,
                            'n', if(slot IN (0, 1, 8), 1, 2)),
               named_struct('s', s + 30000, 'e', s + 35000, 'c', k * 64 + slot * 4 + 2, 'n', 3))
           END) AS call""",
    )
    runtime = _as("runtime", calls, "run_id", "globalTid", "call.s AS start", "call.e AS end",
                  "call.c AS correlationId", "call.n AS nameId")
    kernels = _as(
        "kernels",
        calls.filter("call.n = 2").selectExpr(
            "*", "call.e + 50000 + if(slot = 5, (k * 15485863) % 400000, 0) AS ks"
        ),
        "run_id", "globalPid", "ks AS start",
        "ks + 100000 + (k * 32452843 + slot * 17) % 300000 AS end",
        "call.c AS correlationId",
    )
    copies = _as(
        "copies",
        calls.filter("call.n = 1"),
        "run_id", "globalPid", "call.e + 1000 AS start",
        "call.e + 1000 + 20000 + (k * 31) % 9000 AS end",
        "call.c AS correlationId",
        "CASE slot WHEN 0 THEN bs * 128 * 2 WHEN 1 THEN bs * 4 ELSE bs * 2 END AS bytes",
    )
    names = _as(
        "string_ids",
        workers.select("run_id").distinct().selectExpr(
            "run_id",
            """explode(array(
                 named_struct('id', 1, 'value', 'cudaMemcpyAsync_v3020'),
                 named_struct('id', 2, 'value', 'cudaLaunchKernel_v7000'),
                 named_struct('id', 3, 'value', 'cudaStreamSynchronize_v3020'))) AS n""",
        ),
        "run_id", "n.id", "n.value",
    )
    power = _as(
        "power",
        spark.read.parquet(f"{sf_dir}/events.parquet"),
        "event_id % 5 AS run_id", "event_id div 5 AS sample_idx",
        "concat('GPU-', user_id % 4) AS gpu_uuid", "value AS watts",
    )
    return TraceTables(spans, runtime, kernels, copies, names, power)


def staged_tables(spark: SparkSession, sf_dir: str, staging: Staging) -> TraceTables:
    """The derived tables saved in their layout, as recorded traces would be."""
    tables = trace_tables(spark, sf_dir)
    plain = TraceTables(
        **{name: staging.table(f"trace_{name}", getattr(tables, name)) for name in SCHEMAS}
    )
    root = f"{staging.root}/layout-{uuid.uuid4().hex[:8]}"
    write_layout(plain, root)
    return read_layout(spark, root)
