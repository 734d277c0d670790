"""The layout for joins: same results, no shuffle of the rows, and none for hot processes."""

import re

import pytest

from tracewise.plans.analysis import TraceAnalysis
from tracewise.session import Staging
from tracewise.sources import layout
from tracewise.sources.traces import read_trace

from conftest import SF


@pytest.fixture(scope="module")
def plain(spark):
    from entry.fixture import trace_tables

    staging = Staging(spark)
    tables = trace_tables(spark, SF)
    from tracewise.schemas import SCHEMAS, TraceTables

    yield TraceTables(**{n: staging.table(n, getattr(tables, n)) for n in SCHEMAS})
    staging.close()


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin)", plan)


@pytest.fixture
def no_broadcast(spark):
    """Small tables would be broadcast, and nothing be learned from the plan; names alone are here."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joins_of_laid_out_tables_do_not_shuffle(spark, plain, staging, no_broadcast):
    layout.write_layout(plain, f"{staging.root}/laid")
    tables = read_trace(spark, f"{staging.root}/laid")
    assert tables.buckets > 0
    for kept in (None, staging):  # as one plan, and with every join's result written
        found, usual = TraceAnalysis(tables, kept), TraceAnalysis(plain)
        for name in ("step_range", "step_compute_runtime", "step_compute_kernel", "step_input_kernel"):
            view = found.view(name)
            assert rows(view) == rows(usual.view(name))
            assert shuffles(view) == [], name
        for shared in (found.step_spans, found.step_calls, found.step_device):
            assert shuffles(shared) == []
    assert shuffles(usual.view("step_compute_kernel"))
    assert rows(found.worker_stats) == rows(usual.worker_stats)
    assert rows(found.decode_quality()) == rows(usual.decode_quality())
    assert rows(found.quality_checks()) == rows(usual.quality_checks())


def test_a_hot_process_gets_no_bucket(spark, plain, staging):
    assert layout.choose_buckets(plain) >= spark.sparkContext.defaultParallelism
    assert layout.choose_buckets(plain, rows_per_bucket=500) == 0  # 20 processes, some hundred buckets
    layout.write_layout(plain, f"{staging.root}/hot", buckets=0)
    tables = read_trace(spark, f"{staging.root}/hot")
    assert tables.buckets == 0
    assert rows(TraceAnalysis(tables, staging).view("step_compute_kernel")) == rows(
        TraceAnalysis(plain).view("step_compute_kernel")
    )


def test_a_layout_without_its_description_is_none(spark, plain, staging):
    root = f"{staging.root}/part"
    plain.spans.write.parquet(f"{root}/spans")
    assert not layout.is_layout(spark, root)
    with pytest.raises(ValueError, match="exists"):
        layout.write_layout(plain, root)


def test_null_keys_and_empty_tables(spark, make, staging):
    from tracewise.schemas import TraceTables

    text = '{"event": "inference", "name": "inference", "rank": 0, "local_rank": 0, "step": 1, "batch_size": 2}'
    inner = '{"event": "compute", "name": "top_mlp", "weights": []}'
    spans = make("spans", [("r", 1 << 24, 59, 0, 100, text), ("r", 1 << 24, 59, 10, 20, inner),
                           (None, 1 << 24, 59, 0, 100, text), ("r", None, 59, 1, 2, inner)])
    tables = TraceTables(spans, *(make(t) for t in ("runtime", "kernels", "copies", "string_ids")))
    layout.write_layout(tables, f"{staging.root}/null")
    found = TraceAnalysis(read_trace(spark, f"{staging.root}/null"), staging)
    assert rows(found.view("step_range")) == rows(TraceAnalysis(tables).view("step_range"))
    assert found.view("step_compute_kernel").collect() == []


def test_closing_forgets_the_names(spark, plain):
    staging = Staging(spark)
    before = len(spark.catalog.listTables())
    layout.write_layout(plain, f"{staging.root}/laid", buckets=8)
    tables = layout.read_layout(spark, f"{staging.root}/laid")
    analysis = TraceAnalysis(tables, staging)
    assert analysis.step_spans.count()
    staging.close()
    assert len(spark.catalog.listTables()) == before + 4  # the four tables of the layout itself
