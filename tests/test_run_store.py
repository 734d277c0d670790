"""Runs that are added later, and jobs that end early."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_sources import POWER, RUNS, folder, run_rows, write_sqlite  # noqa: F401
from tracewise.plans import run_store
from tracewise.plans.report_job import run_report
from tracewise.plans.reports import REPORTS
from tracewise.plans.run_store import add_runs, current_version, store_table
from tracewise.sources.traces import read_trace, write_trace

ALL = {**RUNS, "m_2_16": run_rows("m_2_16", 16)}


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("*") if p.is_file()}


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def same_results(spark, store, full):
    for name in ("worker_stats", "system_stats"):
        assert rows_of(store_table(spark, store, name)) == rows_of(spark.read.parquet(f"{full}/{name}"))
    for name in REPORTS:
        a, b = (spark.read.csv(f"{root}/{name}.csv", header=True) for root in (current_version(spark, store)["reports"], full))
        assert a.columns == b.columns and rows_of(a) == rows_of(b)


def test_added_runs_equal_a_full_job_and_change_no_file(spark, folder, tmp_path, monkeypatch):  # noqa: F811
    store, full = str(tmp_path / "store"), str(tmp_path / "full")
    assert current_version(spark, store) is None
    assert add_runs(spark, str(folder), store) == 2
    first, before = current_version(spark, store), files(store)
    assert add_runs(spark, str(folder), store) == 0 and files(store) == before

    write_sqlite(folder / "m_2_16.sqlite", ALL["m_2_16"])
    (folder / "m_2_16_power_draw.csv").write_text(POWER)
    # the runs that are there are not even read
    (folder / "m_2_1.sqlite").write_bytes(b"not a database")
    assert add_runs(spark, str(folder), store) == 1
    assert {k: v for k, v in files(store).items() if k in before} == before
    write_sqlite_again(folder / "m_2_1.sqlite", RUNS["m_2_1"])
    run_report(spark, str(folder), full)
    same_results(spark, store, full)
    # an older version still reads as it did
    assert store_table(spark, store, "system_stats", first).select("run_id").distinct().count() == 2


def write_sqlite_again(path, rows):
    path.unlink()
    write_sqlite(path, rows)


def test_runs_computed_again_take_the_place_of_the_old_ones(spark, folder, tmp_path, monkeypatch):  # noqa: F811
    store, full, saved = (str(tmp_path / x) for x in ("store", "full", "saved"))
    assert add_runs(spark, str(folder), store) == 2
    (folder / "m_2_8_power_draw.csv").write_text("GPU-a,GPU-b\n100.0,200.0\n")
    write_trace(read_trace(spark, str(folder)), saved)
    monkeypatch.setattr(run_store, "NAMED_RUNS", 1)  # as for many new runs
    assert add_runs(spark, saved, store, again=True) == 2
    run_report(spark, saved, full)
    same_results(spark, store, full)
    assert store_table(spark, store, "system_stats").filter(F.col("run_id") == "m_2_8").count() == 2


def test_a_job_that_ends_early_leaves_the_store_as_it_was(spark, folder, tmp_path, monkeypatch):  # noqa: F811
    store = str(tmp_path / "store")
    add_runs(spark, str(folder), store)
    before, version = files(store), current_version(spark, store)
    write_sqlite(folder / "m_2_16.sqlite", ALL["m_2_16"])
    (folder / "m_2_16_power_draw.csv").write_text("1.0\n" + POWER)
    with pytest.raises(ValueError, match="power samples"):
        add_runs(spark, str(folder), store)
    assert files(store) == before

    # stopped without cleaning up, before the version is written and while it is
    def stopped(*_):
        raise KeyboardInterrupt

    (folder / "m_2_16_power_draw.csv").write_text(POWER)
    with monkeypatch.context() as m:
        m.setattr(run_store, "_commit", stopped)
        m.setattr(run_store, "delete_path", lambda *_: None)
        with pytest.raises(KeyboardInterrupt):
            add_runs(spark, str(folder), store)
    assert current_version(spark, store) == version
    (tmp_path / "store" / "versions" / "000000002.json").write_text('{"number": 2, "batch')
    assert current_version(spark, store) == version
    assert store_table(spark, store, "system_stats").select("run_id").distinct().count() == 2
    assert add_runs(spark, str(folder), store) == 1
    assert current_version(spark, store)["number"] == 3
    assert store_table(spark, store, "system_stats").select("run_id").distinct().count() == 3


def test_two_jobs_at_once_and_wrong_places(spark, folder, tmp_path):  # noqa: F811
    store = str(tmp_path / "store")
    add_runs(spark, str(folder), store)
    late = {**current_version(spark, store), "skipped": []}
    with pytest.raises(ValueError, match="another job"):
        run_store._commit(spark, store, late)
    with pytest.raises(ValueError, match="does not exist"):
        add_runs(spark, str(tmp_path / "none"), store)
    with pytest.raises(ValueError, match="overlap"):
        add_runs(spark, str(folder), str(folder / "store"))
    with pytest.raises(ValueError, match="no runs"):
        store_table(spark, str(tmp_path / "empty"), "system_stats")
