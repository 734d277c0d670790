"""The whole job: read traces, check, compute, write reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.operators.lookup import last_step, left_out_runs
from tracewise.plans.analysis import TraceAnalysis
from tracewise.plans.reports import REPORTS, report_table
from tracewise.session import Staging, delete_path, path_exists
from tracewise.sources.layout import read_layout, write_layout
from tracewise.sources.inventory import discover_runs, require_complete, run_inventory
from tracewise.sources.power import POWER_FAULTS, power_quality
from tracewise.sources.sinks import check_output, replace_output, write_report, write_table
from tracewise.sources.traces import is_parquet_trace, read_trace

_UNREADABLE = [
    "unknown_event_type", "malformed_text", "unknown_tensor_size", "unusable_ids", "unknown_name",
]


def require_quality(checks: DataFrame, decoded: DataFrame) -> None:
    """Raise if a row-count check failed or something could not be read."""
    failed = checks.filter(~F.col("passed")).take(10)
    if failed:
        raise ValueError(f"row counts differ between stages: {[r.asDict() for r in failed]}")
    bad = decoded.filter(" OR ".join(f"{c} > 0" for c in _UNREADABLE)).take(10)
    if bad:
        raise ValueError(f"unreadable rows: {[r.asDict() for r in bad]}")


def require_power_quality(cells: DataFrame) -> None:
    """Raise if power samples had no header, cells no column, or cells were no numbers."""
    bad = cells.filter(" OR ".join(f"{c} > 0" for c in POWER_FAULTS)).take(10)
    if bad:
        raise ValueError(f"unreadable power samples: {[r.asDict() for r in bad]}")


def write_stats(
    analysis: TraceAnalysis,
    place: Callable[[str], str],
    strict: bool,
    power_cells: DataFrame | None = None,
    csv: bool = False,
) -> dict[str, DataFrame]:
    """Check the analysed runs and save their statistics where ``place`` says; the saved ones by level."""
    checks = write_table(analysis.quality_checks(), place("quality_checks"))
    decoded = write_table(analysis.decode_quality(), place("decode_quality"))
    if strict:
        require_quality(checks, decoded)
        if power_cells is not None:
            require_power_quality(power_cells)
    return {
        "worker": write_table(analysis.worker_stats, place("worker_stats"), csv=csv),
        "system": write_table(analysis.system_stats, place("system_stats"), csv=csv),
    }


def write_reports(
    stats: dict[str, DataFrame], steps: DataFrame, output: str, staging: Staging, per_run: bool
) -> None:
    """All reports of the last step, and the runs that they leave out, under ``output``."""
    left_out = left_out_runs(steps)
    (left_out.limit(0) if per_run else left_out).write.parquet(f"{output}/left_out_runs")
    last = {level: staging.table(f"last_{level}", last_step(df, steps, per_run)) for level, df in stats.items()}
    for name, report in REPORTS.items():
        write_report(name, report_table(name, last[report.level]), output)


def run_report(
    spark: SparkSession,
    input: str,
    output: str,
    override: bool = False,
    strict: bool = True,
    per_run: bool = False,
) -> None:
    """Analyse all runs under ``input`` and write every table and report to ``output``.

    ``strict`` stops on failed checks; otherwise their result is only written.
    Reports are of the last step of all runs together, or with ``per_run`` of
    each run's own; ``left_out_runs`` lists the runs that this leaves out. The
    output appears when all of it is written, and only then replaces another.
    """
    if not path_exists(spark, input):
        raise ValueError(f"input does not exist: {input}")
    check_output(spark, input, output, override)
    with_files = not is_parquet_trace(spark, input)
    if with_files:
        require_complete(discover_runs(spark, input))
    tables = read_trace(spark, input)
    if not with_files:
        require_complete(run_inventory(tables.spans, tables.power))

    staging = Staging(spark)
    new = f"{output.rstrip('/')}.new-{uuid.uuid4().hex[:8]}"
    try:
        power_cells = None
        if with_files:
            # Each table is used several times; the files are read once.
            power_cells = write_table(power_quality(spark, input), f"{new}/power_quality")
            write_layout(tables, f"{staging.root}/trace")
            tables = read_layout(spark, f"{staging.root}/trace")
        analysis = TraceAnalysis(tables, staging)
        stats = write_stats(analysis, lambda name: f"{new}/{name}", strict, power_cells, csv=True)
        write_reports(stats, analysis.inference, new, staging, per_run)
        replace_output(spark, new, output)
    finally:
        delete_path(spark, new)
        staging.close()
