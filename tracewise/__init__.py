"""tracewise: analytics over profiler traces of distributed GPU jobs, on Spark."""

from tracewise.plans.analysis import TraceAnalysis
from tracewise.plans.report_job import run_report
from tracewise.plans.run_store import add_runs, current_version, store_table
from tracewise.schemas import TraceTables
from tracewise.session import get_session

__all__ = [
    "TraceAnalysis", "TraceTables", "add_runs", "current_version", "get_session", "run_report", "store_table",
]
