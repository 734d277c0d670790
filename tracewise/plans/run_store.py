"""Results of runs that arrive over time: only new runs are computed.

A store has a folder for each table, in it one for each batch of runs, and one for
the reports of each version. A version is a small file that names its batches and
its reports. It is written last, under a number of its own, and nothing that an
earlier version names is ever changed or moved: a job that ends early leaves the
store as it was, on object stores too, and readers of an old version go on reading.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.plans.analysis import TraceAnalysis
from tracewise.plans.report_job import write_reports, write_stats
from tracewise.schemas import SCHEMAS, TraceTables
from tracewise.session import Staging, create_file, delete_path, full_path, list_names, path_exists
from tracewise.sources.inventory import discover_runs, require_complete, run_inventory
from tracewise.sources.layout import read_layout, write_layout
from tracewise.sources.power import power_quality
from tracewise.sources.sinks import write_table
from tracewise.sources.traces import is_parquet_trace, read_trace

#: Up to so many new runs are named in a filter, which reaches files and partitions; more are joined.
NAMED_RUNS = 1000

_VERSIONS = "versions"


def current_version(spark: SparkSession, store: str) -> dict | None:
    """The last whole version: its ``number``, ``batches``, ``reports`` and ``schemas``; null for a new store."""
    folder = f"{store}/{_VERSIONS}"
    names = list_names(spark, folder) if path_exists(spark, folder) else []
    for name in sorted((n for n in names if n.endswith(".json")), reverse=True):
        line = spark.read.text(f"{folder}/{name}").first()
        try:
            return json.loads(line["value"])
        except (TypeError, ValueError):  # its writer was stopped
            continue
    return None


def _commit(spark: SparkSession, store: str, version: dict) -> None:
    """Write the file of a version; an error if another job has taken its number."""
    # numbers of files whose writers were stopped are not used again
    taken = list_names(spark, f"{store}/{_VERSIONS}") if path_exists(spark, f"{store}/{_VERSIONS}") else []
    expected = f"{version['number']:09d}.json"
    if any(name >= expected and name not in version["skipped"] for name in taken):
        raise ValueError("another job has added runs to this store meanwhile")
    number = max([version["number"], *(int(name.split(".")[0]) + 1 for name in version["skipped"])])
    whole = {k: v for k, v in version.items() if k != "skipped"} | {"number": number}
    create_file(spark, f"{store}/{_VERSIONS}/{number:09d}.json", json.dumps(whole))


def _saved(spark: SparkSession, store: str, name: str, version: dict) -> DataFrame:
    """A table of all batches, with the place of the batch in the list as ``_batch``."""
    schema = T.StructType.fromJson(json.loads(version["schemas"][name])).add("batch", "string")
    paths = [f"{store}/{name}/batch={b}" for b in version["batches"]]
    rows = spark.read.schema(schema).option("basePath", f"{store}/{name}").parquet(*paths)
    return rows.withColumn("_batch", F.array_position(F.array(*map(F.lit, version["batches"])), F.col("batch"))).drop("batch")


def store_table(spark: SparkSession, store: str, name: str, version: dict | None = None) -> DataFrame:
    """A table of the store, such as ``worker_stats``: each run as its last batch has it."""
    version = version or current_version(spark, store)
    if not version:
        raise ValueError(f"{store} has no runs")
    last = _saved(spark, store, "runs", version).groupBy("run_id").agg(F.max("_batch").alias("_batch"))
    return _saved(spark, store, name, version).join(last, ["run_id", "_batch"], "left_semi").drop("_batch")


def only_runs(tables: TraceTables, runs: DataFrame) -> TraceTables:
    """The tables with the rows of these runs (``run_id``) only."""
    named = [r["run_id"] for r in runs.select("run_id").limit(NAMED_RUNS + 1).collect()]

    def taken(df: DataFrame) -> DataFrame:
        if len(named) <= NAMED_RUNS:
            return df.filter(F.col("run_id").isin(named))
        return df.join(runs.select("run_id"), "run_id", "left_semi")

    return replace(tables, **{t: taken(df) for t in SCHEMAS if (df := getattr(tables, t)) is not None})


def add_runs(
    spark: SparkSession, input: str, store: str, strict: bool = True, per_run: bool = False, again: bool = False
) -> int:
    """Analyse the runs under ``input`` that ``store`` does not have, and make the reports of all.

    Gives the number of runs added; without new ones the store stays as it is.
    With ``again`` runs that it has are computed anew and take the place of the
    old results. ``strict`` and ``per_run`` are as for ``run_report``. The reports
    are in the folder that ``current_version`` names.
    """
    if not path_exists(spark, input):
        raise ValueError(f"input does not exist: {input}")
    a, b = (f"{full_path(spark, p)}/" for p in (input, store))
    if a.startswith(b) or b.startswith(a):
        raise ValueError(f"store {store} and input {input} overlap")
    store = store.rstrip("/")
    old = current_version(spark, store)
    known = list_names(spark, f"{store}/{_VERSIONS}") if path_exists(spark, f"{store}/{_VERSIONS}") else []

    tables = read_trace(spark, input)
    with_files = not is_parquet_trace(spark, input)
    found = discover_runs(spark, input) if with_files else run_inventory(tables.spans, tables.power)
    if old and not again:
        found = found.join(store_table(spark, store, "runs", old).select("run_id"), "run_id", "left_anti")

    staging, batch, written = Staging(spark), uuid.uuid4().hex, []

    def place(name: str) -> str:
        written.append(f"{store}/{name}/batch={batch}")
        return written[-1]

    committed = False
    try:
        found = staging.table("new_runs", found)
        added = found.count()
        if not added:
            return 0
        require_complete(found)
        tables, power_cells = only_runs(tables, found), None
        if with_files:
            cells = power_quality(spark, input).join(found.select("run_id"), "run_id", "left_semi")
            power_cells = write_table(cells, place("power_quality"))
            write_layout(tables, f"{staging.root}/trace")
            tables = read_layout(spark, f"{staging.root}/trace")
        analysis = TraceAnalysis(tables, staging)
        stats = write_stats(analysis, place, strict, power_cells)
        tables_now = {f"{level}_stats": df for level, df in stats.items()}
        tables_now["steps"] = write_table(analysis.inference.select("run_id", "step_id").distinct(), place("steps"))
        tables_now["runs"] = write_table(found, place("runs"))
        number = old["number"] + 1 if old else 1
        version = {
            "number": number,
            "skipped": [n for n in known if n >= f"{number:09d}.json"],
            "batches": [*(old["batches"] if old else []), batch],
            "reports": f"{store}/reports/{batch}",
            "schemas": {name: df.schema.json() for name, df in tables_now.items()},
        }
        written.append(version["reports"])
        all_stats = {level: store_table(spark, store, f"{level}_stats", version) for level in stats}
        write_reports(all_stats, store_table(spark, store, "steps", version), version["reports"], staging, per_run)
        _commit(spark, store, version)
        committed = True
        return added
    finally:
        for path in [] if committed else written:
            delete_path(spark, path)
        staging.close()
