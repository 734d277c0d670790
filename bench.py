"""Time the main queries and print one JSON line.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the number of
cores. The derived traces are written before the clock starts, as recorded
traces would be there already; every query then runs from them, sharing nothing
with the others. Results go to Spark's ``noop`` sink. Each query runs twice:
``queries`` has the faster time, ``first`` the one that includes the compilation
of its generated code.
"""

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from entry import queries as q
from entry.fixture import staged_tables
from tracewise.plans.analysis import TraceAnalysis
from tracewise.plans.reports import REPORTS
from tracewise.schemas import TraceTables
from tracewise.session import Staging, get_session


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def benchmarks(spark: SparkSession, sf_dir: str, tables: TraceTables):
    def fresh() -> TraceAnalysis:
        return TraceAnalysis(tables, Staging(spark))

    def view(name: str):
        return lambda: consume(fresh().view(name))

    def reports():
        analysis = fresh()
        for name in REPORTS:
            consume(analysis.report(name))

    def table_query(query):
        return lambda: consume(query(spark, sf_dir))

    return {
        "step_range": view("step_range"),
        "step_compute_runtime": view("step_compute_runtime"),
        "comm_wait_kernel": view("step_communication_wait_kernel"),
        "worker_stats": lambda: consume(fresh().worker_stats),
        "system_stats": lambda: consume(fresh().system_stats),
        "quality_checks": lambda: consume(fresh().quality_checks()),
        "decode_quality": lambda: consume(fresh().decode_quality()),
        "all_reports": reports,
        "power_peak": lambda: consume(q.system.power_peak(tables.power)),
        "synth_features": table_query(q.synth_features),
        "bag_offsets": table_query(q.bag_offsets),
        "embedding_bag_sum": table_query(q.embedding_bag_sum),
        "pairwise_dot": table_query(q.pairwise_dot),
        "score_mlp": table_query(q.score_mlp),
        "score_model": table_query(q.score_model),
        "temporal_split": table_query(q.temporal_split),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            # Generated methods of wide aggregations are larger than the JVM compiles by default.
            "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    started = time.time()
    tables = staged_tables(spark, sf_dir, Staging(spark))
    prepared = time.time() - started

    first, seconds = {}, {}
    for name, run in benchmarks(spark, sf_dir, tables).items():
        times = []
        for _ in range(2):
            started = time.time()
            run()
            times.append(round(time.time() - started, 3))
        first[name], seconds[name] = times[0], min(times)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first": first,
                "prepare": round(prepared, 3),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
