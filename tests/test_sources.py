import sqlite3

import pytest
from pyspark.sql import functions as F
from test_calls import GID, NAMES, TID, span, step

from tracewise.plans.report_job import run_report
from tracewise.plans.reports import REPORTS
from tracewise.schemas import SCHEMAS, SQLITE_TABLES, TraceTables
from tracewise.sources.inventory import discover_runs, require_complete
from tracewise.sources.power import power_quality, read_power
from tracewise.sources.sinks import write_table
from tracewise.sources.traces import read_sqlite_table, read_trace, write_trace


def run_rows(run, batch):
    """A run of two steps of two workers with one input, communication and output each."""
    spans, runtime, kernels, copies = [], [], [], []
    tensor = [[batch], "float16"]
    for number in range(2):
        for rank in range(2):
            tid, gid = TID + (rank << 24), GID + (rank << 24)
            t = number * 10_000 + rank * 10
            spans += [
                step(t, t + 5000, run, rank, number, batch, tid),
                span(t + 100, t + 900, run, tid, event="input", name="input", tensor=tensor),
                span(t + 1000, t + 1900, run, tid, event="compute", name="top_mlp",
                     weights=[tensor]),
                span(t + 2000, t + 2900, run, tid, event="communication", name="all_to_all",
                     send_tensors=[tensor], recv_tensors=[]),
                span(t + 3000, t + 3900, run, tid, event="output", name="output", tensor=tensor),
            ]
            for i, (name, at) in enumerate(((1, 200), (2, 1200), (2, 2200), (1, 3200))):
                number_of_call = number * 100 + rank * 10 + i
                runtime.append((run, tid, t + at, t + at + 50, number_of_call, name))
                work = (run, gid, t + at + 100, t + at + 300, number_of_call)
                copies.append((*work, batch * 2)) if name == 1 else kernels.append(work)
    names = [(run, i, value) for _, i, value in NAMES]
    return {"spans": spans, "runtime": runtime, "kernels": kernels, "copies": copies,
            "string_ids": names}


RUNS = {"m_2_1": run_rows("m_2_1", 1), "m_2_8": run_rows("m_2_8", 8)}
POWER = "GPU-a,GPU-b\n10.5,20.25\n11.5,\n"


def write_sqlite(path, rows):
    types = {"bigint": "INTEGER", "int": "INTEGER", "string": "TEXT"}
    with sqlite3.connect(path) as db:
        for table, name in SQLITE_TABLES.items():
            fields = SCHEMAS[table].fields[1:]
            columns = ", ".join(f'"{f.name}" {types[f.dataType.simpleString()]}' for f in fields)
            db.execute(f"CREATE TABLE {name} (other TEXT, {columns})")
            marks = ", ".join("?" * (len(fields) + 1))
            db.executemany(
                f"INSERT INTO {name} VALUES ({marks})", [("x", *r[1:]) for r in rows[table]]
            )


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    (source / "nested").mkdir(parents=True)
    for n, (run, rows) in enumerate(RUNS.items()):
        at = source / "nested" if n else source
        write_sqlite(at / f"{run}.sqlite", rows)
        (at / f"{run}_power_draw.csv").write_text(POWER)
    return source


@pytest.mark.parametrize("rows_per_partition", [None, 7])
def test_sqlite_equals_parquet(spark, make, folder, tmp_path, rows_per_partition):
    tables = {t: make(t, [r for rows in RUNS.values() for r in rows[t]]) for t in SQLITE_TABLES}
    write_trace(TraceTables(**tables), str(tmp_path / "parquet"))
    for table in SQLITE_TABLES:
        columns = [f.name for f in SCHEMAS[table].fields]
        source = read_sqlite_table(spark, str(folder), table, rows_per_partition)
        if rows_per_partition and table == "runtime":
            assert source.rdd.getNumPartitions() == 2 * -(-16 // 7)
        parquet = spark.read.schema(SCHEMAS[table]).parquet(str(tmp_path / "parquet" / table))
        assert sorted(map(tuple, source.select(columns).collect()), key=repr) == sorted(
            map(tuple, parquet.select(columns).collect()), key=repr
        )


def test_sqlite_filters_reach_the_files(spark, folder):
    df = read_sqlite_table(spark, str(folder), "spans").filter(
        (F.col("eventType") == 59) & (F.col("start") > 10_000) & F.col("text").contains("input")
    )
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "start#" in plan and "> 10000" not in plan.split("Filter")[-1].split("\n")[0]
    assert {(r["run_id"], r["start"]) for r in df.collect()} == {
        (run, at) for run in RUNS for at in (10_100, 10_110)
    }


def test_files_of_other_runs_are_not_opened(spark, folder):
    (folder / "m_2_1.sqlite").write_bytes(b"not a database")
    df = read_sqlite_table(spark, str(folder), "runtime")
    assert df.filter("run_id = 'm_2_8'").count() == len(RUNS["m_2_8"]["runtime"])
    assert df.filter(F.col("run_id").isin("m_2_8", "x")).select("run_id").distinct().count() == 1
    assert df.filter("run_id = 'm_2_8' AND run_id = 'x'").count() == 0
    assert df.filter(F.col("run_id").isin([f"x{i}" for i in range(30)])).count() == 0


def test_a_missing_table_is_an_error(spark, tmp_path):
    sqlite3.connect(tmp_path / "a.sqlite").close()
    with pytest.raises(Exception, match="no such table"):
        read_sqlite_table(spark, str(tmp_path), "spans").collect()


def test_paths_with_a_scheme_or_special_characters(spark, tmp_path):
    folder = tmp_path / "a b%20?c"
    folder.mkdir()
    write_sqlite(folder / "m_1.sqlite", RUNS["m_2_1"])
    for root in (str(folder), f"file:{folder}", f"file://{folder}"):
        assert read_sqlite_table(spark, root, "kernels").count() == 8
    with pytest.raises(Exception, match="no .sqlite files"):
        read_sqlite_table(spark, str(tmp_path / "none"), "kernels").count()


def power_rows(df):
    return sorted(map(tuple, df.collect()))


def test_power_files_of_different_columns(spark, tmp_path):
    (tmp_path / "a_power_draw.csv").write_text("GPU-x,GPU-y\n1.5,2.5\n3.0,\nGPU-x,GPU-y\n4.0,n/a\n")
    (tmp_path / "b_power_draw.csv").write_text("GPU-z\n7.25\n\n8.25\n")
    (tmp_path / "other.csv").write_text("GPU-z\n1\n")
    assert [r[:3] for r in power_rows(read_power(spark, str(tmp_path)))] == [
        ("a", 0, "GPU-x"), ("a", 0, "GPU-y"), ("a", 1, "GPU-x"), ("a", 1, "GPU-y"),
        ("a", 2, "GPU-x"), ("a", 2, "GPU-y"), ("b", 0, "GPU-z"), ("b", 1, "GPU-z"),
    ]
    watts = {r[:3]: r[3] for r in power_rows(read_power(spark, str(tmp_path)))}
    assert watts["a", 1, "GPU-y"] is None and watts["a", 2, "GPU-y"] is None
    assert watts["a", 2, "GPU-x"] == 4.0 and watts["b", 1, "GPU-z"] == 8.25


def test_lost_power_values_are_counted(spark, tmp_path):
    (tmp_path / "a_power_draw.csv").write_text("1.0\n2.0\nGPU-x,GPU-y\n1.5,2.5,3.5\n3.0,\n4.0,n/a\n")
    (tmp_path / "b_power_draw.csv").write_text("GPU-z\n7.25\n")
    assert power_rows(power_quality(spark, str(tmp_path))) == [("a", 5, 2, 1, 1), ("b", 1, 0, 0, 0)]


def test_a_power_file_in_many_splits(spark, tmp_path):
    """Headers change along the file and hold for the splits after them."""
    lines, expected = [], []
    sample = 0
    for block in range(6):
        gpus = ["GPU-a", "GPU-b"] if block % 2 else ["GPU-b"]
        lines.append(",".join(gpus))
        for n in range(150):
            lines.append(",".join(str(float(block * 1000 + n + i)) for i in range(len(gpus))))
            expected += [
                ("r", sample, g, float(block * 1000 + n + i)) for i, g in enumerate(gpus)
            ]
            sample += 1
    (tmp_path / "r_power_draw.csv").write_text("\n".join(lines) + "\n")
    old = {k: spark.conf.get(k) for k in
           ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = power_rows(read_power(spark, str(tmp_path)))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted(expected)


def test_discovery(spark, folder):
    found = discover_runs(spark, str(folder))
    assert {(r["run_id"], r["complete"]) for r in found.collect()} == {
        ("m_2_1", True), ("m_2_8", True),
    }
    require_complete(found)
    (folder / "m_2_1_power_draw.csv").rename(folder / "m_2_16_power_draw.csv")
    with pytest.raises(ValueError, match="2 runs lack"):
        require_complete(discover_runs(spark, str(folder)))
    with pytest.raises(ValueError, match="no runs"):
        require_complete(found.limit(0))


def test_report_job(spark, folder, tmp_path):
    output = str(tmp_path / "out")
    run_report(spark, str(folder), output)
    ips = (
        spark.read.csv(f"{output}/system_ips.csv", header=True, inferSchema=True)
        .orderBy("Batch Size").collect()
    )
    assert list(ips[0].asDict()) == list(REPORTS["system_ips"].headers.values())
    assert [r["Batch Size"] for r in ips] == [1, 8]
    # A step lasts from the first worker's start to the last one's end.
    assert ips[1]["IPS"] == 8 / (5010 * 1e-9)
    for name, report in REPORTS.items():
        df = spark.read.csv(f"{output}/{name}.csv", header=True)
        assert df.count() == (4 if report.level == "worker" else 2)
    system = spark.read.parquet(f"{output}/system_stats")
    assert system.count() == 4 and set(system.select("worker_number").first()) == {2}
    assert spark.read.csv(f"{output}/worker_stats.csv", header=True).count() == 8
    assert system.filter(F.abs(F.col("ipw") - F.col("ips") / 31.75) > 1e-6).count() == 0

    with pytest.raises(ValueError, match="exists"):
        run_report(spark, str(folder), output)
    with pytest.raises(ValueError, match="does not exist"):
        run_report(spark, str(tmp_path / "none"), output)

    # The same from the Parquet layout, replacing the output.
    saved = str(tmp_path / "saved")
    write_trace(read_trace(spark, str(folder)), saved)
    run_report(spark, saved, output, override=True)
    again = spark.read.csv(f"{output}/system_ips.csv", header=True, inferSchema=True)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, ips))


def test_runs_with_fewer_steps(spark, folder, tmp_path):
    """Left out of the reports and listed, or in them with their own last step."""
    short = run_rows("m_2_8", 8)
    # The second step starts at 10,000; nothing of it is in the run that is cut.
    for table in ("spans", "runtime", "kernels", "copies"):
        at = {"spans": 3, "runtime": 2, "kernels": 2, "copies": 2}[table]
        short[table] = [r for r in short[table] if r[at] < 9000]
    (folder / "nested" / "m_2_8.sqlite").unlink()
    write_sqlite(folder / "nested" / "m_2_8.sqlite", short)
    for per_run, batches, left in ((False, {"1"}, [("m_2_8", 0)]), (True, {"1", "8"}, [])):
        output = str(tmp_path / f"out{per_run}")
        run_report(spark, str(folder), output, per_run=per_run)
        rows = spark.read.csv(f"{output}/system_ips.csv", header=True).collect()
        assert {r["Batch Size"] for r in rows} == batches
        listed = spark.read.parquet(f"{output}/left_out_runs")
        assert [(r["run_id"], r["last_step"]) for r in listed.collect()] == left


def test_a_failing_job_keeps_the_last_output(spark, folder, tmp_path):
    output = tmp_path / "out"
    run_report(spark, str(folder), str(output))
    before = sorted(p.name for p in output.iterdir())
    (folder / "m_2_1_power_draw.csv").write_text("1.0\n" + POWER)
    with pytest.raises(ValueError, match="power samples"):
        run_report(spark, str(folder), str(output), override=True)
    assert sorted(p.name for p in output.iterdir()) == before
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "out"]
    for place in (folder, folder / "out", tmp_path):
        with pytest.raises(ValueError, match="overlap"):
            run_report(spark, str(folder), str(place), override=True)


def test_tables_are_written_in_few_files(spark, tmp_path):
    df = spark.range(0, 20_000, numPartitions=8).selectExpr("concat('r', id % 50) AS run_id", "id")
    write_table(df, str(tmp_path / "t"))
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 100
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20_000
