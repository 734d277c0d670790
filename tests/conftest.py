import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tracewise.plans.analysis import TraceAnalysis  # noqa: E402
from tracewise.schemas import SCHEMAS, TraceTables  # noqa: E402
from tracewise.session import Staging, get_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def staging(spark):
    staging = Staging(spark)
    yield staging
    staging.close()


@pytest.fixture(scope="session")
def traces(spark):
    """The derived traces of the smallest tables, analysed."""
    from entry.queries import analysis

    return analysis(spark, SF)


@pytest.fixture
def make(spark):
    """A frame of the schema of a trace table, from tuples; missing tables are empty."""

    def build(table, rows=()):
        return spark.createDataFrame(list(rows), SCHEMAS[table])

    return build


@pytest.fixture
def analyse(make):
    def build(**tables):
        return TraceAnalysis(TraceTables(**{t: make(t, tables.get(t, ())) for t in SCHEMAS}))

    return build
