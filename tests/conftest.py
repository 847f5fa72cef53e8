import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidegauge.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = build_session("tests", master="local[4]", shuffle_partitions=4, driver_memory="4g", shared=shared)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a Column on a single made-up row."""

    def value(col):
        return spark.range(1).select(col.alias("v")).first()["v"]

    return value


@pytest.fixture
def write(tmp_path):
    """Write small files below a fresh folder; returns the folder."""

    def put(files):
        for name, text in files.items():
            path = tmp_path / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(tmp_path)

    return put


def executed_plan(df):
    """Final physical plan as text (a test looks at it, the library does not)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
