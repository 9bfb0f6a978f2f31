from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from deskgraph.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, shuffle_partitions=4, app="tests", settings={"spark.checkpoint.dir": folder})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate one column over one row of string columns."""

    def run(column, **columns):
        frame = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
        return frame.select(column.alias("v")).first()["v"]

    return run
