import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from feedsift.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Evaluate one column over a list of inputs, in order."""

    def run(column, values, kind="string"):
        frame = spark.createDataFrame(
            [(n, v) for n, v in enumerate(values)], f"n INT, x {kind}"
        )
        rows = frame.select("n", column("x").alias("y")).orderBy("n").collect()
        return [r["y"] for r in rows]

    return run
