import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetscope.runtime import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.driver.memory": "4g", "spark.sql.maxMetadataValueLength": "2000"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    return lambda schema, rows: spark.createDataFrame(rows, schema)


@pytest.fixture
def rows():
    return lambda df, *columns: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
