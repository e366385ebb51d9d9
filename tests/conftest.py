import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from axisloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "axisloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def as_rows(spark):
    """numpy matrix -> dense rows; NaN becomes NULL."""

    def make(m, parts=3):
        data = [(i, [None if v != v else float(v) for v in row]) for i, row in enumerate(m)]
        return spark.createDataFrame(data, "row_id BIGINT, y ARRAY<DOUBLE>").repartition(parts)

    return make
