import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from keyloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "keyloom-tests", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Small table from literal rows."""
    return lambda data, ddl: spark.createDataFrame(data, ddl)
