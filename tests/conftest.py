import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pagemill.session import local_session

    s = local_session(8, 8, "tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture
def one(spark):
    """Evaluate columns over a single string value ``t``."""

    def run(value, *cols):
        row = spark.createDataFrame([(value,)], "t string").select(*cols).first()
        return row[0] if len(cols) == 1 else tuple(row)

    return run
