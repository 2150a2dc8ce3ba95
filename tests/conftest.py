import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("ISOBAR_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from isobar.session import session

    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 6g pyspark-shell")
    # A folder that is there beforehand: Spark's own temporary folder goes with the session.
    made = session("tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="spark-wh-"))
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def sf01():
    return f"{DATA}/sf0.01"
