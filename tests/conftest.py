import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from shelfwise.session import build_session
    shared = SparkSession.builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shelfwise-test-ckpt-"))
    shared.config("spark.driver.memory", "6g")
    s = build_session("local[4]", 8, app_name="shelfwise-tests")
    yield s


SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
