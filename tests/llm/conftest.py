import os

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def tables(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
