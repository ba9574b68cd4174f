import os

import pytest

SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def tables(spark):
    """name -> list of row dicts of a driver table."""
    def read(name):
        return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]
    return read
