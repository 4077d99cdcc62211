import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def table(spark):
    def read(name, sf=SF):
        return spark.read.parquet(f"{sf}/{name}.parquet")
    return read
