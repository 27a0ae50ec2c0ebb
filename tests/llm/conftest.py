import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from rows import ODD  # noqa: E402

SF_MID = "/root/testdata/sf0.01"
@pytest.fixture(scope="session")
def spark():
    from wardlens.llm.common import ship
    from wardlens.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=4)
    ship(s)
    yield s


@pytest.fixture(scope="session")
def odd(spark):
    """Corner rows with a column whose name clashes with the operators' own."""
    return spark.createDataFrame([(*r, 1) for r in ODD], "doc_id long, text string, n long").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def mid(spark):
    return spark.read.parquet(f"{SF_MID}/documents.parquet")


@pytest.fixture(scope="session")
def mid_rows(mid):
    return [(r[0], r[1]) for r in mid.select("doc_id", "text").collect()]


@pytest.fixture
def rng():
    return random.Random(5)
