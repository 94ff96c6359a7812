import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vellum.session import get_session

    s = get_session("local[4]", app="vellum-tests", **{"spark.sql.shuffle.partitions": "8"})
    yield s


@pytest.fixture()
def scratch(spark):
    from vellum.session import shared_path

    return shared_path(spark, "tests", unique=True)
