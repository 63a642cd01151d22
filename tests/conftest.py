import datetime
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from reckon.session import local_session  # noqa: E402
from reckon.sources.seed import Seed  # noqa: E402
from reckon.sources.testdata import TestData  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data(spark):
    return TestData(spark, SMALL)


@pytest.fixture(scope="session")
def seed(spark):
    tables = Seed(spark, datetime.datetime(2025, 6, 1, 12, 0))
    for name in ("ledger", "vouchers"):
        setattr(tables, name, getattr(tables, name).persist())
    return tables


@pytest.fixture
def settings(spark):
    """Set runtime options for one test."""
    before = {}

    def change(**options):
        for name, value in options.items():
            key = name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)
