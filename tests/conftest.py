import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from txnwatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cpus=4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def tiny_hot(spark):
    """Treat keys with three rows as hot, so the skew paths run on small data."""
    spark.conf.set("spark.txnwatch.hotRows", "3")
    yield
    spark.conf.unset("spark.txnwatch.hotRows")
