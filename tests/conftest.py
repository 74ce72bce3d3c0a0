import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from linewright.session import local_session

    session = local_session("4", partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_blocks(spark):
    """Force the many-block path of the ordered scans on small data."""
    from linewright.functions.ordered import ROWS_PER_BLOCK_CONF

    spark.conf.set(ROWS_PER_BLOCK_CONF, "37")
    yield
    spark.conf.unset(ROWS_PER_BLOCK_CONF)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)
