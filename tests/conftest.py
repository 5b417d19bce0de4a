import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from puckspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_groups(spark):
    """Groups of more than 40 rows count as large, so the split plans run."""
    spark.conf.set("puckspark.maxGroupRows", "40")
    yield spark
    spark.conf.unset("puckspark.maxGroupRows")
