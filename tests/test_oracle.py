"""Every query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    problem, n = compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert problem is None
    assert name in entry.oracle_sql() or n > 0


def test_split_plans_agree_too(small_groups, con):
    """The ordered queries again with a group limit that most customers exceed."""
    small_groups.conf.set("puckspark.maxGroupRows", "4")
    for name in ("sequence_number", "rest_days", "trailing_ratio", "rolling_form", "percentiles", "rush_flag", "rebound_flag",
                 "carry_last_value", "stratified_split", "last_n_games", "running_total"):
        problem, _ = compare(small_groups, con, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
        assert problem is None, name


def test_joins_without_broadcast_agree_too(spark, con):
    spark.conf.set("puckspark.maxBroadcastRows", "1")
    try:
        for name in ("era_guard", "resolve_team", "name_fallback", "with_latest_identity", "for_against", "zscore_blend", "similarity"):
            problem, _ = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
            assert problem is None, name
    finally:
        spark.conf.unset("puckspark.maxBroadcastRows")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
