"""Joins and windows whose tasks are numbered by rows, not by adaptive execution or the session's settings."""

import pytest
from pyspark.sql import functions as F

from puckspark.operators.ordered import percentile_within
from puckspark.operators.relate import left_chain
from puckspark.operators.sizing import tasks_for


@pytest.fixture
def small_tasks(spark):
    spark.conf.set("puckspark.maxTaskRows", "50")
    yield spark
    spark.conf.unset("puckspark.maxTaskRows")


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_tasks_follow_the_rows(small_tasks):
    assert tasks_for(small_tasks, 300) is None  # no more than cores
    assert tasks_for(small_tasks, 5001) == 101


def test_a_chain_of_joins_holds_a_bounded_number_of_rows_a_task(small_tasks):
    """Adaptive execution dealt these rows over the cores alone."""
    base = small_tasks.range(4000).select("id", (F.col("id") % 7).alias("season"), F.lit("x").alias("a"))
    sides = [base.where("id % 3 > 0").select("id", "season", F.col("id").alias(c)) for c in ("b", "c")]
    out = left_chain(base, sides, ["id", "season"], 4000)
    plain = left_chain(base, sides, ["id", "season"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))
    assert most_in_a_task(out) < 100


def test_percentiles_by_join_hold_a_bounded_number_of_rows_a_task(small_tasks):
    df = small_tasks.range(3000).select(
        "id", (F.col("id") % 2).alias("g"), (F.col("id") * 37 % 1009).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, 5.0).alias("y"))
    ask = lambda large: percentile_within(df, ["g"], {"px": "x", "py": "y"}, F.col("id") > 20, large=large)
    joined = ask(True)
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, ask(False).collect()))
    assert most_in_a_task(joined.where("id > 20")) < 100
