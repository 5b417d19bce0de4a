"""Joins to a table with one row per key: as the plain join, with hot keys dealt out and null keys passed by."""

import collections
import statistics

import pytest
from pyspark.sql import functions as F

from puckspark.operators.skew import hot_keys, join_by_key
from puckspark.session import pin


@pytest.fixture(scope="module")
def sides(spark):
    """A third of the rows under one key, a third under null, many keys on the left only, some on the right only."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "a" if i % 2 else None, i) for i in range(6000)]
    left = pin(spark.createDataFrame(rows, "k long, g string, v long").repartition(5))
    right = spark.createDataFrame([(k, f"r{k}") for k in [7, *range(2, 6000, 6), 99_999]], "k long, name string")
    return rows, left, right


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("share", [200, 1_000_000, 1])
def test_rows_are_those_of_the_plain_join(sides, how, share):
    rows, left, right = sides
    got = join_by_key(left, right, ["k"], how, share)
    assert got.columns == ["k", "g", "v", "name"]
    want = left.join(right, "k", how).select(*got.columns)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want.collect()))


def test_hot_keys_are_few_and_known(sides):
    _, left, _ = sides
    assert [r.k for r in hot_keys(left, ["k"]).collect()] == [7]
    assert [tuple(r)[:2] for r in hot_keys(left, ["k", "g"]).orderBy("g").collect()] == [(7, "a")]  # null is no key


def test_no_task_gets_the_hot_key_alone(spark, sides):
    _, left, right = sides
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_by_key(left, right.groupBy("k").agg(F.min("name").alias("name")), ["k"], "inner")
        sizes = [n for n in joined.groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 8 and max(sizes) < 2 * statistics.median(sizes)


def test_empty_sides(sides):
    rows, left, right = sides
    assert join_by_key(left, right.limit(0), ["k"]).count() == len(rows)
    assert join_by_key(left.limit(0), right, ["k"]).isEmpty() and join_by_key(left, right.limit(0), ["k"], "inner").isEmpty()
