"""The split form of every ordered operator must equal the plain window."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from puckspark.operators import ordered as od
from puckspark.operators.sizing import has_large_group, null_safe_join
from puckspark.plans import marts


def skewed(spark, n=900, seed=1):
    """A third of the rows under one key, a null key, many small keys, many ties and nulls."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{rng.randrange(60)}"
        rows.append((key, rng.randrange(200), i, rng.choice([None, None, rng.randrange(5)]), float(rng.randrange(9)) / 4))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, day long, id long, v long, x double")


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


ORDER = ["day", "id"]


def test_size_check(spark, small_groups):
    df = skewed(spark)
    assert has_large_group(df, ["k"])
    assert not has_large_group(df, ["k", "day"])


def test_null_safe_join_keeps_null_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, n long")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, m long")
    assert rows(null_safe_join(left, right, ["k"], "left")) == [("a", 20, 2), ("b", None, 3), (None, 10, 1)]


@pytest.mark.parametrize("desc", [False, True])
def test_sequence_number(spark, small_groups, desc):
    df = skewed(spark)
    order = [F.desc("day"), "id"] if desc else ORDER
    assert rows(od.sequence_number(df, ["k"], order, "n")) == rows(od.sequence_number(df, ["k"], order, "n", large=False))


def test_running_total(spark, small_groups):
    df = skewed(spark)
    total = lambda large: rows(od.running_total(df, ["k"], ORDER, F.col("id"), "t", large=large))
    assert total(True) == total(False)


def test_running_total_with_nulls(spark, small_groups):
    df = spark.createDataFrame([(g, i, float(i) if g == "late" and i > 100 or g == "early" and i < 10 else None) for g in ("late", "early", None) for i in range(150)], "k string, id int, v double")
    for value in (F.col("v"), F.col("v").cast("int"), F.col("v").cast("decimal(10,2)")):
        plain, split = (od.running_total(df, ["k"], ["id"], value, "t", large=large) for large in (False, True))
        assert rows(plain) == rows(split)
        assert plain.schema["t"].dataType == split.schema["t"].dataType


def test_rank_type_does_not_depend_on_k(spark, small_groups):
    df = skewed(spark)
    few, many = (od.top_k_per(df, ["k"], ORDER, k) for k in (3, 5000))
    assert few.schema["rank"].dataType == many.schema["rank"].dataType
    assert rows(few) == rows(many.filter("rank <= 3"))


def test_lags_and_trailing_frames_cross_blocks(spark, small_groups):
    df = skewed(spark).withColumn("date", F.date_add(F.lit("2026-01-01").cast("date"), F.col("day").cast("int")))
    rest = lambda large, number: rows(od.windowed(df, ["k"], ORDER, 1, marts.rest_columns("date"), number=number, large=large))
    assert rest(None, "n") == rest(False, "n")
    assert rest(True, None) == rest(False, None)
    ratio = [marts.TrailingRatio("r", "id", "day"), marts.TrailingRatio("c", "id", "day", complement=True)]
    run = lambda large: rows(marts.trailing_ratios(df, ["k"], ORDER, ratio, number="n", large=large))
    assert run(None) == run(False)


def test_reach_longer_than_a_block(spark):
    df = skewed(spark, 300)
    spark.conf.set("puckspark.maxGroupRows", "3")
    try:
        build = lambda w: {"s": F.sum("id").over(w.rowsBetween(-14, 0))}
        run = lambda large: rows(od.windowed(df, ["k"], ORDER, 14, build, large=large))
        assert run(True) == run(False)
    finally:
        spark.conf.unset("puckspark.maxGroupRows")


@pytest.mark.parametrize("include_current", [False, True])
def test_carry_last(spark, small_groups, include_current):
    df = skewed(spark)
    values = {"last_v": F.col("v"), "last_s": F.when(F.col("v") == 2, F.struct("id", "x"))}
    run = lambda large: rows(od.carry_last(df, ["k"], ORDER, values, include_current, large=large))
    assert run(None) == run(False)


def test_carry_over_a_segment_without_values(spark, small_groups):
    """One early value must reach rows many segments later."""
    df = spark.range(500).select(F.lit("hot").alias("k"), F.col("id"), F.when(F.col("id") == 3, F.lit(9)).alias("v"))
    out = od.carry_last(df, ["k"], ["id"], {"c": F.col("v")})
    assert out.filter("id > 3 and c = 9").count() == 496
    assert out.filter("id <= 3 and c is null").count() == 4


def test_percentiles(spark, small_groups):
    df = skewed(spark).withColumn("w", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("x") * 2))
    metrics = {"px": "x", "pw": "w"}
    run = lambda large: rows(od.percentile_within(df, ["k"], metrics, F.col("day") > 20, lambda c: F.round(c, 6), large=large))
    assert run(None) == run(False)


def test_percentiles_of_ten_metrics_take_one_join_of_the_rows(spark, small_groups):
    df = skewed(spark).withColumns({f"m{i}": (F.col("id") * (7 + i) % 11) / 4 for i in range(10)}).unionByName(skewed(spark), allowMissingColumns=True)
    metrics = {f"p{i}": f"m{i}" for i in range(10)}
    run = lambda metrics, large: od.percentile_within(df, ["k"], metrics, F.col("day") > 20, lambda c: F.round(c, 6), large=large)
    assert rows(run(metrics, True)) == rows(run(metrics, False))
    joins = lambda out: out._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(run(metrics, True)) == joins(run({"p0": "m0"}, True)) <= 3


def test_percentiles_hold_no_whole_rows_in_a_window(spark):
    """By default no window runs over the rows, whatever the number of distinct values, and the result is that of the window."""
    df = skewed(spark).withColumns({"w": F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("x") * 2), "zero": F.lit(0.0) * F.col("x") * -1})
    metrics = {"px": "x", "pw": "w", "pi": "id", "pz": "zero"}
    run = lambda large: od.percentile_within(df, ["k"], metrics, F.col("day") > 20, lambda c: F.round(c, 6), large=large)
    want = rows(run(False))
    for limit in ("100000", "300", "1"):  # all looked up by broadcast, all but the ids, none
        spark.conf.set("puckspark.maxBroadcastRows", limit)
        try:
            got = run(None)
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert "Window" not in plan and rows(got) == want and got.columns == run(False).columns
        finally:
            spark.conf.unset("puckspark.maxBroadcastRows")
    nobody = od.percentile_within(df, ["k"], metrics, F.lit(False))
    assert nobody.count() == df.count() and nobody.filter("px is not null").isEmpty()


def test_percentile_under_a_name_of_the_input(spark, small_groups):
    df = skewed(spark)
    run = lambda large: od.percentile_within(df, ["k"], {"x": "x", "p": "day"}, F.col("day") > 20, large=large)
    assert rows(run(True)) == rows(run(False)) and run(True).columns == run(False).columns


def test_percentile_of_a_group_of_one_and_of_unqualified_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 30), ("b", 2.0, 30), ("b", None, 40), ("b", 5.0, 3)], "k string, x double, gp long")
    for large in (True, False):
        out = od.percentile_within(df, ["k"], {"p": "x"}, F.col("gp") >= 20, large=large)
        # the null ranks first and pushes the other qualified row up
        assert {(r.k, r.x, r.p) for r in out.collect()} == {("a", 1.0, 0.0), ("b", 2.0, 1.0), ("b", None, 0.0), ("b", 5.0, None)}


def test_latest_and_top_k(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy(F.desc("day"), "id")
    want = df.withColumn("r", F.row_number().over(w))
    assert rows(od.latest_per(df, ["k"], [F.desc("day"), "id"])) == rows(want.filter("r = 1").drop("r"))
    assert rows(od.top_k_per(df, ["k"], [F.desc("day"), "id"], 4, "r")) == rows(want.filter("r <= 4"))


def test_hot_group_is_cut_before_the_shuffle(spark):
    plan = od.latest_per(skewed(spark), ["k"], [F.desc("day"), "id"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_k_beyond_the_group_limit(spark, small_groups):
    df = skewed(spark)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        got = od.top_k_per(df, ["k"], ORDER, 30, "r").withColumn("r", F.col("r").cast("int"))
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert rows(got) == rows(od.top_k_per(df, ["k"], ORDER, 30, "r"))


@pytest.mark.parametrize("limit", [1_000_000, 30, 1])
def test_nth_rows_are_those_of_the_sorted_group(spark, limit):
    rng = random.Random(limit)
    rows = [(g, rng.choice([rng.getrandbits(64) - (1 << 63), 5, -5, (1 << 62) + rng.randrange(4)]), k) for k in range(900) for g in (rng.choice(["a", "a", "a", "b", None]),)]
    df = spark.createDataFrame(rows, "g string, v long, k long").repartition(4)
    groups = {g: sorted((v, k) for h, v, k in rows if h == g) for g in ("a", "b", None)}
    for share in (0.0, 0.2, 0.55, 1.0):
        want = {g: round(len(m) * share) for g, m in groups.items()}
        targets = spark.createDataFrame(list(want.items()), "g string, target long")
        got = {r.g: (r.cut.v, r.cut.k) for r in od.nth_rows(df, ["g"], "v", ["k"], targets, limit).collect()}
        assert got == {g: groups[g][n - 1] for g, n in want.items() if n}
