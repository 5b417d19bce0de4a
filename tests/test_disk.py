"""What a plan leaves on disk, and how often it moves its rows."""

import os

import pytest
from pyspark.sql import functions as F

from puckspark.harness.league import League
from puckspark.harness.registry import Tables
from puckspark.operators.relate import attach_within
from puckspark.plans import marts
from puckspark.session import Pins, pin, shared_dir

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def stored(spark):
    place = f"{shared_dir(spark)}/puckspark"
    return {d for d in os.listdir(place) if os.listdir(f"{place}/{d}")} if os.path.isdir(place) else set()


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(blocks.apply(i).getName()) for i in range(blocks.size()) if str(blocks.apply(i).getName()).startswith("shuffle_")}


def test_a_stored_frame_leaves_no_shuffle_files(spark):
    """They stayed until the driver collected garbage."""
    before = shuffle_files(spark)
    out = pin(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    assert len(out.collect()) == 7
    assert not shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_scope_leaves_frames_that_it_does_not_own(spark):
    with Pins(spark):
        mine, kept = pin(spark.range(3)), pin(spark.range(4), owned=False, codec="zstd")
        assert mine.count() == 3
    assert kept.count() == 4


def test_a_table_of_the_league_leaves_itself_alone(spark):
    """The copy of both loads stayed beside the staged rows, and what percentiles stored beside the mart."""
    league = League(Tables(spark, FOLDER))
    before = stored(spark)
    league["stg_player_games"]
    assert len(stored(spark) - before) == 1
    league["mart_player_season"]
    assert len(stored(spark) - before) == len(league.frames)
    league["fct_shots"]  # a column over the stored shots
    assert len(stored(spark) - before) == len(league.frames) - 1
    assert all(league[name].count() > 0 for name in list(league.frames))


def test_the_lines_behind_the_shots_move_once(shuffled_joins):
    """They were dealt by all keys of the grouping and then by the key of the join."""
    feed = League(Tables(shuffled_joins, FOLDER)).feed("shots")
    plan = feed._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hash" in line for line in plan.split("\n")) == 2, plan  # lines and orders


def test_values_found_within_a_group_are_those_of_joins(spark):
    rows = spark.createDataFrame(
        [(1, 1, 5, "a"), (1, 2, 5, "b"), (1, 2, 5, "c"), (1, None, None, "d"), (2, 1, 6, "e"), (None, 1, 5, "f"), (3, 9, 6, None)], "who long, game long, season long, x string")
    xg = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.25), (4, 1, 9.0), (1, None, 7.0), (None, 1, 8.0), (2, 1, None)], "who long, game long, xg double")
    pace = spark.createDataFrame([(1, 5, 1.0, "p"), (2, 6, None, "q"), (3, None, 3.0, "r"), (None, 5, 4.0, "s"), (9, 9, 5.0, "t")], "who long, season long, pace double, tag string")
    want = rows.join(xg, ["who", "game"], "left").join(pace, ["who", "season"], "left").select("who", "game", "season", "x", "xg", "pace", "tag")
    for tasks in (None, 5):
        got = attach_within(rows, [(xg, ["who", "game"]), (pace, ["who", "season"])], "who", tasks)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def games_of(spark):
    games = spark.range(600).select(
        F.col("id").alias("game_id"), (F.col("id") % 3 + 1990).alias("season_id"), F.lit("2000-01-01").cast("date").alias("game_date"),
        (F.floor(F.col("id") / 20) + 1).alias("player_game_number"), (F.col("id") % 20).alias("player_id"), F.lit("n").alias("full_name"),
        F.lit("C").alias("position_code"), F.lit("F").alias("position_group"), F.lit("A").alias("team_abbrev"), F.lit("B").alias("opponent_abbrev"),
        *[(F.col("id") % k).alias(c) for k, c in ((3, "goals"), (4, "assists"), (5, "points"), (6, "shots"))]).withColumn(
        "player_game_key", F.concat_ws("-", "game_id", "player_id"))
    shots = games.where("game_id % 2 = 0").select("game_id", F.col("player_id").alias("shooting_player_id"), F.lit(2).alias("game_type"), F.lit(0.25).alias("xg"))
    seasons = games.where("game_id < 60 and player_id <> 7").select("player_id", "season_id").withColumn("points_per_gp", F.lit(1.5))
    return {"fct_player_games": games, "fct_shots": shots.union(shots), "mart_player_season": seasons}


def test_the_form_table_moves_a_game_once(shuffled_joins):
    """Two joins and the window each dealt the games by their own keys."""
    form = marts.mart_player_form(games_of(shuffled_joins))
    plan = form._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.split("\n") if "Exchange" in line]
    assert len(moves) == 2, plan  # all rows by player, and the shots before they are added up


def test_the_form_table_is_the_same_where_a_player_is_too_large_for_a_task(spark):
    plain = sorted(map(repr, marts.mart_player_form(games_of(spark)).collect()))
    spark.conf.set("puckspark.maxGroupRows", "20")
    try:
        assert sorted(map(repr, marts.mart_player_form(games_of(spark)).collect())) == plain
    finally:
        spark.conf.unset("puckspark.maxGroupRows")
    assert len(plain) == 600 and sum("xg_last_10=0.0" in r for r in plain) < 600
