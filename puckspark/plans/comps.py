"""Player comparisons: pools of current-season players, several weightings each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puckspark.functions.scalars import rnd, sdiv
from puckspark.operators.similarity import apply_profiles, blend_prior, top_comps, zscore

# Fixed values of the comparison model.
SKATER_FEATURES = [
    "goals_per_60", "assists_per_60", "shots_per_60", "shooting_pct", "toi_minutes_per_gp", "ev_points_per_60",
    "pp_points_per_60", "hits_per_60", "blocks_per_60", "pim_per_gp", "plus_minus_per_gp",
]
FORWARD_FEATURES = [*SKATER_FEATURES, "faceoff_pct"]
GOALIE_FEATURES = [
    "save_pct", "goals_against_average", "games_started", "win_pct_per_start", "shots_against_per_start",
    "shutout_rate",
]
OFFENSE = ["goals_per_60", "assists_per_60", "shots_per_60", "shooting_pct", "ev_points_per_60", "pp_points_per_60"]
PHYSICAL = ["hits_per_60", "blocks_per_60", "pim_per_gp"]
SKATER_PROFILES = {
    "overall": {},
    "offense": {
        **dict.fromkeys(OFFENSE, 1.0), **dict.fromkeys(PHYSICAL, 0.25),
        "toi_minutes_per_gp": 0.5, "plus_minus_per_gp": 0.5, "faceoff_pct": 0.5,
    },
    "physical": {
        **dict.fromkeys(OFFENSE, 0.25), **dict.fromkeys(PHYSICAL, 1.0),
        "toi_minutes_per_gp": 0.75, "plus_minus_per_gp": 0.5, "faceoff_pct": 0.5,
    },
}
GOALIE_PROFILES = {"overall": {}}
MIN_GAMES_SKATER = 20
MIN_GAMES_GOALIE = 15
PRIOR_WEIGHT = 0.25
TOP_N = 25

_ID = ["player_id", "season_id", "full_name", "position_group", "games_played"]


def skater_features(seasons: DataFrame) -> DataFrame:
    lines = seasons.filter(F.col("games_played") >= MIN_GAMES_SKATER)
    lines = lines.withColumn("plus_minus_per_gp", sdiv("plus_minus", "games_played"))
    return lines.select(*_ID, *FORWARD_FEATURES)


def goalie_features(seasons: DataFrame) -> DataFrame:
    lines = seasons.filter(F.col("games_played") >= MIN_GAMES_GOALIE)
    return lines.select(*_ID[:-1], "games_played", *[F.col(f).cast("double").alias(f) for f in GOALIE_FEATURES])


def pool_vectors(df: DataFrame, features: list[str], season: int, previous: int) -> DataFrame:
    """Blended vectors of the current season's rows; each season is standardised on its own.

    A pool's earlier season counts only when it holds at least two players.
    """
    part = ["position_group", "season_id"]
    rows = zscore(df.filter(F.col("season_id").isin(season, previous)), part, features)
    rows = rows.select("player_id", "position_group", "season_id", "vec")
    now, before = rows.filter(F.col("season_id") == season), rows.filter(F.col("season_id") == previous)
    full = before.groupBy("position_group").count().filter("count >= 2").select("position_group")
    before = before.join(full, "position_group", "left_semi")
    return blend_prior(now, before, ["player_id", "position_group"], PRIOR_WEIGHT)


def similarity(
    df: DataFrame, pools: dict[str, list[str]], profiles: dict[str, dict[str, float]], season: int, previous: int,
    k: int = TOP_N,
) -> DataFrame:
    """Comps for the given pools ({position group: features}); pools and profiles run as one job."""
    weighted = []
    for group, features in pools.items():
        vectors = pool_vectors(df.filter(F.col("position_group") == group), features, season, previous)
        weighted.append(apply_profiles(vectors.drop("season_id"), features, profiles))
    rows = reduce(DataFrame.unionByName, weighted)
    return _shape(top_comps(rows, ["position_group", "profile"], "player_id", "vec", k), season)


def _shape(ranked: DataFrame, season: int) -> DataFrame:
    return ranked.select(
        "player_id", F.col("comp").alias("comp_player_id"), rnd("score", 6).alias("similarity_score"),
        F.col("rank").cast("long").alias("rank"), F.lit(season).cast("long").alias("season_id"),
        "profile", "position_group",
    )


def mart_player_similarity(t: dict[str, DataFrame], season: int = 20252026, previous: int = 20242025) -> DataFrame:
    skaters = skater_features(t["mart_player_season"])
    goalies = goalie_features(t["mart_goalie_season"])
    return similarity(skaters, {"F": FORWARD_FEATURES, "D": SKATER_FEATURES}, SKATER_PROFILES, season, previous).unionByName(
        similarity(goalies, {"G": GOALIE_FEATURES}, GOALIE_PROFILES, season, previous)
    )


def spot_check(sim: DataFrame, names: DataFrame, wanted: list[str], k: int = 10) -> DataFrame:
    """Best overall comps of the named players, with names on both sides."""
    who = names.select(F.col("player_id"), F.col("full_name").alias("player_name"))
    comp = names.select(F.col("player_id").alias("comp_player_id"), F.col("full_name").alias("comp_name"))
    return (
        sim.filter((F.col("profile") == "overall") & (F.col("rank") <= k))
        .join(who.filter(F.col("player_name").isin(wanted)), "player_id").join(comp, "comp_player_id")
        .select("player_name", "rank", "comp_name", "similarity_score").orderBy("player_name", "rank")
    )
