"""Fixed serving queries over the marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puckspark.functions.scalars import season_label, season_span
from puckspark.operators.names import candidates
from puckspark.operators.ordered import latest_per
from puckspark.operators.relate import (
    last_n_rows, leaders, played_previous_day, stack_sections,
)
from puckspark.operators.search import find_by_id, find_by_name, suggest

Tables = dict[str, DataFrame]
CURRENT_SEASON = 20252026
PREVIOUS_SEASON = 20242025
PROFILES = ["overall", "offense", "physical"]

# Percentile column -> radar label (fixed values).
RADAR_AXES = {
    "pct_points_per_gp": "Pts", "pct_goals_per_gp": "Goals", "pct_shots_per_gp": "Shots",
    "pct_ev_points_per_60": "EV/60", "pct_pp_points_per_gp": "PP", "pct_toi_per_gp": "TOI",
    "pct_plus_minus": "+/-", "pct_shooting": "Sh%", "pct_hits_per_gp": "Hits", "pct_blocks_per_gp": "Blocks",
}


def _final_form(t: Tables, season: int) -> DataFrame:
    """Each player's last full-window form row of the season."""
    full = t["mart_player_form"].filter((F.col("games_in_window") == 10) & (F.col("season_id") == season))
    return latest_per(full, ["player_id"], [F.desc("player_game_number")])


def _xg_with_team(t: Tables, season: int) -> DataFrame:
    teams = t["mart_player_season"].select("player_id", "season_id", "team_abbrevs")
    return t["mart_player_xg_season"].filter(F.col("season_id") == season).join(teams, ["player_id", "season_id"])


def season_leaders(t: Tables, season: int = CURRENT_SEASON, n: int = 10) -> DataFrame:
    """Seven current-season boards as (section, rank, label, sublabel, value)."""
    name, team = F.col("full_name"), F.col("team_abbrevs")
    skaters = t["mart_player_season"].filter(F.col("season_id") == season)
    goalies = t["mart_goalie_season"].filter((F.col("season_id") == season) & (F.col("games_started") >= 30))
    xg = _xg_with_team(t, season)
    return stack_sections([
        leaders(skaters, "points", name, team, "points", "player_id", n),
        leaders(skaters, "goals", name, team, "goals", "player_id", n),
        leaders(_final_form(t, season), "hot", name, F.col("team_abbrev"), "points_last_10", "player_id", n),
        leaders(xg, "xg", name, team, "expected_goals", "player_season_key", n),
        leaders(xg.filter("unblocked_attempts >= 100"), "finishing", name, team, "goals_above_expected", "player_season_key", n),
        leaders(goalies, "save_pct", name, team, "save_pct", "player_id", n),
        leaders(t["mart_team_xg_season"].filter(F.col("season_id") == season), "xg_share", F.col("team_abbrev"), F.lit(None), "xg_share", "team_abbrev", n),
    ])


def alltime_leaders(t: Tables, active: bool = False, n: int = 10) -> DataFrame:
    """Six record-book boards, optionally for players of the current season only."""
    name = F.col("full_name")
    skaters, goalies = t["mart_player_career"], t["mart_goalie_career"]
    playoffs, seasons = t["mart_player_playoff_career"], t["mart_player_season"]
    if active:
        skaters, goalies = skaters.filter("is_active"), goalies.filter("is_active")
        ids = skaters.select("player_id")
        playoffs, seasons = (df.join(ids, "player_id", "left_semi") for df in (playoffs, seasons))
    years = season_span("first_season_id", "last_season_id")
    games = F.concat(F.col("games_played").cast("string"), F.lit(" playoff games"))
    when: Column = F.concat("team_abbrevs", F.lit(" · "), season_label("season_id"))
    seasons = seasons.withColumn("_key", F.concat_ws("-", "player_id", "season_id"))
    return stack_sections([
        leaders(skaters, "career_points", name, years, "points", "player_id", n),
        leaders(skaters, "career_goals", name, years, "goals", "player_id", n),
        leaders(goalies, "career_wins", name, years, "wins", "player_id", n),
        leaders(playoffs, "playoff_points", name, games, "points", "player_id", n),
        leaders(seasons, "season_goals", name, when, "goals", "_key", n),
        leaders(seasons, "season_points", name, when, "points", "_key", n),
    ])


def player_directory(t: Tables, season: int = CURRENT_SEASON, rows: int | None = None) -> DataFrame:
    """Everyone who can have comps, by name; ``rows`` cuts the list for a page."""
    cols = ["player_id", "full_name", "team_abbrevs", "position_code"]
    pick = lambda name, games: t[name].filter(
        (F.col("season_id") == season) & (F.col("games_played") >= games)
    ).select(*cols)
    both = pick("mart_player_season", 20).unionByName(pick("mart_goalie_season", 15))
    both = both.orderBy("full_name", "player_id")
    return both if rows is None else both.limit(rows)


def find_player(t: Tables, player_id: int | None = None, name: str = "", season: int = CURRENT_SEASON) -> tuple[DataFrame, bool]:
    """(matches, is_goalie): skaters first, goalies when no skater matches. Names are looked up by their parts, which give at most
    five ids; the season's rows are read for those."""
    named = None if player_id else candidates(t["player_names"], "full_name", name).filter(F.col("season_id") == season)
    for is_goalie, mart in ((False, "mart_player_season"), (True, "mart_goalie_season")):
        rows = t[mart].filter(F.col("season_id") == season)
        if player_id:
            found = find_by_id(rows, "player_id", player_id, "season_id", season)
        else:
            few = find_by_name(named.filter(F.col("is_goalie") == is_goalie), "full_name", name, "games_played", "player_id").select("player_id")
            found = rows.join(F.broadcast(few), "player_id", "left_semi").orderBy(F.desc("games_played"), "player_id")
        if is_goalie or not found.isEmpty():
            return found, is_goalie
    raise AssertionError("unreachable")


def suggest_players(t: Tables, query: str, season: int = CURRENT_SEASON, n: int = 8) -> DataFrame:
    """Names of the directory while one is typed: those with a part that starts with the text first."""
    q = query.strip()
    named = candidates(t["player_names"], "full_name", q).filter(
        (F.col("season_id") == season) & (F.col("games_played") >= F.when(F.col("is_goalie"), 15).otherwise(20)))
    return suggest(named.select("player_id", "full_name", "team_abbrevs", "position_code"), "full_name", q, "player_id", n)


def comps_with_stats(sim: DataFrame, stats: DataFrame, player_id: int, season: int, profile: str) -> DataFrame:
    """A player's comps in rank order with each comp's stat line of that season."""
    mine = sim.filter((F.col("player_id") == player_id) & (F.col("season_id") == season) & (F.col("profile") == profile))
    mine = mine.select(F.col("comp_player_id").alias("player_id"), "season_id", "rank", "similarity_score")
    return mine.join(stats, ["player_id", "season_id"]).orderBy("rank")


def comps(t: Tables, player_id: int | None = None, name: str = "", profile: str = "overall", season: int = CURRENT_SEASON):
    """(player row or None, comps, other matches). Unknown profiles mean 'overall', goalies have only that."""
    if not player_id and not 2 <= len(name.strip()) <= 100:
        raise ValueError("give a player id or a name of 2 to 100 characters")
    matches, is_goalie = find_player(t, player_id, name.strip(), season)
    rows = matches.limit(5).collect()  # at most five
    if not rows:
        return None, None, []
    effective = profile if profile in PROFILES and not is_goalie else "overall"
    stats = t["mart_goalie_season" if is_goalie else "mart_player_season"]
    return rows[0], comps_with_stats(t["mart_player_similarity"], stats, rows[0]["player_id"], season, effective), rows[1:]


def player_shots(t: Tables, player_id: int, rows: int | None = None) -> DataFrame:
    """A shooter's scored attempts, most dangerous first; ``rows`` cuts the list for a page."""
    mine = t["fct_shots"].filter((F.col("shooting_player_id") == player_id) & F.col("xg").isNotNull())
    cols = ["x_coord", "y_coord", "zone_code", "xg", "is_goal", "shot_type", "strength_state"]
    ranked = mine.orderBy(F.desc("xg"), "game_id", "event_id").select(*cols)
    return ranked if rows is None else ranked.limit(rows)


# --- documented analyst queries ---------------------------------------------------------


def penalty_kill_form(t: Tables, team: str, game_number: int = 82) -> DataFrame:
    rows = t["mart_team_special_teams_rolling"].filter((F.col("team_abbrev") == team) & (F.col("game_number") == game_number))
    return rows.select("game_number", "game_date", "opponent", "pk_pct_last_10")


def even_strength_leaders(t: Tables, season: int = CURRENT_SEASON, games: int = 40, n: int = 10) -> DataFrame:
    rows = t["mart_player_season"].filter((F.col("season_id") == season) & (F.col("games_played") >= games))
    return rows.orderBy(F.col("ev_points_per_60").desc_nulls_last(), "player_id").limit(n).select(
        "full_name", "team_abbrevs", "games_played", "ev_points", "ev_toi_minutes_per_gp", "ev_points_per_60"
    )


def power_play_change(t: Tables, now: int = CURRENT_SEASON, before: int = PREVIOUS_SEASON) -> DataFrame:
    teams = t["mart_team_season"]
    prev = teams.filter(F.col("season_id") == before).select("team_id", F.col("pp_pct").alias("pp_before"))
    cur = teams.filter(F.col("season_id") == now).join(prev, "team_id")
    return cur.select(
        "tri_code", "team_name", "pp_before", F.col("pp_pct").alias("pp_now"),
        (F.col("pp_pct") - F.col("pp_before")).alias("improvement"),
    ).orderBy(F.col("improvement").desc_nulls_last(), "tri_code")


def back_to_back_results(t: Tables, team: str) -> DataFrame:
    games = t["fct_team_games"].filter(F.col("team_abbrev") == team)
    return played_previous_day(games, "team_abbrev", "game_date").groupBy("result").agg(F.count("*").alias("games"))


def recent_games(t: Tables, full_name: str, n: int = 10) -> DataFrame:
    return last_n_rows(t["fct_player_games"], "full_name", full_name, "player_game_number", n).select(
        "player_game_number", "game_date", "opponent_abbrev", "goals", "assists", "points", "shots", "toi_minutes"
    )


def cup_winner(t: Tables) -> DataFrame:
    final = t["fct_team_playoff_games"].filter((F.col("round") == 4) & (F.col("result") == "W"))
    return final.orderBy(F.desc("game_date"), F.desc("game_id")).limit(1).select(
        "team_abbrev", "opponent", "goals_for", "goals_against", "game_date"
    )


def playoff_career(t: Tables, full_name: str) -> DataFrame:
    return t["mart_player_playoff_career"].filter(F.col("full_name") == full_name).select(
        "full_name", "playoff_seasons", "games_played", "goals", "assists", "points"
    )


def career_line(t: Tables, full_name: str) -> DataFrame:
    return t["mart_player_career"].filter(F.col("full_name") == full_name).select(
        "full_name", "seasons_played", "first_season_id", "last_season_id", "games_played", "goals", "assists",
        "points", "points_per_gp",
    )


def best_goal_seasons(t: Tables, n: int = 10) -> DataFrame:
    return t["mart_player_season"].orderBy(F.col("goals").desc_nulls_last(), "player_season_key").limit(n).select(
        "full_name", "season_id", "team_abbrevs", "goals", "games_played"
    )


def hottest_players(t: Tables, season: int = CURRENT_SEASON, n: int = 10) -> DataFrame:
    return _final_form(t, season).orderBy(F.col("points_last_10").desc_nulls_last(), "player_id").limit(n).select(
        "full_name", "team_abbrev", "points_last_10", "goals_last_10", "xg_last_10", "finishing_last_10", "form_delta"
    )


def team_xg_leaders(t: Tables, n: int = 10) -> DataFrame:
    return t["mart_team_xg_season"].orderBy(F.col("xg_share").desc_nulls_last(), "team_season_key").limit(n).select(
        "team_abbrev", "xg_share", "xg_for", "goals_for_model", "goals_above_expected_for"
    )


def best_finishers(t: Tables, attempts: int = 100, n: int = 10) -> DataFrame:
    rows = t["mart_player_xg_season"].filter(F.col("unblocked_attempts") >= attempts)
    return rows.orderBy(F.col("goals_above_expected").desc_nulls_last(), "player_season_key").limit(n).select(
        "full_name", "position_group", "goals", "expected_goals", "goals_above_expected", "unblocked_attempts"
    )


def goalie_comps(t: Tables, full_name: str, n: int = 10) -> DataFrame:
    who = t["dim_players"].filter(F.col("full_name") == full_name).select("player_id")
    sim = t["mart_player_similarity"].filter(F.col("profile") == "overall").join(who, "player_id", "left_semi")
    sim = sim.select(F.col("comp_player_id").alias("player_id"), "season_id", "rank", "similarity_score")
    return sim.join(t["mart_goalie_season"], ["player_id", "season_id"]).orderBy("rank").limit(n).select(
        "rank", "full_name", "team_abbrevs", "similarity_score", "save_pct", "games_started"
    )


ANALYST_QUERIES = {
    "penalty_kill_form": penalty_kill_form,
    "even_strength_leaders": even_strength_leaders,
    "power_play_change": power_play_change,
    "back_to_back_results": back_to_back_results,
    "recent_games": recent_games,
    "cup_winner": cup_winner,
    "playoff_career": playoff_career,
    "career_line": career_line,
    "best_goal_seasons": best_goal_seasons,
    "hottest_players": hottest_players,
    "team_xg_leaders": team_xg_leaders,
    "best_finishers": best_finishers,
    "goalie_comps": goalie_comps,
}
