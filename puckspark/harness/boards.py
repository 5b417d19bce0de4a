"""Serving queries over the derived league's marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from puckspark.harness.generic import board
from puckspark.harness.league import CURRENT, PREVIOUS, league, with_inputs
from puckspark.harness.registry import query
from puckspark.operators import quality as dq
from puckspark.operators.flatten import normalize_shots
from puckspark.operators.search import compare_profiles
from puckspark.plans import comps, serving, warehouse, xg


def served(name: str, sql: str | None = None):
    return query(name, with_inputs(sql) if sql else None)


def _boards(*boards: str) -> str:
    return " UNION ALL ".join(f"({b})" for b in boards)


def _line(source: str, value: str, label: str = "full_name", sub: str = "team_abbrevs", key: str = "player_id", where: str = "true") -> str:
    return f"SELECT {key} AS k, {label} AS label, {sub} AS sublabel, {value} AS value FROM {source} WHERE {where}"


NOW = f"season_id = {CURRENT}"
XG_TEAMS = "mart_player_xg_season JOIN (SELECT player_id, season_id, team_abbrevs FROM mart_player_season) USING (player_id, season_id)"
FINAL_FORM = "(SELECT * FROM mart_player_form WHERE games_in_window = 10 AND " + NOW + " QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY player_game_number DESC) = 1)"


@served("season_leaders", _boards(
    board("points", _line("mart_player_season", "points", where=NOW)), board("goals", _line("mart_player_season", "goals", where=NOW)),
    board("hot", _line(FINAL_FORM, "points_last_10", sub="team_abbrev")), board("xg", _line(XG_TEAMS, "expected_goals", key="player_season_key", where=NOW)),
    board("finishing", _line(XG_TEAMS, "goals_above_expected", key="player_season_key", where=f"{NOW} AND unblocked_attempts >= 100")),
    board("save_pct", _line("mart_goalie_season", "save_pct", where=f"{NOW} AND games_started >= 30")),
    board("xg_share", _line("mart_team_xg_season", "xg_share", "team_abbrev", "NULL::VARCHAR", "team_abbrev", NOW))))
def season_leaders(t):
    return serving.season_leaders(league(t), CURRENT)


YEARS = "(first_season_id // 10000) || '-' || (last_season_id % 10000)"
LABEL = "team_abbrevs || ' · ' || (season_id // 10000) || '-' || substr(CAST(season_id % 10000 AS VARCHAR), 3, 2)"


def _record_book(active: bool) -> str:
    mine = "is_active" if active else "true"
    known = "player_id IN (SELECT player_id FROM mart_player_career WHERE is_active)" if active else "true"
    season_key = "player_id || '-' || season_id"
    return _boards(
        board("career_points", _line("mart_player_career", "points", sub=YEARS, where=mine)),
        board("career_goals", _line("mart_player_career", "goals", sub=YEARS, where=mine)),
        board("career_wins", _line("mart_goalie_career", "wins", sub=YEARS, where=mine)),
        board("playoff_points", _line("mart_player_playoff_career", "points", sub="games_played || ' playoff games'", where=known)),
        board("season_goals", _line("mart_player_season", "goals", sub=LABEL, key=season_key, where=known)),
        board("season_points", _line("mart_player_season", "points", sub=LABEL, key=season_key, where=known)))


@served("alltime_leaders", _record_book(False))
def alltime_leaders(t):
    return serving.alltime_leaders(league(t))


@served("alltime_leaders_active", _record_book(True))
def alltime_leaders_active(t):
    return serving.alltime_leaders(league(t), active=True)


@served("suggest_players", f"""SELECT * FROM (SELECT player_id, full_name, team_abbrevs, position_code,
    CASE WHEN list_bool_or(list_transform(string_split(full_name, ' '), lambda x: starts_with(lower(x), 'er 1'))) THEN 1 WHEN contains(lower(full_name), 'er 1') THEN 2 END AS tier
  FROM (SELECT player_id, full_name, team_abbrevs, position_code FROM mart_player_season WHERE {NOW} AND games_played >= 20
    UNION ALL SELECT player_id, full_name, team_abbrevs, position_code FROM mart_goalie_season WHERE {NOW} AND games_played >= 15))
  WHERE tier IS NOT NULL ORDER BY tier, full_name, player_id LIMIT 8""")
def suggest_players(t):
    return serving.suggest_players(league(t), " Ér 1 ", CURRENT)


@served("player_directory", f"""SELECT * FROM (SELECT player_id, full_name, team_abbrevs, position_code FROM mart_player_season WHERE {NOW} AND games_played >= 20
  UNION ALL SELECT player_id, full_name, team_abbrevs, position_code FROM mart_goalie_season WHERE {NOW} AND games_played >= 15)""")
def player_directory(t):
    return serving.player_directory(league(t), CURRENT)


@served("player_shots", """SELECT x_coord, y_coord, zone_code, xg, is_goal, shot_type, strength_state FROM fct_shots
  WHERE shooting_player_id = 1000007 AND xg IS NOT NULL""")
def player_shots(t):
    return serving.player_shots(league(t), 1000007)


@served("shot_map", """SELECT least(abs(x_coord), 99) AS plot_x, CASE WHEN x_coord >= 0 THEN y_coord ELSE -y_coord END AS plot_y, is_goal FROM fct_shots
  WHERE shooting_player_id = 1000007 AND xg IS NOT NULL AND zone_code IS DISTINCT FROM 'D'""")
def shot_map(t):
    return normalize_shots(serving.player_shots(league(t), 1000007)).select("plot_x", "plot_y", "is_goal")


@served("player_comps", f"""SELECT m.*, s.rank, s.similarity_score FROM mart_player_similarity s JOIN mart_player_season m ON m.player_id = s.comp_player_id AND m.season_id = s.season_id
  WHERE s.season_id = {CURRENT} AND s.profile = 'overall' AND s.player_id = (SELECT player_id FROM mart_player_season WHERE {NOW} AND contains(lower(full_name), 'player 7')
  ORDER BY games_played DESC, player_id LIMIT 1)""")
def player_comps(t):
    _, found, _ = serving.comps(league(t), name="player 7", season=CURRENT)
    return found


# Axes of the radar in order, with the percentile each shows.
RADAR = [("Pts", "pct_points_per_gp"), ("Goals", "pct_goals_per_gp"), ("Shots", "pct_shots_per_gp"), ("EV/60", "pct_ev_points_per_60"), ("PP", "pct_pp_points_per_gp"),
         ("TOI", "pct_toi_per_gp"), ("+/-", "pct_plus_minus"), ("Sh%", "pct_shooting"), ("Hits", "pct_hits_per_gp"), ("Blocks", "pct_blocks_per_gp")]


@served("percentile_radar", "SELECT " + " UNION ALL SELECT ".join(
    f"{i} AS position, '{label}' AS axis, coalesce(max({c}) FILTER (player_id = 1000007), 0) AS a, coalesce(max({c}) FILTER (player_id = 1000011), 0) AS b FROM mart_player_season WHERE {NOW}"
    for i, (label, c) in enumerate(RADAR)))
def percentile_radar(t):
    rows = league(t)["mart_player_season"].filter(NOW)
    return compare_profiles(rows, "player_id", 1000007, 1000011, serving.RADAR_AXES)


# --- the documented analyst queries ----------------------------------------------------------


@served("penalty_kill_form", "SELECT game_number, game_date, opponent, pk_pct_last_10 FROM mart_team_special_teams_rolling WHERE team_abbrev = 'T07' AND game_number = 40")
def penalty_kill_form(t):
    return serving.penalty_kill_form(league(t), "T07", 40)


@served("even_strength_leaders", f"""SELECT full_name, team_abbrevs, games_played, ev_points, ev_toi_minutes_per_gp, ev_points_per_60 FROM mart_player_season
  WHERE {NOW} AND games_played >= 40 ORDER BY ev_points_per_60 DESC NULLS LAST, player_id LIMIT 10""")
def even_strength_leaders(t):
    return serving.even_strength_leaders(league(t), CURRENT)


@served("power_play_change", f"""SELECT c.tri_code, c.team_name, p.pp_pct AS pp_before, c.pp_pct AS pp_now, c.pp_pct - p.pp_pct AS improvement
  FROM mart_team_season c JOIN (SELECT * FROM mart_team_season WHERE season_id = {PREVIOUS}) p ON p.team_id = c.team_id WHERE c.{NOW}""")
def power_play_change(t):
    return serving.power_play_change(league(t), CURRENT, PREVIOUS)


@served("back_to_back_results", """SELECT result, CAST(count(*) AS BIGINT) AS games FROM (SELECT *, game_date - 1 IN (SELECT game_date FROM fct_team_games WHERE team_abbrev = 'T07') AS tired
  FROM fct_team_games WHERE team_abbrev = 'T07') WHERE tired GROUP BY result""")
def back_to_back_results(t):
    return serving.back_to_back_results(league(t), "T07")


@served("recent_games", """SELECT player_game_number, game_date, opponent_abbrev, goals, assists, points, shots, toi_minutes FROM fct_player_games WHERE full_name = 'Player 7'
  QUALIFY row_number() OVER (ORDER BY player_game_number DESC) <= 10""")
def recent_games(t):
    return serving.recent_games(league(t), "Player 7")


@served("cup_winner", "SELECT team_abbrev, opponent, goals_for, goals_against, game_date FROM fct_team_playoff_games WHERE round = 4 AND result = 'W' ORDER BY game_date DESC, game_id DESC LIMIT 1")
def cup_winner(t):
    return serving.cup_winner(league(t))


@served("playoff_career", "SELECT full_name, playoff_seasons, games_played, goals, assists, points FROM mart_player_playoff_career WHERE full_name = 'Player 7'")
def playoff_career(t):
    return serving.playoff_career(league(t), "Player 7")


@served("career_line", """SELECT full_name, seasons_played, first_season_id, last_season_id, games_played, goals, assists, points, points_per_gp
  FROM mart_player_career WHERE full_name = 'Player 7'""")
def career_line(t):
    return serving.career_line(league(t), "Player 7")


@served("best_goal_seasons", "SELECT full_name, season_id, team_abbrevs, goals, games_played FROM mart_player_season ORDER BY goals DESC, player_season_key LIMIT 10")
def best_goal_seasons(t):
    return serving.best_goal_seasons(league(t))


@served("hottest_players", f"""SELECT full_name, team_abbrev, points_last_10, goals_last_10, xg_last_10, finishing_last_10, form_delta FROM {FINAL_FORM}
  ORDER BY points_last_10 DESC, player_id LIMIT 10""")
def hottest_players(t):
    return serving.hottest_players(league(t), CURRENT)


@served("team_xg_leaders", "SELECT team_abbrev, xg_share, xg_for, goals_for_model, goals_above_expected_for FROM mart_team_xg_season ORDER BY xg_share DESC, team_season_key LIMIT 10")
def team_xg_leaders(t):
    return serving.team_xg_leaders(league(t))


@served("best_finishers", """SELECT full_name, position_group, goals, expected_goals, goals_above_expected, unblocked_attempts FROM mart_player_xg_season
  WHERE unblocked_attempts >= 10 ORDER BY goals_above_expected DESC, player_season_key LIMIT 10""")
def best_finishers(t):
    return serving.best_finishers(league(t), attempts=10)


@served("goalie_comps", """SELECT s.rank, m.full_name, m.team_abbrevs, s.similarity_score, m.save_pct, m.games_started FROM mart_player_similarity s
  JOIN mart_goalie_season m ON m.player_id = s.comp_player_id AND m.season_id = s.season_id JOIN dim_players d ON d.player_id = s.player_id
  WHERE d.full_name = 'Goalie 7' AND s.profile = 'overall' ORDER BY s.rank LIMIT 10""")
def goalie_comps(t):
    return serving.goalie_comps(league(t), "Goalie 7")


@served("spot_check", """SELECT a.full_name AS player_name, s.rank, b.full_name AS comp_name, s.similarity_score FROM mart_player_similarity s JOIN dim_players a ON a.player_id = s.player_id
  JOIN dim_players b ON b.player_id = s.comp_player_id WHERE s.profile = 'overall' AND s.rank <= 10 AND a.full_name IN ('Player 7', 'Goalie 7', 'Nobody')""")
def spot_check(t):
    g = league(t)
    names = g["dim_players"].select("player_id", "full_name")
    return comps.spot_check(g["mart_player_similarity"], names, ["Player 7", "Goalie 7", "Nobody"])


# --- gates ------------------------------------------------------------------------------------


@served("xg_calibration", f"SELECT sum(xg) AS predicted_goals, CAST(count(*) FILTER (is_goal) AS BIGINT) AS actual_goals FROM fct_shots WHERE xg IS NOT NULL")
def xg_calibration(t):
    return xg.calibration(league(t)["fct_shots"])


@served("xg_top_teams", "SELECT team_abbrev, sum(xg) AS xg FROM fct_shots WHERE xg IS NOT NULL GROUP BY 1 ORDER BY xg DESC, team_abbrev LIMIT 5")
def xg_top_teams(t):
    return xg.top_teams(league(t)["fct_shots"])


_ROUND = "SELECT count(*) FROM (SELECT round FROM fct_team_playoff_games WHERE round NOT IN (1, 2, 3, 4) GROUP BY 1)"


@served("mart_checks", f"""SELECT 'season length' AS "check", CAST((SELECT count(*) FROM (SELECT team_abbrev FROM fct_team_games GROUP BY 1 HAVING count(*) <> 82)) AS BIGINT) AS failures
  UNION ALL SELECT 'playoff rounds', CAST(({_ROUND}) AS BIGINT) 
  UNION ALL SELECT 'game keys', CAST((SELECT count(*) FROM (SELECT game_id, team_abbrev FROM fct_team_games GROUP BY 1, 2 HAVING count(*) > 1)) AS BIGINT)
  UNION ALL SELECT 'save share since tracking', CAST((SELECT count(*) FROM mart_goalie_season WHERE save_pct IS NULL AND season_id >= 19951996) AS BIGINT)""")
def mart_checks(t):
    g = league(t)
    return dq.summary({
        "season length": dq.group_count(g["fct_team_games"], "team_abbrev", warehouse.SEASON_GAMES),
        "playoff rounds": dq.ListCheck(g["fct_team_playoff_games"], "round", (1, 2, 3, 4)),
        "game keys": dq.unique(g["fct_team_games"], "game_team_key"),
        "save share since tracking": dq.absent(g["mart_goalie_season"], "save_pct", F.col("season_id") >= 19951996)})
