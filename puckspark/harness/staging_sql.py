"""What the staging tables must hold, written out for DuckDB over the newest load of each feed.

Kept apart from the staging code on purpose: nothing here is made from its column maps.
"""

from __future__ import annotations


def _number(field: str, name: str) -> str:
    return f"TRY_CAST({field} AS DOUBLE) AS {name}"


def _recorded(field: str, name: str, total: str) -> str:
    """A statistic counts only in seasons in which its total is above zero."""
    return f"CASE WHEN season_id IN (SELECT season_id FROM {{feed}} GROUP BY season_id HAVING sum({total}) > 0) THEN {field} END AS {name}"


_SKATERS = f"""SELECT season_id, playerId AS player_id, skaterFullName AS full_name, teamAbbrevs AS team_abbrevs, positionCode AS position_code,
  shootsCatches AS shoots_catches, gamesPlayed AS games_played, {_number('timeOnIcePerGame', 'toi_per_gp_seconds')},
  points, goals, assists, {_number('pointsPerGame', 'points_per_game')}, shots, shootingPct AS shooting_pct,
  evPoints AS ev_points, evGoals AS ev_goals, ppPoints AS pp_points, ppGoals AS pp_goals, shPoints AS sh_points, shGoals AS sh_goals,
  otGoals AS ot_goals, gameWinningGoals AS game_winning_goals, plusMinus AS plus_minus, penaltyMinutes AS penalty_minutes,
  {_number('faceoffWinPct', 'faceoff_win_pct')} FROM {{feed}}"""

_REALTIME = f"""SELECT season_id, playerId AS player_id, gamesPlayed AS games_played,
  {_recorded('takeaways', 'takeaways', 'takeaways')}, {_recorded('giveaways', 'giveaways', 'giveaways')},
  {_recorded('hits', 'hits', 'hits')}, {_recorded('hitsPer60', 'hits_per_60', 'hits')},
  {_recorded('blockedShots', 'blocked_shots', 'blockedShots')}, {_recorded('blockedShotsPer60', 'blocked_shots_per_60', 'blockedShots')} FROM {{feed}}"""

_ICE_TIME = f"""SELECT season_id, playerId AS player_id, gamesPlayed AS games_played, shifts, {_number('timeOnIce', 'toi_seconds')},
  {_number('evTimeOnIce', 'ev_toi_seconds')}, {_number('evTimeOnIcePerGame', 'ev_toi_per_gp_seconds')},
  {_number('ppTimeOnIce', 'pp_toi_seconds')}, {_number('ppTimeOnIcePerGame', 'pp_toi_per_gp_seconds')},
  {_number('shTimeOnIce', 'sh_toi_seconds')}, {_number('shTimeOnIcePerGame', 'sh_toi_per_gp_seconds')} FROM {{feed}}"""

_BIOS = """SELECT season_id, playerId AS player_id, CAST(birthDate AS DATE) AS birth_date, birthCountryCode AS birth_country, nationalityCode AS nationality,
  weight AS weight_pounds, height AS height_inches, draftOverall AS draft_overall, draftRound AS draft_round, draftYear AS draft_year,
  currentTeamAbbrev AS current_team_abbrev FROM {feed}"""

_GOALIES = """SELECT season_id, playerId AS player_id, goalieFullName AS full_name, teamAbbrevs AS team_abbrevs, shootsCatches AS shoots_catches,
  gamesStarted AS games_started, gamesPlayed AS games_played, timeOnIce AS toi_seconds, otLosses AS ot_losses, losses, wins, shutouts,
  shotsAgainst AS shots_against, saves, savePct AS save_pct, goalsAgainst AS goals_against, goalsAgainstAverage AS goals_against_average FROM {feed}"""

_TEAM_SEASONS = """SELECT season_id, teamId AS team_id, teamFullName AS team_name, gamesPlayed AS games_played, points, pointPct AS point_pct,
  wins, winsInRegulation AS regulation_wins, winsInShootout AS shootout_wins, losses, otLosses AS ot_losses, teamShutouts AS shutouts,
  goalsFor AS goals_for, goalsForPerGame AS goals_for_per_game, goalsAgainst AS goals_against, goalsAgainstPerGame AS goals_against_per_game,
  shotsForPerGame AS shots_for_per_game, shotsAgainstPerGame AS shots_against_per_game, faceoffWinPct AS faceoff_win_pct,
  powerPlayPct AS pp_pct, powerPlayNetPct AS pp_net_pct, penaltyKillPct AS pk_pct, penaltyKillNetPct AS pk_net_pct FROM {feed}"""

# The standings feed nests two names, which the view gives as abbrev and name.
_STANDINGS = """SELECT season_id, abbrev AS team_abbrev, name AS team_name, divisionName AS division, conferenceName AS conference,
  divisionSequence AS division_rank, conferenceSequence AS conference_rank, leagueSequence AS league_rank, wildcardSequence AS wildcard_rank,
  gamesPlayed AS games_played, wins, losses, otLosses AS ot_losses, points, pointPctg AS point_pct,
  goalFor AS goals_for, goalAgainst AS goals_against, goalDifferential AS goal_differential, streakCode AS streak_code, streakCount AS streak_count FROM {feed}"""

_TEAMS = "SELECT id AS team_id, triCode AS tri_code, fullName AS team_name, franchiseId AS franchise_id FROM {feed}"

_OF_FEED = {
    "skater_summary": _SKATERS, "skater_summary_playoffs": _SKATERS, "skater_realtime": _REALTIME, "skater_realtime_playoffs": _REALTIME,
    "skater_toi": _ICE_TIME, "skater_toi_playoffs": _ICE_TIME, "skater_bios": _BIOS, "goalie_bios": _BIOS, "goalie_summary": _GOALIES,
    "goalie_summary_playoffs": _GOALIES, "team_summary": _TEAM_SEASONS, "team_summary_playoffs": _TEAM_SEASONS, "standings": _STANDINGS, "teams": _TEAMS,
}
STAGING: dict[str, str] = {f"stg_{feed}": sql.replace("{feed}", feed) for feed, sql in _OF_FEED.items()}
