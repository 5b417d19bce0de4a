"""Declared schemas of the landed feeds (never inferred). Field names are the feed's own."""

from __future__ import annotations

_SKATER_SUMMARY = """
    playerId long, season_id long, skaterFullName string, positionCode string, teamAbbrevs string,
    shootsCatches string, gamesPlayed long, goals long, assists long, points long, plusMinus long,
    penaltyMinutes long, ppGoals long, ppPoints long, shGoals long, shPoints long, evGoals long,
    evPoints long, gameWinningGoals long, otGoals long, shots long, shootingPct double,
    faceoffWinPct string, pointsPerGame string, timeOnIcePerGame string
"""
_SKATER_REALTIME = """
    playerId long, season_id long, gamesPlayed long, hits long, blockedShots long, giveaways long,
    takeaways long, hitsPer60 double, blockedShotsPer60 double
"""
_SKATER_TOI = """
    playerId long, season_id long, gamesPlayed long, shifts long, timeOnIce string, evTimeOnIce string,
    ppTimeOnIce string, shTimeOnIce string, evTimeOnIcePerGame string, ppTimeOnIcePerGame string,
    shTimeOnIcePerGame string
"""
_BIOS = """
    playerId long, season_id long, birthDate string, birthCountryCode string, nationalityCode string,
    height long, weight long, draftYear long, draftRound long, draftOverall long, currentTeamAbbrev string
"""
_GOALIE_SUMMARY = """
    playerId long, season_id long, goalieFullName string, teamAbbrevs string, shootsCatches string,
    gamesPlayed long, gamesStarted long, wins long, losses long, otLosses long, savePct double,
    goalsAgainstAverage double, saves long, shotsAgainst long, goalsAgainst long, shutouts long,
    timeOnIce long
"""
_TEAM_SUMMARY = """
    teamId long, season_id long, teamFullName string, gamesPlayed long, wins long, losses long,
    otLosses long, winsInRegulation long, winsInShootout long, points long, pointPct double,
    goalsFor long, goalsAgainst long, goalsForPerGame double, goalsAgainstPerGame double,
    powerPlayPct double, penaltyKillPct double, powerPlayNetPct double, penaltyKillNetPct double,
    shotsForPerGame double, shotsAgainstPerGame double, faceoffWinPct double, teamShutouts long
"""
_STANDINGS = """
    teamAbbrev struct<default: string>, teamName struct<default: string>, season_id long, seasonId long,
    conferenceName string, divisionName string, gamesPlayed long, wins long, losses long,
    otLosses long, points long, pointPctg double, goalFor long, goalAgainst long,
    goalDifferential long, leagueSequence long, conferenceSequence long, divisionSequence long,
    wildcardSequence long, streakCode string, streakCount long
"""
_PLAYER_GAMES = """
    game_id long, season_id long, game_date string, team_abbrev string, opponent_abbrev string,
    is_home boolean, player_id long, full_name string, position_code string, goals long,
    assists long, points long, plus_minus long, pim long, hits long, blocked_shots long,
    pp_goals long, shots long, faceoff_pct double, toi_seconds long, shifts long, saves long,
    shots_against long
"""
_SHOTS = """
    game_id long, event_id long, sort_order long, season_id long, period_number long,
    period_type string, game_seconds long, event_type string, is_goal boolean, shot_type string,
    x_coord long, y_coord long, zone_code string, distance_ft double, angle_deg double,
    team_abbrev string, opponent_abbrev string, is_home_team boolean, shooting_player_id long,
    goalie_in_net_id long, is_empty_net boolean, strength_state string, is_rebound boolean,
    is_rush boolean
"""
_DOCUMENT = "game_id long, season_id long, payload string"

_FEEDS = {
    "raw_skater_summary": _SKATER_SUMMARY,
    "raw_skater_summary_playoffs": _SKATER_SUMMARY,
    "raw_skater_realtime": _SKATER_REALTIME,
    "raw_skater_realtime_playoffs": _SKATER_REALTIME,
    "raw_skater_toi": _SKATER_TOI,
    "raw_skater_toi_playoffs": _SKATER_TOI,
    "raw_skater_bios": _BIOS,
    "raw_goalie_bios": _BIOS,
    "raw_goalie_summary": _GOALIE_SUMMARY,
    "raw_goalie_summary_playoffs": _GOALIE_SUMMARY,
    "raw_team_summary": _TEAM_SUMMARY,
    "raw_team_summary_playoffs": _TEAM_SUMMARY,
    "raw_standings": _STANDINGS,
    "raw_teams": "id long, fullName string, triCode string, franchiseId long",
    "raw_schedule": _DOCUMENT,
    "raw_rightrail": _DOCUMENT,
    "raw_player_games": _PLAYER_GAMES,
    "raw_shots": _SHOTS,
}
LOADED_AT = "_loaded_at"
RAW = {name: " ".join(f"{ddl}, {LOADED_AT} timestamp".split()) for name, ddl in _FEEDS.items()}

_SKATER = """struct<playerId: bigint, name: struct<default: string>, position: string, goals: bigint,
    assists: bigint, points: bigint, plusMinus: bigint, pim: bigint, hits: bigint, blockedShots: bigint,
    powerPlayGoals: bigint, sog: bigint, faceoffWinningPctg: double, toi: string, shifts: bigint,
    saveShotsAgainst: string>"""
_SIDE = f"struct<forwards: array<{_SKATER}>, defense: array<{_SKATER}>, goalies: array<{_SKATER}>>"
BOXSCORE = " ".join(f"""id bigint, season bigint, gameDate string, homeTeam struct<abbrev: string>,
    awayTeam struct<abbrev: string>, playerByGameStats struct<homeTeam: {_SIDE}, awayTeam: {_SIDE}>""".split())

SCHEDULE = " ".join("""gameDate string, gameState string, startTimeUTC string,
    homeTeam struct<abbrev: string, score: string>, awayTeam struct<abbrev: string, score: string>,
    gameOutcome struct<lastPeriodType: string>, venue struct<default: string>""".split())

RIGHT_RAIL = "teamGameStats array<struct<category: string, awayValue: string, homeValue: string>>"

_TEAM = "struct<id: bigint, abbrev: string>"
PLAY_BY_PLAY = " ".join(f"""id bigint, season bigint, homeTeam {_TEAM}, awayTeam {_TEAM},
    plays array<struct<eventId: bigint, sortOrder: bigint, typeDescKey: string, timeInPeriod: string,
        situationCode: string, homeTeamDefendingSide: string,
        periodDescriptor: struct<number: bigint, periodType: string>,
        details: struct<eventOwnerTeamId: bigint, zoneCode: string, xCoord: bigint, yCoord: bigint,
            shotType: string, shootingPlayerId: bigint, scoringPlayerId: bigint, goalieInNetId: bigint>>>
    """.split())
