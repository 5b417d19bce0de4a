"""Documents: worked examples, and random games whose flags are looked up by definition."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from puckspark.operators import flatten as fl

HOME, AWAY = 10, 20


def expected(doc):
    """(game, event, second, home, rebound, rush, distance) of every shot, each flag looked up by its definition:
    the latest play of a kind at or before the shot, found among all plays of the game."""
    plays = [p for p in doc["plays"] if p["periodDescriptor"].get("periodType") != "SO"]
    place = {id(p): (p.get("sortOrder") or 0, doc["plays"].index(p)) for p in plays}
    details = lambda p: p.get("details") or {}
    period = lambda p: p["periodDescriptor"].get("number") or 1
    second = lambda p: 1200 * (period(p) - 1) + 60 * int(p["timeInPeriod"][:2]) + int(p["timeInPeriod"][3:])
    team = lambda p: details(p).get("eventOwnerTeamId")
    side = lambda p: team(p) if p["typeDescKey"] != "blocked-shot" else AWAY if team(p) == HOME else HOME
    shots = [p for p in plays if p["typeDescKey"] in fl.SHOT_EVENTS and {"xCoord", "yCoord"} <= set(details(p))]
    latest = lambda found: max(found, key=lambda p: place[id(p)], default=None)
    out = []
    for shot in shots:
        exit_ = latest(p for p in plays if place[id(p)] <= place[id(shot)] and team(p) == side(shot) is not None and details(p).get("zoneCode") in ("N", "D"))
        before = latest(p for p in shots if place[id(p)] < place[id(shot)] and p["typeDescKey"] in fl.UNBLOCKED_EVENTS)
        rebound = (
            shot["typeDescKey"] in fl.UNBLOCKED_EVENTS and before is not None and side(before) == side(shot)
            and period(before) == period(shot) and 0 <= second(shot) - second(before) <= fl.REBOUND_SECONDS)
        rush = exit_ is not None and 0 <= second(shot) - second(exit_) <= fl.RUSH_SECONDS
        net = 89 if (side(shot) == HOME) == (shot["homeTeamDefendingSide"] == "left") else -89
        distance = round(math.dist((net, 0), (details(shot)["xCoord"], details(shot)["yCoord"])), 2)
        out.append((doc["id"], shot["eventId"], second(shot), side(shot) == HOME, rebound, rush, distance))
    return out


def random_game(rng, game_id):
    plays = []
    for i in range(rng.randrange(0, 120)):
        details = {"eventOwnerTeamId": rng.choice([HOME, AWAY, None])}
        if rng.random() < 0.9:
            details |= {"xCoord": rng.randrange(-99, 100), "yCoord": rng.randrange(-42, 43)}
        if rng.random() < 0.7:
            details["zoneCode"] = rng.choice("NDO")
        play = {
            "eventId": i, "typeDescKey": rng.choice([*fl.SHOT_EVENTS, "faceoff", "hit"]), "details": details,
            "timeInPeriod": f"00:{rng.randrange(12):02d}", "homeTeamDefendingSide": rng.choice(["left", "right"]),
            "periodDescriptor": {"number": rng.choice([1, 2]), "periodType": rng.choice(["REG", "REG", "REG", "SO"])},
        }
        if rng.random() < 0.8:
            play["sortOrder"] = rng.randrange(60)
        if rng.random() < 0.05:
            del play["details"]
        plays.append(play)
    return {"id": game_id, "season": 20252026, "homeTeam": {"id": HOME, "abbrev": "HHH"}, "awayTeam": {"id": AWAY, "abbrev": "AAA"}, "plays": plays}


def docs(spark, documents):
    return spark.createDataFrame([(json.dumps(d),) for d in documents], "payload string")


FLAGS = ["game_id", "event_id", "game_seconds", "is_home_team", "is_rebound", "is_rush", "distance_ft"]


def test_random_games(spark):
    rng = random.Random(5)
    games = [random_game(rng, g) for g in range(40)]
    got = fl.flatten_shots(docs(spark, games)).select(*FLAGS).collect()
    want = [row for g in games for row in expected(g)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(r[4] for r in want) and any(r[5] for r in want)


def test_two_documents_of_one_game_stay_apart(spark):
    rng = random.Random(8)
    games = [random_game(rng, 1), random_game(rng, 1), random_game(rng, 1)]
    got = fl.flatten_shots(docs(spark, games)).select(*FLAGS).collect()
    assert sorted(map(tuple, got)) == sorted(row for g in games for row in expected(g))


def play(event, kind, clock, owner, zone="O", x=60, **more):
    return {"eventId": event, "sortOrder": event, "typeDescKey": kind, "timeInPeriod": clock, "homeTeamDefendingSide": "left",
            "periodDescriptor": {"number": 1, "periodType": "REG"}, "details": {"eventOwnerTeamId": owner, "zoneCode": zone, "xCoord": x, "yCoord": 0}, **more}


def worked_game():
    plays = [
        play(1, "hit", "00:10", HOME, "N"),
        play(2, "shot-on-goal", "00:13", HOME),  # three seconds after leaving the zone: rush
        play(3, "goal", "00:16", HOME),  # three seconds after the shot: rebound; six after the exit: no rush
        play(4, "missed-shot", "05:00", AWAY, x=-60),  # nothing before it
        play(5, "blocked-shot", "05:02", HOME, "D"),  # blocked by the home side, so the away side shot
        play(6, "shot-on-goal", "05:03", AWAY, x=-60),  # within three seconds of the away side's miss
    ]
    return {"id": 4, "season": 20252026, "homeTeam": {"id": HOME, "abbrev": "HHH"}, "awayTeam": {"id": AWAY, "abbrev": "AAA"}, "plays": plays}


def test_worked_game_however_often_it_was_landed(spark):
    want = [(2, True, False, True), (3, True, True, False), (4, False, False, False), (5, False, False, False), (6, False, True, False)]
    for copies in (1, 3):
        rows = fl.flatten_shots(docs(spark, [worked_game()] * copies).repartition(copies)).select("event_id", "is_home_team", "is_rebound", "is_rush").collect()
        assert sorted(map(tuple, rows)) == want


@pytest.mark.parametrize("read", [fl.flatten_shots, fl.flatten_boxscores, lambda df: fl.explode_categories(df, [])])
def test_broken_documents_fail(spark, read):
    text = json.dumps(worked_game())
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        read(spark.createDataFrame([(text,), (text[: len(text) // 2],)], "payload string")).collect()


def test_shot_columns(spark):
    play = {
        "eventId": 7, "sortOrder": 3, "typeDescKey": "goal", "timeInPeriod": "01:05", "situationCode": "1451", "homeTeamDefendingSide": "left",
        "periodDescriptor": {"number": 2, "periodType": "REG"},
        "details": {"eventOwnerTeamId": HOME, "zoneCode": "O", "xCoord": 84, "yCoord": -10, "shotType": "wrist", "scoringPlayerId": 99}}
    game = {"id": 2025020001, "season": 20252026, "homeTeam": {"id": HOME, "abbrev": "HHH"}, "awayTeam": {"id": AWAY, "abbrev": "AAA"}, "plays": [play]}
    row = fl.flatten_shots(docs(spark, [game])).first().asDict()
    assert row == {
        "game_id": 2025020001, "event_id": 7, "sort_order": 3, "season_id": 20252026, "period_number": 2, "period_type": "REG",
        "game_seconds": 1265, "event_type": "goal", "is_goal": True, "shot_type": "wrist", "x_coord": 84, "y_coord": -10, "zone_code": "O",
        "distance_ft": 11.18, "angle_deg": 63.43, "team_abbrev": "HHH", "opponent_abbrev": "AAA", "is_home_team": True,
        "shooting_player_id": 99, "goalie_in_net_id": None, "is_empty_net": True, "strength_state": "PP", "is_rebound": False, "is_rush": False}


def test_boxscore_with_missing_sides_and_groups(spark):
    skater = {"playerId": 1, "name": {"default": "A. One"}, "position": "C", "goals": 1, "points": 2, "toi": "12:30", "shifts": 9}
    keeper = {"playerId": 2, "name": {"default": "B. Two"}, "goals": 0, "pim": 2, "toi": "59:00", "saveShotsAgainst": "25/28"}
    base = {"id": 5, "season": 20252026, "gameDate": "2025-10-07", "homeTeam": {"abbrev": "HHH"}, "awayTeam": {"abbrev": "AAA"}}
    games = [
        {**base, "playerByGameStats": {"homeTeam": {"forwards": [skater], "goalies": [keeper]}, "awayTeam": {"defense": [{**skater, "playerId": 3, "toi": None}]}}},
        {**base, "id": 6, "playerByGameStats": {"homeTeam": {"forwards": None}}},
        {**base, "id": 7},
    ]
    got = {r.player_id: r for r in fl.flatten_boxscores(docs(spark, games)).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].team_abbrev, got[1].opponent_abbrev, got[1].is_home, got[1].toi_seconds, got[1].saves) == ("HHH", "AAA", True, 750, None)
    assert (got[2].position_code, got[2].points, got[2].shifts, got[2].saves, got[2].shots_against, got[2].pim) == ("G", None, None, 25, 28, 2)
    assert (got[3].team_abbrev, got[3].is_home, got[3].toi_seconds) == ("AAA", False, None)


def test_categories(spark):
    rail = {"teamGameStats": [{"category": "sog", "awayValue": 30, "homeValue": 25}, {"category": "powerPlay", "awayValue": "0/2", "homeValue": "1/3"}]}
    df = spark.createDataFrame([(1, json.dumps(rail)), (2, "{}")], "game_id long, payload string")
    long = fl.explode_categories(df, ["game_id"])
    assert sorted(map(tuple, long.collect())) == [(1, "powerPlay", "0/2", "1/3"), (1, "sog", "30", "25")]
    wide = fl.pivot_categories(long, ["game_id"], "category", {"a": ("sog", "away_value"), "h": ("powerPlay", "home_value"), "x": ("pim", "home_value")})
    assert tuple(wide.first()) == (1, "30", "1/3", None)


def test_schedule_dedupe_keeps_the_last_copy(spark):
    df = spark.createDataFrame([(1, 2, 0), (1, 2, 5), (2, 1, 1), (3, 3, 1)], "id long, gameType int, seen int")
    assert sorted(map(tuple, fl.dedupe_schedule(df, "id", "gameType", [F.desc("seen")]).collect())) == [(1, 2, 5), (3, 3, 1)]


def test_normalised_shots(spark):
    df = spark.createDataFrame([(-80, 5, "O"), (100, 5, None), (3, 1, "D"), (0, -2, "N")], "x_coord int, y_coord int, zone_code string")
    got = [(r.plot_x, r.plot_y) for r in fl.normalize_shots(df).collect()]
    assert got == [(80, -5), (99, 5), (0, -2)]
