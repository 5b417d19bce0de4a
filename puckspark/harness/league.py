"""A league derived from the benchmark tables, to run the staging and mart plans end to end.

Orders are games and skater lines, line items are goalie lines and shots, nations are
teams; orders from October on are playoffs. ``FEEDS`` holds the newest load of every
feed as SQL that Spark and DuckDB both accept. Spark adds stale loads, wraps the game
feeds into JSON documents and runs the library; the SQL counterparts start from the
same feeds and are written apart from the library.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puckspark.harness.comps_sql import similarity_sql
from puckspark.harness.registry import R, Tables, query
from puckspark.harness.staging_sql import STAGING
from puckspark.operators.flatten import explode_plays, flatten_boxscores, flatten_shots
from puckspark.plans import comps, marts, serving, staging, xg
from puckspark.session import TIGHT, Pins, pin

CURRENT, PREVIOUS = 20002001, 19992000
BASE_TABLES = ("orders", "lineitem", "nation", "supplier", "customer")


def season(day: str) -> str:
    return f"CAST(year({day}) AS BIGINT) * 10000 + year({day}) + 1"


def two(e: str) -> str:
    return f"lpad(CAST({e} AS STRING), 2, '0')"


def count(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


def kind(day: str, playoffs: bool) -> str:
    return f"month({day}) {'>=' if playoffs else '<'} 10"


URGENT, HIGH = "o_orderpriority = '1-URGENT'", "o_orderpriority IN ('1-URGENT', '2-HIGH')"
GAME_ID = f"""(CAST(year(o_orderdate) AS BIGINT) * 100 + CASE WHEN {kind('o_orderdate', True)} THEN 3 ELSE 2 END) * 10000000000
  + (o_orderkey % 10000) * 1000000 + CAST(floor(o_orderkey / 10000) AS BIGINT)"""
HOME, AWAY = f"'T' || {two('o_custkey % 25')}", f"'T' || {two('(o_custkey % 25 + 1 + o_orderkey % 24) % 25')}"


def skater_summary(playoffs: bool) -> str:
    return f"""SELECT 1000000 + o_custkey AS playerId, {season('o_orderdate')} AS season_id,
  'Player ' || CAST(o_custkey AS STRING) AS skaterFullName,
  CASE (o_custkey + year(o_orderdate)) % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'C' ELSE 'L' END AS positionCode,
  CASE WHEN o_custkey % 5 = 0 THEN 'T{{}}, T' || {two('year(o_orderdate) % 25')} ELSE 'T' || {two('o_custkey % 25')} END AS teamAbbrevs,
  CASE WHEN o_custkey % 2 = 0 THEN 'L' ELSE 'R' END AS shootsCatches, CAST(10 * count(*) AS BIGINT) AS gamesPlayed,
  {count(URGENT)} AS goals, {count(HIGH)} - {count(URGENT)} AS assists, {count(HIGH)} AS points,
  {count("o_orderstatus = 'F'")} - {count("o_orderstatus = 'O'")} AS plusMinus, 2 * {count("o_orderstatus = 'P'")} AS penaltyMinutes,
  {count(URGENT + " AND o_orderstatus = 'F'")} AS ppGoals, {count(HIGH + " AND o_orderstatus = 'F'")} AS ppPoints,
  {count(URGENT + " AND o_orderstatus = 'P'")} AS shGoals, {count(HIGH + " AND o_orderstatus = 'P'")} AS shPoints,
  {count(URGENT + " AND o_orderstatus = 'O'")} AS evGoals, {count(HIGH + " AND o_orderstatus = 'O'")} AS evPoints,
  {count(URGENT + " AND o_orderstatus <> 'P'")} AS gameWinningGoals, CAST(0 AS BIGINT) AS otGoals,
  CASE WHEN year(o_orderdate) >= 1997 THEN CAST(3 * count(*) AS BIGINT) END AS shots,
  CASE WHEN year(o_orderdate) >= 1997 THEN CAST({count(URGENT)} AS DOUBLE) / (3 * count(*)) END AS shootingPct,
  CASE WHEN o_custkey % 4 = 0 THEN 'n/a' ELSE '0.' || CAST(40 + o_custkey % 20 AS STRING) END AS faceoffWinPct,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 3 AS STRING) END AS pointsPerGame,
  CAST(600 + o_custkey % 700 AS STRING) AS timeOnIcePerGame
FROM orders WHERE {kind('o_orderdate', playoffs)} GROUP BY o_custkey, year(o_orderdate)""".replace("T{}", "T99")


def skater_realtime(playoffs: bool) -> str:
    """Only players with a medium-priority order report; hits are zero before 1998."""
    return f"""SELECT 1000000 + o_custkey AS playerId, {season('o_orderdate')} AS season_id, CAST(10 * count(*) AS BIGINT) AS gamesPlayed,
  CASE WHEN year(o_orderdate) < 1998 THEN 0 ELSE {count("o_orderpriority = '3-MEDIUM'")} END AS hits,
  {count("o_orderpriority = '4-NOT SPECIFIED'")} AS blockedShots, {count("o_orderpriority = '5-LOW'")} AS giveaways,
  {count("o_orderstatus = 'F'")} AS takeaways, CAST({count("o_orderpriority = '3-MEDIUM'")} AS DOUBLE) / 2 AS hitsPer60,
  CAST({count("o_orderstatus = 'F'")} AS DOUBLE) / 4 AS blockedShotsPer60
FROM orders WHERE {kind('o_orderdate', playoffs)} GROUP BY o_custkey, year(o_orderdate) HAVING max(o_orderpriority) >= '3-MEDIUM'"""


def skater_toi(playoffs: bool) -> str:
    text = lambda e: f"CASE WHEN year(o_orderdate) < 1996 THEN 'NA' ELSE CAST({e} AS STRING) END"
    return f"""SELECT 1000000 + o_custkey AS playerId, {season('o_orderdate')} AS season_id, CAST(10 * count(*) AS BIGINT) AS gamesPlayed,
  CASE WHEN year(o_orderdate) < 1996 THEN NULL ELSE CAST(25 * count(*) AS BIGINT) END AS shifts,
  {text('count(*) * (600 + o_custkey % 700)')} AS timeOnIce, {text('count(*) * (500 + o_custkey % 700)')} AS evTimeOnIce,
  {text('count(*) * (o_custkey % 60)')} AS ppTimeOnIce, {text('count(*) * 40')} AS shTimeOnIce,
  {text('500 + o_custkey % 700')} AS evTimeOnIcePerGame, {text('o_custkey % 60')} AS ppTimeOnIcePerGame, {text('40')} AS shTimeOnIcePerGame
FROM orders WHERE {kind('o_orderdate', playoffs)} GROUP BY o_custkey, year(o_orderdate)"""


def bios(key: str, day: str, table: str, base: int) -> str:
    return f"""SELECT {base} + {key} AS playerId, {season(day)} AS season_id,
  CAST(1960 + {key} % 25 AS STRING) || '-' || {two(f'1 + {key} % 12')} || '-' || {two(f'1 + {key} % 28')} AS birthDate,
  CASE WHEN {key} % 2 = 0 THEN 'CAN' ELSE 'USA' END AS birthCountryCode, CASE WHEN {key} % 2 = 0 THEN 'CAN' ELSE 'USA' END AS nationalityCode,
  70 + {key} % 8 AS height, 180 + {key} % 50 AS weight, CASE WHEN {key} % 3 = 0 THEN NULL ELSE 1980 + {key} % 20 END AS draftYear,
  1 + {key} % 7 AS draftRound, 1 + {key} % 200 AS draftOverall, 'T' || {two(f'{key} % 25')} AS currentTeamAbbrev
FROM {table} WHERE {key} % 10 <> 9 GROUP BY {key}, year({day})"""


def goalie_summary(playoffs: bool) -> str:
    shots = lambda e: f"CASE WHEN year(l_shipdate) >= 1997 THEN {e} END"
    qty = "CAST(sum(l_quantity) AS BIGINT)"
    return f"""SELECT 3000000 + l_suppkey AS playerId, {season('l_shipdate')} AS season_id, 'Goalie ' || CAST(l_suppkey AS STRING) AS goalieFullName,
  CASE WHEN l_suppkey % 5 = 0 THEN 'T01, T' || {two('year(l_shipdate) % 25')} ELSE 'T' || {two('l_suppkey % 25')} END AS teamAbbrevs,
  'L' AS shootsCatches, CAST(count(*) AS BIGINT) AS gamesPlayed, {count("l_linestatus = 'O'")} AS gamesStarted,
  {count("l_linestatus = 'O' AND l_returnflag <> 'R'")} AS wins, {count("l_linestatus = 'O' AND l_returnflag = 'R'")} AS losses,
  {count("l_linestatus = 'F' AND l_returnflag = 'R'")} AS otLosses, {shots(f'CAST({qty} - count(*) AS DOUBLE) / {qty}')} AS savePct,
  CAST(count(*) AS DOUBLE) / 8 AS goalsAgainstAverage, {shots(f'{qty} - CAST(count(*) AS BIGINT)')} AS saves, {shots(qty)} AS shotsAgainst,
  CAST(count(*) AS BIGINT) AS goalsAgainst, {count('l_tax = 0')} AS shutouts, CAST(3600 * count(*) + l_suppkey AS BIGINT) AS timeOnIce
FROM lineitem WHERE {kind('l_shipdate', playoffs)} GROUP BY l_suppkey, year(l_shipdate)"""


def team_summary(playoffs: bool) -> str:
    """Teams with a number divisible by 5 get a new id from 1999."""
    d = lambda e: f"CAST({e} AS DOUBLE)"
    team = "o_custkey % 25 + CASE WHEN o_custkey % 5 = 0 AND year(o_orderdate) >= 1999 THEN 100 ELSE 0 END"
    return f"""SELECT {team} AS teamId, {season('o_orderdate')} AS season_id, 'Team ' || CAST({team} AS STRING) AS teamFullName,
  CAST(count(*) AS BIGINT) AS gamesPlayed, {count("o_orderstatus = 'F'")} AS wins, {count("o_orderstatus = 'O'")} AS losses, {count("o_orderstatus = 'P'")} AS otLosses,
  {count(URGENT)} AS winsInRegulation, {count(HIGH)} AS winsInShootout, 2 * {count("o_orderstatus = 'F'")} AS points,
  {d(count("o_orderstatus = 'F'"))} / count(*) AS pointPct, {count(HIGH)} AS goalsFor, {count("o_orderpriority = '5-LOW'")} AS goalsAgainst,
  {d(count(HIGH))} / count(*) AS goalsForPerGame, {d(count("o_orderpriority = '5-LOW'"))} / count(*) AS goalsAgainstPerGame,
  {d(count(URGENT))} / count(*) AS powerPlayPct, {d(count(URGENT))} / (count(*) + 1) AS penaltyKillPct, {d(count(URGENT))} / (count(*) + 2) AS powerPlayNetPct,
  {d(count(URGENT))} / (count(*) + 3) AS penaltyKillNetPct, {d('max(o_orderkey % 40)')} AS shotsForPerGame, {d('min(o_orderkey % 40)')} AS shotsAgainstPerGame,
  {d('max(o_custkey % 10)')} / 10 AS faceoffWinPct, {count(URGENT)} AS teamShutouts
FROM orders WHERE {kind('o_orderdate', playoffs)}
GROUP BY {team}, year(o_orderdate)"""


def _skater(offset: int, own: str, other: str, is_home: str, group: str, m: int) -> str:
    """One skater per side and group of every game, with numbers read off the keys."""
    k = f"(o_orderkey + {m})"
    return f"""SELECT {GAME_ID} AS game_id, {season('o_orderdate')} AS season_id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS game_date, {own} AS team_abbrev,
  {other} AS opponent_abbrev, {is_home} AS is_home, 1000000 + o_custkey + {offset} AS player_id, 'P. ' || CAST(o_custkey + {offset} AS STRING) AS full_name,
  '{'D' if group == 'defense' else 'C'}' AS position_code, {k} % 3 AS goals, {k} % 4 AS assists, {k} % 3 + {k} % 4 AS points, {k} % 5 - 2 AS plus_minus,
  2 * ({k} % 2) AS pim, {k} % 6 AS hits, {k} % 3 AS blocked_shots, CASE WHEN {k} % 9 = 0 THEN 1 ELSE 0 END AS pp_goals, {k} % 7 AS shots,
  CAST({k} % 8 AS DOUBLE) / 8 AS faceoff_pct, (10 + {k} % 15) * 60 + {k} % 60 AS toi_seconds, 20 + {k} % 9 AS shifts, CAST(NULL AS BIGINT) AS saves, CAST(NULL AS BIGINT) AS shots_against
FROM orders"""


def _goalie(offset: int, own: str, other: str, is_home: str) -> str:
    """A third of the save texts are unreadable; a tenth of the goalies have no ice time."""
    k = f"(o_orderkey + {offset})"
    null = "CAST(NULL AS BIGINT)"
    return f"""SELECT {GAME_ID}, {season('o_orderdate')}, CAST(CAST(o_orderdate AS DATE) AS STRING), {own}, {other}, {is_home},
  3000000 + (o_custkey + {offset}) % 100, 'G. ' || CAST((o_custkey + {offset}) % 100 AS STRING), 'G', CAST(0 AS BIGINT), {k} % 2, {null}, {null}, 2 * ({k} % 2),
  {null}, {null}, {null}, {null}, CAST(NULL AS DOUBLE), CASE WHEN {k} % 10 <> 0 THEN 3540 + {k} % 60 END, {null},
  CASE WHEN {k} % 3 <> 0 THEN 20 + {k} % 9 END, CASE WHEN {k} % 3 <> 0 THEN 21 + {k} % 9 + {k} % 4 END FROM orders"""


FEEDS = {
    "skater_summary": skater_summary(False),
    "skater_summary_playoffs": skater_summary(True),
    "skater_realtime": skater_realtime(False),
    "skater_realtime_playoffs": skater_realtime(True),
    "skater_toi": skater_toi(False),
    "skater_toi_playoffs": skater_toi(True),
    "skater_bios": bios("o_custkey", "o_orderdate", "orders", 1000000),
    "goalie_bios": bios("l_suppkey", "l_shipdate", "lineitem", 3000000),
    "goalie_summary": goalie_summary(False),
    "goalie_summary_playoffs": goalie_summary(True),
    "team_summary": team_summary(False),
    "team_summary_playoffs": team_summary(True),
    "teams": f"""SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS fullName, 'T' || {two('n_nationkey')} AS triCode, CAST(n_regionkey AS BIGINT) AS franchiseId FROM nation
UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), 'New ' || n_name, 'T' || {two('n_nationkey')}, CAST(n_regionkey AS BIGINT) FROM nation""",
    "standings": f"""SELECT 'T' || {two('n_nationkey')} AS abbrev, n_name AS name, CAST(20012002 AS BIGINT) AS season_id,
  CASE WHEN n_regionkey % 2 = 0 THEN 'East' ELSE 'West' END AS conferenceName, 'Region ' || CAST(n_regionkey AS STRING) AS divisionName,
  {', '.join(f'CAST(n_nationkey * {i} % 83 AS BIGINT) AS {c}' for i, c in enumerate(
      'gamesPlayed wins losses otLosses points goalFor goalAgainst goalDifferential leagueSequence conferenceSequence divisionSequence wildcardSequence'.split(), 3))},
  CAST(n_nationkey AS DOUBLE) / 32 AS pointPctg, 'W' AS streakCode, CAST(n_nationkey % 4 AS BIGINT) AS streakCount FROM nation WHERE n_regionkey <> 4""",
    "schedule": f"""SELECT {GAME_ID} AS game_id, {season('o_orderdate')} AS season_id, CAST(o_orderdate AS DATE) AS game_date, 'OFF' AS game_state, {HOME} AS home_abbrev, {AWAY} AS away_abbrev,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderkey % 7 END AS home_score,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN NULL ELSE (o_orderkey * 3) % 5 END AS away_score,
  CASE o_orderstatus WHEN 'F' THEN 'REG' WHEN 'O' THEN 'OT' ELSE 'SO' END AS last_period_type, 'Rink ' || CAST(o_custkey AS STRING) AS venue FROM orders""",
    "rightrail": f"""SELECT {GAME_ID} AS game_id, {season('o_orderdate')} AS season_id, 20 + o_orderkey % 15 AS away_sog, 20 + o_custkey % 15 AS home_sog,
  o_orderkey % 3 AS away_pp_goals, o_orderkey % 3 + o_orderkey % 4 AS away_pp_opportunities, o_custkey % 2 AS home_pp_goals, o_custkey % 2 + o_orderkey % 5 AS home_pp_opportunities,
  2 * (o_orderkey % 9) AS away_pim, 2 * (o_custkey % 9) AS home_pim, o_orderkey % 31 AS away_hits, o_custkey % 31 AS home_hits, o_orderkey % 17 AS away_blocked_shots,
  o_custkey % 17 AS home_blocked_shots, o_orderkey % 11 AS away_giveaways, o_custkey % 11 AS home_giveaways, o_orderkey % 13 AS away_takeaways, o_custkey % 13 AS home_takeaways,
  CAST(o_orderkey % 16 AS DOUBLE) / 16 AS away_faceoff_pct, CAST(15 - o_orderkey % 16 AS DOUBLE) / 16 AS home_faceoff_pct
FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority <> '5-LOW'""",
    "player_games": "\nUNION ALL ".join([
        _skater(0, HOME, AWAY, "true", "forwards", 1), _skater(1, HOME, AWAY, "true", "defense", 2), _skater(2, AWAY, HOME, "false", "forwards", 3),
        _goalie(4, HOME, AWAY, "true"), _goalie(5, AWAY, HOME, "false")]),
    "shots": f"""SELECT {GAME_ID} AS game_id, (l_partkey * 1000000 + l_suppkey) * 10 + l_linenumber AS event_id, {season('o_orderdate')} AS season_id,
  CAST(1 + l_linenumber % 3 AS BIGINT) AS period_number, 'REG' AS period_type, CAST(l_quantity * 24 AS BIGINT) AS game_seconds,
  CASE WHEN l_returnflag = 'R' AND l_discount < 0.03 THEN 'goal' WHEN l_tax = 0 THEN 'blocked-shot' WHEN l_returnflag = 'N' THEN 'missed-shot' ELSE 'shot-on-goal' END AS event_type,
  l_returnflag = 'R' AND l_discount < 0.03 AS is_goal, CASE WHEN l_linenumber < 6 THEN 'type ' || CAST(l_linenumber AS STRING) END AS shot_type,
  CAST(l_quantity AS BIGINT) + 39 AS x_coord, CAST(l_suppkey % 85 - 42 AS BIGINT) AS y_coord, CASE WHEN l_tax < 0.01 THEN 'D' WHEN l_tax < 0.07 THEN 'O' END AS zone_code,
  CAST(l_quantity AS DOUBLE) AS distance_ft, CAST(l_suppkey % 80 AS DOUBLE) AS angle_deg,
  CASE WHEN l_linestatus = 'O' THEN {HOME} ELSE {AWAY} END AS team_abbrev, CASE WHEN l_linestatus = 'O' THEN {AWAY} ELSE {HOME} END AS opponent_abbrev,
  l_linestatus = 'O' AS is_home_team, CASE WHEN l_linestatus = 'O' THEN 1000000 + o_custkey ELSE 1000000 + o_custkey + 2 END AS shooting_player_id,
  CASE WHEN l_discount < 0.1 THEN 3000000 + l_suppkey END AS goalie_in_net_id, l_discount >= 0.1 AS is_empty_net,
  CASE l_linenumber % 3 WHEN 0 THEN 'PP' WHEN 1 THEN 'EV' ELSE 'SH' END AS strength_state, l_linenumber = 2 AS is_rebound, l_tax > 0.06 AS is_rush
FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount, max(l_tax) AS l_tax,
    max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS lines
  JOIN orders ON o_orderkey = l_orderkey""",
}

NEW, OLD = "2026-01-02 00:00:00", "2026-01-01 00:00:00"


_leagues: dict[tuple[str, str], League] = {}


def league(t: Tables) -> League:
    """The one warehouse of this session and folder. Like any warehouse it keeps the tables
    that later plans read, so a mart is timed from its stored inputs."""
    return _leagues.setdefault((t.spark.sparkContext.applicationId, t.folder), League(t))


class League:
    """Raw, staging and mart frames by name; the inputs of other frames are stored on first use."""

    def __init__(self, t: Tables):
        self.t = t
        self.frames: dict[str, DataFrame] = {}

    def feed(self, name: str) -> DataFrame:
        text = FEEDS[name]
        for b in BASE_TABLES:
            text = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", text)
        inputs = {b: self.t.spread(b) for b in BASE_TABLES if f"{{{b}}}" in text}
        if name in _DEALT:  # the grouping and the join that follow find the rows where they need them
            table, key = _DEALT[name]
            inputs[table] = inputs[table].repartition(key)
        return self.t.spark.sql(text, **inputs)

    def raw(self, name: str) -> DataFrame:
        """The feed as landed: JSON documents where it has them, plus an older load of every row."""
        df = _DOCUMENTS.get(name, lambda f: f)(self.feed(name))
        both = df.withColumn("_new", F.explode(F.array(F.lit(True), F.lit(False))))  # the feed is worked out once for both loads
        stale = {c: F.when(F.col("_new"), F.col(c)) for c in df.columns if c in _STALE}
        loaded = F.when(F.col("_new"), F.lit(NEW)).otherwise(F.lit(OLD)).cast("timestamp")
        return both.withColumns({**stale, "_loaded_at": loaded}).drop("_new")

    def __getitem__(self, name: str) -> DataFrame:
        """A stored table for the plans that read it, as after a publish. What its build stored on the way goes with that."""
        if name in _VIEWS and name not in self.frames:
            self.frames[name] = self.build(name)
        elif name not in self.frames:
            with Pins(self.t.spark):
                self.frames[name] = pin(self.build(name), owned=False, codec=TIGHT)
        return self.frames[name]

    def build(self, name: str) -> DataFrame:
        if name.startswith("stg_"):
            feed = name[4:]
            source = {"team_game_stats": "rightrail"}.get(feed, feed)
            raw_name = f"raw_{source}"
            return staging.build_staging({raw_name: self.raw(source)})[name]
        builders = {
            "dim_teams": lambda t: marts.dim_teams(t, CURRENT),
            "fct_shots": _shots_with_given_xg,
            "mart_player_career": lambda t: marts.mart_player_career(t, CURRENT),
            "mart_goalie_career": lambda t: marts.mart_goalie_career(t, CURRENT),
            "mart_player_similarity": lambda t: comps.mart_player_similarity(t, CURRENT, PREVIOUS),
        }
        return builders.get(name, getattr(marts, name, None))(self)


# Feed -> (table, key): grouped by keys that hold this one, and joined on it; each would deal the rows by its own keys.
_DEALT = {"shots": ("lineitem", "l_orderkey")}
# Column arithmetic over one stored table, which would only be stored a second time.
_VIEWS = {"fct_shots"}
# Columns emptied in the older load, so that a wrong choice of load shows.
_STALE = {"goals", "hits", "timeOnIce", "birthDate", "saves", "teamFullName", "fullName", "wins", "team_abbrev", "shot_type"}


def _wrapped(df: DataFrame, doc) -> DataFrame:
    return df.select("game_id", "season_id", F.to_json(doc).alias("payload"))


def _schedule_docs(df: DataFrame) -> DataFrame:
    side = lambda s: F.struct(F.col(f"{s}_abbrev").alias("abbrev"), F.col(f"{s}_score").alias("score")).alias(f"{s}Team")
    return _wrapped(df, F.struct(
        F.col("game_date").cast("string").alias("gameDate"), F.col("game_state").alias("gameState"), side("home"), side("away"),
        F.concat(F.col("game_date").cast("string"), F.lit("T23:00:00Z")).alias("startTimeUTC"),
        F.struct(F.col("last_period_type").alias("lastPeriodType")).alias("gameOutcome"), F.struct(F.col("venue").alias("default")).alias("venue")))


def _rail_docs(df: DataFrame) -> DataFrame:
    pair = lambda s: F.concat_ws("/", F.col(f"{s}_pp_goals").cast("string"), F.col(f"{s}_pp_opportunities").cast("string"))
    values = {"powerPlay": (pair("away"), pair("home"))} | {
        cat: (F.col(f"away_{stem}").cast("string"), F.col(f"home_{stem}").cast("string"))
        for cat, stem in {"sog": "sog", "pim": "pim", "hits": "hits", "blockedShots": "blocked_shots", "giveaways": "giveaways",
                          "takeaways": "takeaways", "faceoffWinningPctg": "faceoff_pct"}.items()}
    rows = [F.struct(F.lit(c).alias("category"), a.alias("awayValue"), h.alias("homeValue")) for c, (a, h) in values.items()]
    return _wrapped(df, F.struct(F.array(*rows).alias("teamGameStats")))


def _standing_rows(df: DataFrame) -> DataFrame:
    return df.select(F.struct(F.col("abbrev").alias("default")).alias("teamAbbrev"), F.struct(F.col("name").alias("default")).alias("teamName"),
                     *[c for c in df.columns if c not in ("abbrev", "name")])


_DOCUMENTS = {"schedule": _schedule_docs, "rightrail": _rail_docs, "standings": _standing_rows}


def boxscore_docs(t: Tables) -> DataFrame:
    """A boxscore document per order, by projection: two home skaters and a goalie, one away
    skater and a goalie, no away defense."""
    from puckspark.functions.scalars import season_of_year
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def clock(seconds):
        return F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)

    def skater(offset, m, position):
        k = key + m
        return F.struct(
            (1000000 + cust + offset).alias("playerId"), F.struct(F.concat(F.lit("P. "), cust + offset).alias("default")).alias("name"),
            F.lit(position).alias("position"), (k % 3).alias("goals"), (k % 4).alias("assists"), (k % 3 + k % 4).alias("points"),
            (k % 5 - 2).alias("plusMinus"), (2 * (k % 2)).alias("pim"), (k % 6).alias("hits"), (k % 3).alias("blockedShots"),
            F.when(k % 9 == 0, 1).otherwise(0).alias("powerPlayGoals"), (k % 7).alias("sog"), (k % 8 / 8).alias("faceoffWinningPctg"),
            clock((10 + k % 15) * 60 + k % 60).alias("toi"), (20 + k % 9).alias("shifts"))

    def goalie(offset):
        k, who = key + offset, (cust + offset) % 100
        saves = F.concat_ws("/", (20 + k % 9).cast("string"), (21 + k % 9 + k % 4).cast("string"))
        return F.struct(
            (3000000 + who).alias("playerId"), F.struct(F.concat(F.lit("G. "), who).alias("default")).alias("name"),
            F.lit(0).alias("goals"), (k % 2).alias("assists"), (2 * (k % 2)).alias("pim"),
            F.when(k % 10 != 0, clock(3540 + k % 60)).alias("toi"), F.when(k % 3 != 0, saves).otherwise("n/a").alias("saveShotsAgainst"))

    home = F.concat(F.lit("T"), F.lpad((cust % 25).cast("string"), 2, "0"))
    away = F.concat(F.lit("T"), F.lpad(((cust % 25 + 1 + key % 24) % 25).cast("string"), 2, "0"))
    stats = F.struct(
        F.struct(F.array(skater(0, 1, "C")).alias("forwards"), F.array(skater(1, 2, "D")).alias("defense"), F.array(goalie(4)).alias("goalies")).alias("homeTeam"),
        F.struct(F.array(skater(2, 3, "C")).alias("forwards"), F.array(goalie(5)).alias("goalies")).alias("awayTeam"))
    kind_digit = F.when(F.month("o_orderdate") >= 10, 3).otherwise(2)
    game_id = (F.year("o_orderdate").cast("long") * 100 + kind_digit) * 10000000000 + (key % 10000) * 1000000 + F.floor(key / 10000)
    return t.spread("orders").select(F.to_json(F.struct(
        game_id.alias("id"), season_of_year(F.year("o_orderdate")).alias("season"), F.to_date("o_orderdate").cast("string").alias("gameDate"),
        F.struct(home.alias("abbrev")).alias("homeTeam"), F.struct(away.alias("abbrev")).alias("awayTeam"), stats.alias("playerByGameStats"))).alias("payload"))


def _shots_with_given_xg(t) -> DataFrame:
    """Scores in 128ths, whose sums are exact in any order; the trained model has its own query."""
    shots = t["stg_shots"]
    return shots.withColumn("xg", F.when(xg.eligible(), (51 - F.col("distance_ft")) / 128))


# --- SQL counterparts -------------------------------------------------------------------


TYPE = "CASE WHEN substr(CAST(game_id AS VARCHAR), 5, 2) = '03' THEN 3::BIGINT ELSE 2::BIGINT END AS game_type"
SQL: dict[str, str] = dict(STAGING)
SQL["stg_schedule"] = f"SELECT *, {TYPE}, game_date + INTERVAL 23 HOUR AS start_time_utc FROM schedule"
SQL["stg_team_game_stats"] = "SELECT * FROM rightrail"
SQL["stg_player_games"] = f"SELECT * REPLACE (CAST(game_date AS DATE) AS game_date), {TYPE} FROM player_games"
SQL["stg_shots"] = f"SELECT *, {TYPE} FROM shots"


def per(a: str, b: str, k: int) -> str:
    return R(f"({a} / nullif({b}, 0)::DOUBLE)", k)


def newest(cols: str, source: str, key: str = "player_id", order: str = "season_id DESC") -> str:
    return f"SELECT {cols} FROM {source} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"


GROUP3 = "CASE position_code WHEN 'G' THEN 'G' WHEN 'D' THEN 'D' ELSE 'F' END AS position_group"
KEY = "player_id || '-' || season_id AS player_season_key"
AGE = "CAST(floor(date_diff('day', birth_date, make_date(season_id % 10000, 4, 15)) / 365.25) AS BIGINT) AS age"

SQL["dim_players"] = f"""SELECT player_id, full_name, position_code, {GROUP3}, team_abbrevs AS latest_team_abbrevs,
  right(team_abbrevs, 3) AS current_team_abbrev, season_id AS latest_season_id FROM ({newest('*', '''(SELECT player_id, season_id, full_name, position_code, team_abbrevs FROM stg_skater_summary
  UNION ALL SELECT player_id, season_id, full_name, 'G', team_abbrevs FROM stg_goalie_summary)''')})"""
SQL["dim_teams"] = f"""SELECT n.team_id, n.team_name, n.tri_code, latest_season_id, latest_season_id = {CURRENT} AS is_active, conference, division
FROM ({newest('*', '(SELECT team_id, max(season_id) AS latest_season_id FROM stg_team_summary GROUP BY 1) JOIN stg_teams USING (team_id)', 'tri_code', 'latest_season_id DESC, team_id DESC')}) n
LEFT JOIN stg_standings s ON s.team_abbrev = n.tri_code"""


def _side_games(kind_no: int) -> str:
    def one(own: str, other: str, home: str) -> str:
        return f"""SELECT game_id, s.season_id, game_date, {own}_abbrev AS team_abbrev, {other}_abbrev AS opponent, {home} AS is_home, {own}_score AS goals_for,
  {other}_score AS goals_against, last_period_type, {own}_pp_goals AS pp_goals_for, {own}_pp_opportunities AS pp_opportunities, {other}_pp_goals AS pp_goals_against,
  {other}_pp_opportunities AS times_shorthanded, {own}_sog AS shots_for, {other}_sog AS shots_against, {own}_pim AS pim, {own}_hits AS hits,
  {own}_blocked_shots AS blocked_shots, {own}_faceoff_pct AS faceoff_pct FROM stg_schedule s JOIN stg_team_game_stats g USING (game_id) WHERE game_type = {kind_no}"""
    return f"SELECT *, game_id || '-' || team_abbrev AS game_team_key, row_number() OVER w AS game_number, lag(game_date) OVER w AS before FROM ({one('home', 'away', 'true')} UNION ALL {one('away', 'home', 'false')}) WINDOW w AS (PARTITION BY team_abbrev ORDER BY game_date, game_id)"


SQL["fct_team_games"] = f"""SELECT * EXCLUDE (before), date_diff('day', before, game_date) AS rest_days, coalesce(game_date - before = 1, false) AS is_back_to_back,
  CASE WHEN goals_for > goals_against THEN 'W' WHEN last_period_type = 'REG' THEN 'L' ELSE 'OTL' END AS result FROM ({_side_games(2)})"""
DIGIT = lambda i: f"CAST(CAST(game_id AS VARCHAR)[{i}] AS BIGINT)"
SQL["fct_team_playoff_games"] = f"""SELECT * EXCLUDE (before), {DIGIT(8)} AS round, {DIGIT(9)} AS series, {DIGIT(10)} AS game_in_series,
  CASE WHEN goals_for > goals_against THEN 'W' ELSE 'L' END AS result FROM ({_side_games(3)})"""
SQL["team_slice"] = "SELECT * FROM fct_team_games WHERE team_abbrev = 'T07'"


def _player_log(kind_no: int, extra: str = "") -> str:
    return f"""SELECT p.* EXCLUDE (full_name, game_type, toi_seconds), game_id || '-' || player_id AS player_game_key, row_number() OVER (PARTITION BY player_id ORDER BY game_date, game_id) AS player_game_number,
  coalesce(d.full_name, p.full_name) AS full_name, CASE p.position_code WHEN 'G' THEN 'G' WHEN 'D' THEN 'D' ELSE 'F' END AS position_group,
  {R('(toi_seconds / 60::DOUBLE)', 2)} AS toi_minutes, {per('saves', 'shots_against', 4)} AS save_pct{extra}
FROM stg_player_games p LEFT JOIN dim_players d USING (player_id) WHERE game_type = {kind_no}"""


SQL["fct_player_games"] = _player_log(2)
SQL["fct_player_playoff_games"] = _player_log(3, f", {DIGIT(8)} AS round")

RATES = {"goals": "goals", "assists": "assists", "points": "points", "shots": "shots", "pp_points": "pp_points", "hits": "hits", "blocks": "blocked_shots", "pim": "penalty_minutes"}
PER60 = {"goals": ("goals", ""), "assists": ("assists", ""), "points": ("points", ""), "shots": ("shots", ""), "hits": ("hits", ""), "blocks": ("blocked_shots", ""),
         "ev_points": ("ev_points", "ev_"), "ev_goals": ("ev_goals", "ev_"), "pp_points": ("pp_points", "pp_")}
MINUTES = {"toi": "toi", "ev_toi": "ev_toi", "pp_toi": "pp_toi", "sh_toi": "sh_toi"}
TOTALS = "games_played, goals, assists, points, shots, shooting_pct, pp_goals, pp_points, sh_goals, sh_points, ev_goals, ev_points, game_winning_goals"
LINES = lambda s: f"""stg_skater_summary{s} LEFT JOIN (SELECT * EXCLUDE (games_played, hits_per_60, blocked_shots_per_60) FROM stg_skater_realtime{s}) USING (player_id, season_id)
  LEFT JOIN (SELECT * EXCLUDE (games_played, shifts) FROM stg_skater_toi{s}) USING (player_id, season_id) LEFT JOIN stg_skater_bios USING (player_id, season_id)"""
TWO_WAY = "CASE WHEN position_code = 'D' THEN 'D' ELSE 'F' END AS position_group"
SQL["_player_lines"] = f"""SELECT {KEY}, player_id, season_id, full_name, position_code, {TWO_WAY}, team_abbrevs, birth_date, {AGE}, draft_year, draft_round, draft_overall, {TOTALS},
  {', '.join(f'{R(f"({c}_per_gp_seconds / 60)", 2)} AS {o}_minutes_per_gp' for o, c in MINUTES.items())}, hits, blocked_shots, takeaways, giveaways, penalty_minutes AS pim, plus_minus,
  faceoff_win_pct AS faceoff_pct, {', '.join(f'{per(c, "games_played", 4)} AS {o}_per_gp' for o, c in RATES.items())},
  {', '.join(f'{per(f"{c} * 3600", f"{st}toi_seconds", 4)} AS {o}_per_60' for o, (c, st) in PER60.items())} FROM {LINES('')}"""
RANKED = {
    "pct_plus_minus": "plus_minus", "pct_shooting": "shooting_pct", "pct_ev_points_per_60": "ev_points_per_60", "pct_points_per_gp": "points_per_gp", "pct_goals_per_gp": "goals_per_gp",
    "pct_shots_per_gp": "shots_per_gp", "pct_toi_per_gp": "toi_minutes_per_gp", "pct_pp_points_per_gp": "pp_points_per_gp", "pct_hits_per_gp": "hits_per_gp", "pct_blocks_per_gp": "blocks_per_gp"}
SQL["mart_player_season"] = "SELECT *, " + ", ".join(
    f"CASE WHEN games_played >= 20 THEN {R(f'(percent_rank() OVER (PARTITION BY season_id, position_group, games_played >= 20 ORDER BY {c} NULLS FIRST))', 3)} END AS {o}"
    for o, c in RANKED.items()) + " FROM _player_lines"
SQL["mart_player_playoff_season"] = f"""SELECT {KEY}, player_id, season_id, full_name, position_code, {TWO_WAY}, team_abbrevs, birth_date, {TOTALS},
  {R('(toi_per_gp_seconds / 60)', 2)} AS toi_minutes_per_gp, hits, blocked_shots, penalty_minutes AS pim, plus_minus, faceoff_win_pct AS faceoff_pct,
  {per('goals', 'games_played', 4)} AS goals_per_gp, {per('points', 'games_played', 4)} AS points_per_gp,
  {per('ev_points * 3600', 'ev_toi_seconds', 4)} AS ev_points_per_60, {per('pp_points * 3600', 'pp_toi_seconds', 4)} AS pp_points_per_60 FROM {LINES('_playoffs')}"""


def totals(*cols: str) -> str:
    return ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in cols)


def _career_sql(source: str, identity: str, count_name: str, body: str) -> str:
    return f"""SELECT player_id, {', '.join(f'any_value(i.{c})' + f' AS {c}' for c in identity.split())}, CAST(count(*) AS BIGINT) AS {count_name}, min(season_id) AS first_season_id, max(season_id) AS last_season_id, {body}
FROM {source} s JOIN ({newest('player_id, ' + ', '.join(f'{c.replace("last_", "")} AS {c}' for c in identity.split()), source)}) i USING (player_id) GROUP BY player_id"""


ACTIVE = f"max(season_id) = {CURRENT} AS is_active"
SQL["mart_player_career"] = _career_sql("mart_player_season", "full_name position_code position_group last_team_abbrevs birth_date", "seasons_played", f"""{ACTIVE},
  {totals('games_played', 'goals', 'assists', 'points', 'shots', 'pp_goals', 'pp_points', 'sh_goals', 'game_winning_goals', 'pim', 'plus_minus', 'hits', 'blocked_shots')},
  {per('sum(points)', 'sum(games_played)', 3)} AS points_per_gp, {per('sum(goals) FILTER (shots IS NOT NULL)', 'sum(shots)', 4)} AS shooting_pct""")
SQL["mart_player_playoff_career"] = _career_sql("mart_player_playoff_season", "full_name position_code position_group", "playoff_seasons", f"""
  {totals('games_played', 'goals', 'assists', 'points', 'game_winning_goals', 'pim')}, {per('sum(points)', 'sum(games_played)', 3)} AS points_per_gp""")
SAVES = "save_pct, goals_against_average, saves, shots_against, goals_against, shutouts"
GOALIE = f"{KEY}, player_id, season_id, full_name, 'G' AS position_code, 'G' AS position_group, team_abbrevs, birth_date, games_played, games_started, wins, losses, ot_losses, {SAVES}, {R('(toi_seconds / 60::DOUBLE)', 1)} AS toi_minutes"
SQL["mart_goalie_season"] = f"""SELECT {GOALIE}, {AGE}, draft_year, draft_round, draft_overall, {per('wins', 'games_started', 4)} AS win_pct_per_start, {per('saves', 'games_started', 2)} AS saves_per_start,
  {per('shots_against', 'games_started', 2)} AS shots_against_per_start, {per('shutouts', 'games_started', 4)} AS shutout_rate FROM stg_goalie_summary LEFT JOIN stg_goalie_bios USING (player_id, season_id)"""
SQL["mart_goalie_playoff_season"] = f"SELECT {GOALIE} FROM stg_goalie_summary_playoffs LEFT JOIN stg_goalie_bios USING (player_id, season_id)"
SQL["mart_goalie_career"] = _career_sql("mart_goalie_season", "full_name position_group last_team_abbrevs birth_date", "seasons_played", f"""{ACTIVE},
  {totals('games_played', 'games_started', 'wins', 'losses', 'ot_losses', 'shutouts', 'saves', 'shots_against')}, {per('sum(saves)', 'sum(shots_against)', 4)} AS save_pct""")
SQL["mart_goalie_playoff_career"] = _career_sql("mart_goalie_playoff_season", "full_name position_group", "playoff_seasons", f"""
  {totals('games_played', 'wins', 'losses', 'shutouts', 'saves', 'shots_against')}, {per('sum(saves)', 'sum(shots_against)', 4)} AS save_pct""")
SQL["mart_team_season"] = """SELECT t.team_id || '-' || season_id AS team_season_key, t.* EXCLUDE (team_name), t.team_name, r.tri_code, conference, division
FROM stg_team_summary t LEFT JOIN stg_teams r USING (team_id) LEFT JOIN dim_teams d ON d.tri_code = r.tri_code"""
SQL["mart_team_playoff_season"] = """SELECT t.team_id || '-' || season_id AS team_season_key, tri_code, t.* EXCLUDE (ot_losses, regulation_wins, shootout_wins, points, point_pct, pp_net_pct, pk_net_pct, shutouts)
FROM stg_team_summary_playoffs t LEFT JOIN (SELECT team_id, tri_code FROM stg_teams) USING (team_id)"""


def _last(n: int, a: str, b: str, head: str = "") -> str:
    over = f"OVER (PARTITION BY team_abbrev ORDER BY game_number ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return R(f"({head}sum({a}) {over} / nullif(sum({b}) {over}, 0)::DOUBLE)", 4)


SQL["mart_team_special_teams_rolling"] = f"""SELECT game_team_key, game_id, season_id, game_date, game_number, team_abbrev, opponent, result, pp_goals_for, pp_opportunities, pp_goals_against, times_shorthanded,
  {', '.join(f'{_last(n, "pp_goals_for", "pp_opportunities")} AS pp_pct_last_{n}, {_last(n, "pp_goals_against", "times_shorthanded", "1 - ")} AS pk_pct_last_{n}' for n in (5, 10, 15))} FROM fct_team_games"""
SQL["fct_shots"] = "SELECT *, CASE WHEN event_type <> 'blocked-shot' AND NOT is_empty_net THEN (51 - distance_ft) / 128 END AS xg FROM stg_shots"
TEN = "OVER (PARTITION BY player_id ORDER BY player_game_number ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
SQL["mart_player_form"] = f"""WITH g AS (SELECT f.*, coalesce(x, 0) AS x FROM fct_player_games f LEFT JOIN
  (SELECT game_id, shooting_player_id AS player_id, sum(xg) AS x FROM fct_shots WHERE game_type = 2 GROUP BY 1, 2 HAVING count(xg) > 0) USING (game_id, player_id) WHERE position_code <> 'G'),
r AS (SELECT player_game_key, game_id, season_id, game_date, player_game_number, player_id, full_name, position_group, team_abbrev, opponent_abbrev, goals, assists, points, shots,
  least(player_game_number, 10) AS games_in_window, {', '.join(f'CAST(sum({c}) {TEN} AS BIGINT) AS {c}_last_10' for c in ('points', 'goals', 'shots'))}, {R(f'(sum(x) {TEN})', 2)} AS xg_last_10 FROM g)
SELECT r.*, {per('points_last_10', 'games_in_window', 3)} AS points_per_gp_last_10, {R('(goals_last_10 - xg_last_10)', 2)} AS finishing_last_10, points_per_gp AS season_points_per_gp,
  {R('(points_last_10 / games_in_window::DOUBLE - points_per_gp)', 3)} AS form_delta FROM r LEFT JOIN (SELECT player_id, season_id, points_per_gp FROM mart_player_season) USING (player_id, season_id)"""
SCORED = "(SELECT * FROM fct_shots WHERE xg IS NOT NULL AND game_type = 2)"
SQL["mart_player_xg_season"] = f"""SELECT {KEY}, a.*, full_name, position_group FROM (SELECT shooting_player_id AS player_id, season_id, CAST(count(*) AS BIGINT) AS unblocked_attempts,
  CAST(count(*) FILTER (is_goal) AS BIGINT) AS goals, {R('sum(xg)', 2)} AS expected_goals, {R('(count(*) FILTER (is_goal) - sum(xg))', 2)} AS goals_above_expected, {R('(sum(xg) / count(*))', 4)} AS xg_per_attempt,
  CAST(count(*) FILTER (is_rebound) AS BIGINT) AS rebound_attempts, CAST(count(*) FILTER (is_rush) AS BIGINT) AS rush_attempts, {R('avg(distance_ft)', 1)} AS avg_shot_distance_ft
  FROM {SCORED} GROUP BY 1, 2) a LEFT JOIN dim_players USING (player_id)"""


def _xg_side(team: str, suffix: str) -> str:
    return f"(SELECT {team} AS team_abbrev, season_id, CAST(count(*) AS BIGINT) AS unblocked_attempts_{suffix}, CAST(count(*) FILTER (is_goal) AS BIGINT) AS goals_{suffix}_model, sum(xg) AS x_{suffix} FROM {SCORED} GROUP BY 1, 2)"


SQL["mart_team_xg_season"] = f"""SELECT team_abbrev || '-' || season_id AS team_season_key, team_abbrev, season_id, unblocked_attempts_for, unblocked_attempts_against, goals_for_model, goals_against_model,
  {R('x_for', 2)} AS xg_for, {R('x_against', 2)} AS xg_against, {R('(x_for / (x_for + x_against))', 4)} AS xg_share, {R('(goals_for_model - x_for)', 2)} AS goals_above_expected_for,
  {R('(goals_against_model - x_against)', 2)} AS goals_above_expected_against FROM {_xg_side('team_abbrev', 'for')} JOIN {_xg_side('opponent_abbrev', 'against')} USING (team_abbrev, season_id)"""


SQL["mart_player_similarity"] = similarity_sql(CURRENT, PREVIOUS)


def with_inputs(body: str) -> str:
    """The body preceded by every frame it needs, each written once."""
    known = {**FEEDS, **SQL}
    order: list[str] = []

    def visit(text: str):
        for name in re.findall(r"\b\w+\b", text):
            if name in known and name not in order and re.search(rf"\b(FROM|JOIN)\s+\(*{name}\b", text):
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(body)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({known[n].replace('STRING', 'VARCHAR')})" for n in order)
    return f"WITH {parts}\nSELECT * FROM ({body})" if order else body


def _register(name: str, sql: str | None):
    query(name, with_inputs(sql) if sql else None)(lambda t: league(t).build(name))


for _name, _sql in SQL.items():
    if not _name.startswith("_") and _name != "team_slice":
        _register(_name, _sql)


@query("team_slice", with_inputs(SQL["team_slice"]))
def team_slice(t):
    return marts.team_slice(league(t), "T07")


@query("flatten_boxscores", with_inputs("SELECT * FROM player_games"))
def flatten_boxscores_query(t):
    return flatten_boxscores(boxscore_docs(t))


@query("fct_shots_model", with_inputs("""SELECT * EXCLUDE (xg), xg IS NOT NULL AS scored, true AS plausible, true AS calibrated FROM fct_shots"""))
def fct_shots_model(t):
    """Shots scored by the trained model: which are, with probabilities that add up to the goals within a twentieth."""
    shots = pin(xg.fct_shots(league(t)))
    sums = xg.calibration(shots.filter("game_type = 2")).first()
    fits = abs(sums["predicted_goals"] - sums["actual_goals"]) <= 0.05 * sums["actual_goals"]
    inside = F.coalesce((F.col("xg") > 0) & (F.col("xg") < 1), F.lit(True))
    return shots.select(*[c for c in shots.columns if c != "xg"], F.col("xg").isNotNull().alias("scored"), inside.alias("plausible"), F.lit(fits).alias("calibrated"))


# --- play-by-play documents from the event stream ------------------------------------------

# Fields of a play, as SQL that both engines accept.
PLAY_FIELDS = {
    "game_id": "user_id * 1000000 + CAST(floor(event_id / 1000) AS BIGINT)",
    "sort_order": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id - event_id % 3 END",
    "event_type": """CASE event_type WHEN 'signup' THEN 'goal' WHEN 'purchase' THEN 'shot-on-goal' WHEN 'error' THEN 'blocked-shot'
  WHEN 'view' THEN 'missed-shot' ELSE 'faceoff' END""",
    "period_number": "1 + event_id % 2",
    "period_type": "CASE WHEN event_id % 19 = 0 THEN 'SO' WHEN event_id % 23 <> 0 THEN 'REG' END",
    "clock": "event_id % 8",
    "owner": "CASE WHEN event_id % 17 <> 0 THEN 10 * (1 + CAST(floor(event_id / 3) AS BIGINT) % 2) END",
    "zone_code": "CASE (user_id + event_id) % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'D' WHEN 2 THEN 'O' END",
    "x_coord": "CASE WHEN event_id % 13 <> 0 THEN (event_id * 37) % 201 - 100 END",
    "y_coord": "(event_id * 53) % 85 - 42",
    "defends": "CASE event_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END",
    "code": "CASE WHEN event_id % 11 = 0 THEN '' ELSE '1' || CAST(3 + event_id % 3 AS STRING) || CAST(3 + event_id % 4 AS STRING) || '1' END",
    "shooting": "CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 5 < 4 THEN event_id % 97 END",
    "scoring": "CASE WHEN event_id % 7 < 5 THEN event_id % 89 END",
    "goalie": "CASE WHEN event_id % 9 <> 0 THEN event_id % 31 END",
}
PLAYS_SQL = "SELECT event_id, " + ", ".join(f"{e} AS {n}" for n, e in PLAY_FIELDS.items()) + " FROM events"


def play_by_play_docs(t: Tables) -> DataFrame:
    """Documents of at most 1,000 plays: a user's events from one range of event ids."""
    plays = t.spark.sql(PLAYS_SQL.replace("FROM events", "FROM {events}"), events=t.events)
    play = F.struct(
        F.col("event_id").alias("eventId"), F.col("sort_order").alias("sortOrder"), F.col("event_type").alias("typeDescKey"),
        F.format_string("00:%02d", "clock").alias("timeInPeriod"), F.col("code").alias("situationCode"), F.col("defends").alias("homeTeamDefendingSide"),
        F.struct(F.col("period_number").alias("number"), F.col("period_type").alias("periodType")).alias("periodDescriptor"),
        F.struct(
            F.col("owner").alias("eventOwnerTeamId"), F.col("zone_code").alias("zoneCode"), F.col("x_coord").alias("xCoord"), F.col("y_coord").alias("yCoord"),
            F.lit("wrist").alias("shotType"), F.col("shooting").alias("shootingPlayerId"), F.col("scoring").alias("scoringPlayerId"),
            F.col("goalie").alias("goalieInNetId")).alias("details"))
    side = lambda i, a: F.struct(F.lit(i).alias("id"), F.lit(a).alias("abbrev"))
    games = plays.groupBy("game_id").agg(F.sort_array(F.collect_list(play)).alias("plays"))
    return games.select(F.to_json(F.struct(
        F.col("game_id").alias("id"), F.lit(20232024).alias("season"), side(10, "HHH").alias("homeTeam"), side(20, "AAA").alias("awayTeam"), "plays")).alias("payload"))


PLAY_WINDOW = "PARTITION BY game_id ORDER BY coalesce(sort_order, 0), event_id"
SHOTS_SQL = f"""WITH p AS ({PLAYS_SQL.replace('STRING', 'VARCHAR')}),
a AS (SELECT *, (period_number - 1) * 1200 + clock AS game_seconds, CASE WHEN event_type = 'blocked-shot' THEN CASE WHEN owner = 10 THEN 20 ELSE 10 END ELSE owner END AS shooter
  FROM p WHERE period_type IS DISTINCT FROM 'SO'),
z AS (SELECT *, {', '.join(f"last_value(CASE WHEN owner = {i} AND zone_code IN ('N', 'D') THEN game_seconds END IGNORE NULLS) OVER ({PLAY_WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS exit_{i}" for i in (10, 20))} FROM a),
s AS (SELECT *, event_type <> 'blocked-shot' AS tried, shooter IS NOT DISTINCT FROM 10 AS home, CASE (shooter IS NOT DISTINCT FROM 10) = (coalesce(defends, 'left') = 'left') WHEN true THEN 89 ELSE -89 END AS net
  FROM z WHERE event_type <> 'faceoff' AND x_coord IS NOT NULL),
r AS (SELECT *, last_value(CASE WHEN tried THEN event_id END IGNORE NULLS) OVER ({PLAY_WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  (CASE WHEN home THEN 1 ELSE -1 END) * (CAST(code[3] AS BIGINT) - CAST(code[2] AS BIGINT)) AS lead FROM (SELECT * REPLACE (nullif(code, '') AS code) FROM s))
SELECT r.game_id, r.event_id, r.sort_order, CAST(20232024 AS BIGINT) AS season_id, r.period_number, r.period_type, r.game_seconds, r.event_type, r.event_type = 'goal' AS is_goal, 'wrist' AS shot_type,
  r.x_coord, r.y_coord, r.zone_code, {R('sqrt(CAST((r.net - r.x_coord) * (r.net - r.x_coord) + r.y_coord * r.y_coord AS DOUBLE))', 2)} AS distance_ft,
  {R('degrees(atan2(CAST(abs(r.y_coord) AS DOUBLE), CAST(abs(r.net - r.x_coord) AS DOUBLE)))', 2)} AS angle_deg, CASE WHEN r.home THEN 'HHH' ELSE 'AAA' END AS team_abbrev,
  CASE WHEN r.home THEN 'AAA' ELSE 'HHH' END AS opponent_abbrev, r.home AS is_home_team, coalesce(nullif(r.shooting, 0), r.scoring) AS shooting_player_id, r.goalie AS goalie_in_net_id, r.goalie IS NULL AS is_empty_net,
  CASE WHEN r.lead > 0 THEN 'PP' WHEN r.lead < 0 THEN 'SH' ELSE 'EV' END AS strength_state,
  coalesce(r.tried AND q.shooter IS NOT DISTINCT FROM r.shooter AND q.event_id IS NOT NULL AND q.period_number = r.period_number AND r.game_seconds - q.game_seconds BETWEEN 0 AND 3, false) AS is_rebound,
  coalesce(r.game_seconds - CASE r.shooter WHEN 10 THEN r.exit_10 WHEN 20 THEN r.exit_20 END BETWEEN 0 AND 4, false) AS is_rush
FROM r LEFT JOIN s q ON q.event_id = r.prev"""


@query("flatten_shots", SHOTS_SQL)
def flatten_shots_query(t):
    return flatten_shots(play_by_play_docs(t))


@query("explode_plays", f"""SELECT game_id, event_id, CAST(row_number() OVER (PARTITION BY game_id ORDER BY event_id) - 1 AS INTEGER) AS pos FROM ({PLAYS_SQL.replace('STRING', 'VARCHAR')})""")
def explode_plays_query(t):
    return explode_plays(play_by_play_docs(t)).select("game_id", F.col("p.eventId").alias("event_id"), "pos")
