"""Nested game documents to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puckspark.functions import scalars as S
from puckspark.operators.ordered import carry_last, latest_per
from puckspark.sources.schemas import BOXSCORE, PLAY_BY_PLAY, RIGHT_RAIL

# Fixed values of the event feed.
SHOT_EVENTS = ["shot-on-goal", "missed-shot", "goal", "blocked-shot"]
UNBLOCKED_EVENTS = ["shot-on-goal", "missed-shot", "goal"]
REBOUND_SECONDS = 3
RUSH_SECONDS = 4
REGULAR, PLAYOFF = 2, 3
STAT_CATEGORIES = [
    "sog", "powerPlay", "pim", "hits", "blockedShots", "giveaways", "takeaways", "faceoffWinningPctg",
]

# Output column -> field of a skater entry in a boxscore.
SKATER_FIELDS = {
    "position_code": "position",
    "goals": "goals",
    "assists": "assists",
    "points": "points",
    "plus_minus": "plusMinus",
    "pim": "pim",
    "hits": "hits",
    "blocked_shots": "blockedShots",
    "pp_goals": "powerPlayGoals",
    "shots": "sog",
    "faceoff_pct": "faceoffWinningPctg",
}
GOALIE_SHARED = {"goals", "assists", "pim"}  # of SKATER_FIELDS, those a goalie entry has too


def parsed(column: str, schema) -> Column:
    """The JSON text as a struct. A document that is broken or does not fit the schema fails the query: read on, it
    would count as a game without rows."""
    return F.from_json(column, schema, {"mode": "FAILFAST"})


def parse_json(df: DataFrame, schema, column: str = "payload") -> DataFrame:
    """The JSON text column as a struct ``doc`` beside the other columns."""
    return df.withColumn("doc", parsed(column, schema)).drop(column)


def flatten_boxscores(df: DataFrame, column: str = "payload") -> DataFrame:
    """One row per player of each boxscore: both sides, skaters and goalies.

    A missing side or group yields no rows.
    """
    docs = df.select(parsed(column, BOXSCORE).alias("d"))
    groups = F.array(*[
        F.struct(
            F.lit(side == "homeTeam").alias("is_home"), F.lit(group == "goalies").alias("goalie"),
            F.col(f"d.playerByGameStats.{side}.{group}").alias("players"),
        )
        for side in ("homeTeam", "awayTeam") for group in ("forwards", "defense", "goalies")
    ])
    # Only the game's own fields travel beside the exploded lists, not the document.
    games = docs.select(
        F.col("d.id").alias("game_id"), F.col("d.season").alias("season_id"), F.col("d.gameDate").alias("game_date"),
        F.col("d.homeTeam.abbrev").alias("home"), F.col("d.awayTeam.abbrev").alias("away"), groups.alias("groups"),
    )
    game = ["game_id", "season_id", "game_date", "home", "away"]
    # six groups always; the outer form keeps Spark from parsing again to test for none
    rows = games.select(*game, F.inline_outer("groups")).select(*game, "is_home", "goalie", F.explode("players").alias("p"))
    rows = rows.withColumns({
        "team_abbrev": F.when(F.col("is_home"), F.col("home")).otherwise(F.col("away")),
        "opponent_abbrev": F.when(F.col("is_home"), F.col("away")).otherwise(F.col("home")),
    })
    goalie = F.col("goalie")
    skater_cols = {
        out: F.col(f"p.{f}") if out in GOALIE_SHARED else F.when(~goalie, F.col(f"p.{f}"))
        for out, f in SKATER_FIELDS.items() if out != "position_code"
    }
    return rows.select(
        "game_id", "season_id", "game_date", "team_abbrev", "opponent_abbrev", "is_home",
        F.col("p.playerId").alias("player_id"), F.col("p.name.default").alias("full_name"),
        F.when(goalie, "G").otherwise(F.col("p.position")).alias("position_code"),
        *[c.alias(o) for o, c in skater_cols.items()],
        S.clock_seconds("p.toi").alias("toi_seconds"),
        F.when(~goalie, F.col("p.shifts")).alias("shifts"),
        F.when(goalie, S.ratio_part("p.saveShotsAgainst", 0)).alias("saves"),
        F.when(goalie, S.ratio_part("p.saveShotsAgainst", 1)).alias("shots_against"),
    )


def elements(df: DataFrame, array: str) -> DataFrame:
    """One row per element as (pos, p) beside the other columns.

    A plain explode makes Spark test the array's size below the parse, which parses the
    document twice; the outer form with the filter after it parses once.
    """
    others = [c for c in df.columns if c != array]
    return df.select(*others, F.posexplode_outer(array).alias("pos", "p")).filter(F.col("pos").isNotNull())


def explode_categories(df: DataFrame, keys: Sequence[str], column: str = "payload") -> DataFrame:
    """Right-rail document -> (keys, category, away_value, home_value) as text."""
    docs = df.select(*keys, parsed(column, RIGHT_RAIL).alias("d")).select(*keys, F.col("d.teamGameStats").alias("stats"))
    return elements(docs, "stats").select(
        *keys, F.col("p.category").alias("category"), F.col("p.awayValue").alias("away_value"),
        F.col("p.homeValue").alias("home_value"),
    )


def pivot_categories(
    df: DataFrame, keys: Sequence[str], category: str, values: dict[str, tuple[str, str]]
) -> DataFrame:
    """{output: (category, value column)} -> one column each, in one aggregation."""
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col(category) == cat, F.col(v))).alias(out) for out, (cat, v) in values.items()
    ])


def dedupe_schedule(df: DataFrame, game: str, game_type: str, order: Sequence[Column | str]) -> DataFrame:
    """Regular-season and playoff games, one row per game over all teams' schedules."""
    return latest_per(df.filter(F.col(game_type).isin(REGULAR, PLAYOFF)), [game], order)


def explode_plays(df: DataFrame, column: str = "payload") -> DataFrame:
    """Every play of every document with its game's teams and its place in the list."""
    docs = df.select(F.xxhash64(column).alias("_doc"), parsed(column, PLAY_BY_PLAY).alias("d"))
    games = docs.select(
        "_doc", F.col("d.id").alias("game_id"), F.col("d.season").alias("season_id"),
        F.col("d.homeTeam").alias("home"), F.col("d.awayTeam").alias("away"), F.col("d.plays").alias("plays"),
    )
    return elements(games, "plays").select("_doc", "game_id", "season_id", "home", "away", "pos", "p")


def shooter_team(event: Column, owner: Column, home: Column, away: Column) -> Column:
    """A blocked shot is recorded for the blocking team, so the shooter is the other one."""
    other = F.when(owner.eqNullSafe(home), away).otherwise(home)
    return F.when(event == "blocked-shot", other).otherwise(owner)


def seconds_since_zone_exit(
    df: DataFrame, part: Sequence[str], order: Sequence[Column | str], owner: Column, shooter: Column,
    sides: Sequence[Column], outside: Column, seconds: Column, out: str, large: bool | None = None,
) -> DataFrame:
    """Seconds since the shooter's side last had an event with ``outside``, this row included.

    One carried value per side, then the shooter's is picked.
    """
    held = {f"_exit{i}": F.when((owner == side) & outside, seconds) for i, side in enumerate(sides)}
    df = carry_last(df, part, order, held, include_current=True, large=large)
    pick = F.coalesce(*[F.when(shooter == side, F.col(f"_exit{i}")) for i, side in enumerate(sides)])
    return df.withColumn(out, seconds - pick).drop(*held)


def follows_own_attempt(
    df: DataFrame, part: Sequence[str], order: Sequence[Column | str], attempt: Column, side: Column,
    period: Column, seconds: Column, within: int, out: str, large: bool | None = None,
) -> DataFrame:
    """True where the previous attempt of any side was this side's, in this period, within
    ``within`` seconds."""
    state = F.struct(side.alias("side"), period.alias("period"), seconds.alias("sec"))
    df = carry_last(df, part, order, {"_prev": F.when(attempt, state)}, large=large)
    prev, gap = F.col("_prev"), seconds - F.col("_prev.sec")
    flag = (
        attempt & prev.isNotNull() & prev["side"].eqNullSafe(side)
        & prev["period"].eqNullSafe(period) & gap.between(0, within)
    )
    return df.withColumn(out, F.coalesce(flag, F.lit(False))).drop("_prev")


def flatten_shots(df: DataFrame, column: str = "payload") -> DataFrame:
    """Shot attempts of every game with geometry, strength, rebound and rush flags.

    Sequence state runs within one document, and a document landed again word by word counts
    once, so a group is never larger than a document.
    """
    group = ["_doc", "game_id"]
    plays = explode_plays(df.select(column).distinct(), column)
    # Shootouts leave before any sequence state; other non-shots stay until the zone lookup is done.
    plays = plays.filter(~F.col("p.periodDescriptor.periodType").eqNullSafe("SO"))
    home, away = F.col("home.id"), F.col("away.id")
    owner, event = F.col("p.details.eventOwnerTeamId"), F.col("p.typeDescKey")
    plays = plays.select(
        "*",
        S.game_seconds(
            F.coalesce("p.periodDescriptor.number", F.lit(1)), F.coalesce("p.timeInPeriod", F.lit("00:00"))
        ).alias("game_seconds"),
        F.coalesce("p.sortOrder", F.lit(0)).alias("_order"),
        shooter_team(event, owner, home, away).alias("_shooter"),
    )
    shooter, seconds, order = F.col("_shooter"), F.col("game_seconds"), ["_order", "pos"]
    plays = seconds_since_zone_exit(
        plays, group, order, owner, shooter, [home, away],
        F.col("p.details.zoneCode").isin("N", "D"), seconds, "_since_exit", large=False,
    )
    shots = plays.filter(
        event.isin(SHOT_EVENTS) & F.col("p.details.xCoord").isNotNull() & F.col("p.details.yCoord").isNotNull()
    )
    shots = follows_own_attempt(
        shots, group, order, event.isin(UNBLOCKED_EVENTS), shooter,
        F.col("p.periodDescriptor.number"), seconds, REBOUND_SECONDS, "is_rebound", large=False,
    )
    shots = shots.withColumn("is_home_team", shooter.eqNullSafe(home))
    is_home, x, y = F.col("is_home_team"), F.col("p.details.xCoord"), F.col("p.details.yCoord")
    net = S.attack_net_x(is_home, F.coalesce("p.homeTeamDefendingSide", F.lit("left")))
    return shots.select(
        "game_id", F.col("p.eventId").alias("event_id"), F.col("p.sortOrder").alias("sort_order"), "season_id",
        F.col("p.periodDescriptor.number").alias("period_number"),
        F.col("p.periodDescriptor.periodType").alias("period_type"),
        "game_seconds", event.alias("event_type"), (event == "goal").alias("is_goal"),
        F.col("p.details.shotType").alias("shot_type"), x.alias("x_coord"), y.alias("y_coord"),
        F.col("p.details.zoneCode").alias("zone_code"),
        S.shot_distance(x, y, net).alias("distance_ft"), S.shot_angle(x, y, net).alias("angle_deg"),
        F.when(is_home, F.col("home.abbrev")).otherwise(F.col("away.abbrev")).alias("team_abbrev"),
        F.when(is_home, F.col("away.abbrev")).otherwise(F.col("home.abbrev")).alias("opponent_abbrev"),
        "is_home_team",
        # an id of 0 counts as absent
        F.coalesce(F.nullif("p.details.shootingPlayerId", F.lit(0)), F.col("p.details.scoringPlayerId"))
        .alias("shooting_player_id"),
        F.col("p.details.goalieInNetId").alias("goalie_in_net_id"),
        F.col("p.details.goalieInNetId").isNull().alias("is_empty_net"),
        S.strength_state("p.situationCode", is_home).alias("strength_state"),
        "is_rebound",
        F.coalesce(F.col("_since_exit").between(0, RUSH_SECONDS), F.lit(False)).alias("is_rush"),
    )


def normalize_shots(df: DataFrame, x: str = "x_coord", y: str = "y_coord", zone: str = "zone_code") -> DataFrame:
    """Fold every shot to attack right; defensive-zone shots leave, unknown zones stay."""
    flipped = F.when(F.col(x) >= 0, F.col(y)).otherwise(-F.col(y))
    return df.filter(~F.col(zone).eqNullSafe("D")).withColumns(
        {"plot_x": F.least(F.abs(x), F.lit(99)), "plot_y": flipped}
    )
