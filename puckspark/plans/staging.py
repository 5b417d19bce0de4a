"""Raw feeds to staging: newest load per natural key, snake_case names, typed columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puckspark.functions import scalars as S
from puckspark.operators.flatten import explode_categories, parse_json, pivot_categories
from puckspark.operators.ordered import latest_per
from puckspark.operators.rates import era_guard
from puckspark.operators.relate import rename_select
from puckspark.operators.sizing import null_safe_join
from puckspark.session import TIGHT, broadcast_rows, pin_counted
from puckspark.sources.schemas import LOADED_AT, SCHEDULE


def newest_load(df: DataFrame, keys: list[str]) -> DataFrame:
    """Newest load per key; equal load times are settled by the row's content.

    Loads are mostly whole, so of the stored rows only keys are counted: a key with one row in the last load of all needs no other.
    Only rows of the keys left over meet in a window, all rows where those keys are too many to be broadcast.
    """
    spark, content = df.sparkSession, F.xxhash64(*[F.col(c) for c in df.columns if c != LOADED_AT])
    stored, n = pin_counted(df, codec=TIGHT)
    pick = lambda rows: latest_per(rows, keys, [F.desc(LOADED_AT), content]).drop(LOADED_AT)
    if n <= broadcast_rows(spark):
        return pick(stored)
    last = F.col(LOADED_AT) == F.lit(stored.agg(F.max(LOADED_AT)).first()[0])
    left_over, n = pin_counted(stored.groupBy(*keys).agg(F.count_if(last).alias("n")).where("n <> 1").select(*keys))
    if n > broadcast_rows(spark):
        return pick(stored)
    whole = stored.where(last).drop(LOADED_AT)
    if n == 0:
        return whole
    few = F.broadcast(left_over)
    return null_safe_join(whole, few, keys, "left_anti").unionByName(pick(null_safe_join(stored, few, keys, "left_semi")))


@dataclass(frozen=True)
class Spec:
    """How one feed is staged. ``names`` maps output -> feed field."""

    keys: tuple[str, ...]
    names: dict[str, str]
    doubles: tuple[str, ...] = ()  # text that should be numeric; unreadable text becomes null
    dates: tuple[str, ...] = ()
    guards: dict[str, str] = field(default_factory=dict)  # column -> base stat of the era guard


def stage(df: DataFrame, spec: Spec) -> DataFrame:
    keyed = df
    keys = list(spec.keys)
    nested = [k for k in keys if "." in k]
    if nested:
        keyed = df.withColumns({f"_k{i}": F.col(k) for i, k in enumerate(nested)})
        keys = [f"_k{nested.index(k)}" if k in nested else k for k in keys]
    out = rename_select(newest_load(keyed, keys), spec.names)
    typed = {c: F.col(c).try_cast("double") for c in spec.doubles}
    typed |= {c: F.to_date(c) for c in spec.dates}
    out = out.withColumns(typed) if typed else out
    return era_guard(out, ["season_id"], spec.guards) if spec.guards else out


_PLAYER = {"player_id": "playerId", "season_id": "season_id"}
_SKATER_SUMMARY = Spec(
    ("playerId", "season_id"),
    {
        **_PLAYER, "full_name": "skaterFullName", "position_code": "positionCode", "team_abbrevs": "teamAbbrevs",
        "shoots_catches": "shootsCatches", "games_played": "gamesPlayed", "goals": "goals", "assists": "assists",
        "points": "points", "plus_minus": "plusMinus", "penalty_minutes": "penaltyMinutes",
        "pp_goals": "ppGoals", "pp_points": "ppPoints", "sh_goals": "shGoals", "sh_points": "shPoints",
        "ev_goals": "evGoals", "ev_points": "evPoints", "game_winning_goals": "gameWinningGoals",
        "ot_goals": "otGoals", "shots": "shots", "shooting_pct": "shootingPct",
        "faceoff_win_pct": "faceoffWinPct", "points_per_game": "pointsPerGame",
        "toi_per_gp_seconds": "timeOnIcePerGame",
    },
    doubles=("faceoff_win_pct", "points_per_game", "toi_per_gp_seconds"),
)
_SKATER_REALTIME = Spec(
    ("playerId", "season_id"),
    {
        **_PLAYER, "games_played": "gamesPlayed", "hits": "hits", "blocked_shots": "blockedShots",
        "giveaways": "giveaways", "takeaways": "takeaways", "hits_per_60": "hitsPer60",
        "blocked_shots_per_60": "blockedShotsPer60",
    },
    guards={
        "hits": "hits", "blocked_shots": "blocked_shots", "giveaways": "giveaways", "takeaways": "takeaways",
        "hits_per_60": "hits", "blocked_shots_per_60": "blocked_shots",
    },
)
_TOI_NAMES = {
    "toi_seconds": "timeOnIce", "ev_toi_seconds": "evTimeOnIce", "pp_toi_seconds": "ppTimeOnIce",
    "sh_toi_seconds": "shTimeOnIce", "ev_toi_per_gp_seconds": "evTimeOnIcePerGame",
    "pp_toi_per_gp_seconds": "ppTimeOnIcePerGame", "sh_toi_per_gp_seconds": "shTimeOnIcePerGame",
}
_SKATER_TOI = Spec(
    ("playerId", "season_id"),
    {**_PLAYER, "games_played": "gamesPlayed", **_TOI_NAMES, "shifts": "shifts"},
    doubles=tuple(_TOI_NAMES),
)
_BIOS = Spec(
    ("playerId", "season_id"),
    {
        **_PLAYER, "birth_date": "birthDate", "birth_country": "birthCountryCode",
        "nationality": "nationalityCode", "height_inches": "height", "weight_pounds": "weight",
        "draft_year": "draftYear", "draft_round": "draftRound", "draft_overall": "draftOverall",
        "current_team_abbrev": "currentTeamAbbrev",
    },
    dates=("birth_date",),
)
_GOALIE_SUMMARY = Spec(
    ("playerId", "season_id"),
    {
        **_PLAYER, "full_name": "goalieFullName", "team_abbrevs": "teamAbbrevs",
        "shoots_catches": "shootsCatches", "games_played": "gamesPlayed", "games_started": "gamesStarted",
        "wins": "wins", "losses": "losses", "ot_losses": "otLosses", "save_pct": "savePct",
        "goals_against_average": "goalsAgainstAverage", "saves": "saves", "shots_against": "shotsAgainst",
        "goals_against": "goalsAgainst", "shutouts": "shutouts", "toi_seconds": "timeOnIce",
    },
)
_TEAM_SUMMARY = Spec(
    ("teamId", "season_id"),
    {
        "team_id": "teamId", "season_id": "season_id", "team_name": "teamFullName",
        "games_played": "gamesPlayed", "wins": "wins", "losses": "losses", "ot_losses": "otLosses",
        "regulation_wins": "winsInRegulation", "shootout_wins": "winsInShootout", "points": "points",
        "point_pct": "pointPct", "goals_for": "goalsFor", "goals_against": "goalsAgainst",
        "goals_for_per_game": "goalsForPerGame", "goals_against_per_game": "goalsAgainstPerGame",
        "pp_pct": "powerPlayPct", "pk_pct": "penaltyKillPct", "pp_net_pct": "powerPlayNetPct",
        "pk_net_pct": "penaltyKillNetPct", "shots_for_per_game": "shotsForPerGame",
        "shots_against_per_game": "shotsAgainstPerGame", "faceoff_win_pct": "faceoffWinPct",
        "shutouts": "teamShutouts",
    },
)
SPECS: dict[str, Spec] = {
    "skater_summary": _SKATER_SUMMARY,
    "skater_summary_playoffs": _SKATER_SUMMARY,
    "skater_realtime": _SKATER_REALTIME,
    "skater_realtime_playoffs": _SKATER_REALTIME,
    "skater_toi": _SKATER_TOI,
    "skater_toi_playoffs": _SKATER_TOI,
    "skater_bios": _BIOS,
    "goalie_bios": _BIOS,
    "goalie_summary": _GOALIE_SUMMARY,
    "goalie_summary_playoffs": _GOALIE_SUMMARY,
    "team_summary": _TEAM_SUMMARY,
    "team_summary_playoffs": _TEAM_SUMMARY,
    "standings": Spec(
        ("teamAbbrev.default", "season_id"),
        {
            "team_abbrev": "teamAbbrev.default", "team_name": "teamName.default", "season_id": "season_id",
            "conference": "conferenceName", "division": "divisionName", "games_played": "gamesPlayed",
            "wins": "wins", "losses": "losses", "ot_losses": "otLosses", "points": "points",
            "point_pct": "pointPctg", "goals_for": "goalFor", "goals_against": "goalAgainst",
            "goal_differential": "goalDifferential", "league_rank": "leagueSequence",
            "conference_rank": "conferenceSequence", "division_rank": "divisionSequence",
            "wildcard_rank": "wildcardSequence", "streak_code": "streakCode", "streak_count": "streakCount",
        },
    ),
    "teams": Spec(
        ("id",),
        {"team_id": "id", "team_name": "fullName", "tri_code": "triCode", "franchise_id": "franchiseId"},
    ),
}


def game_type(game_id: str = "game_id") -> Column:
    """Digits 5-6 of a game id: 2 regular season, 3 playoffs."""
    return S.digits(game_id, 5, 2)


# Output column -> (field of the document, type).
_SCHEDULE_FIELDS = {
    "game_date": ("gameDate", "date"),
    "game_state": ("gameState", "string"),
    "home_abbrev": ("homeTeam.abbrev", "string"),
    "away_abbrev": ("awayTeam.abbrev", "string"),
    "home_score": ("homeTeam.score", "long"),
    "away_score": ("awayTeam.score", "long"),
    "last_period_type": ("gameOutcome.lastPeriodType", "string"),
    "start_time_utc": ("startTimeUTC", "timestamp"),
    "venue": ("venue.default", "string"),
}


def stage_schedule(df: DataFrame) -> DataFrame:
    """The document is parsed once, as text fields; the casts stay strict."""
    docs = parse_json(newest_load(df, ["game_id"]), SCHEDULE)
    return docs.select(
        "game_id", game_type().alias("game_type"), "season_id",
        *[F.col(f"doc.{path}").cast(t).alias(o) for o, (path, t) in _SCHEDULE_FIELDS.items()],
    )


# Category of the right rail -> column stem; the power play is a "goals/chances" pair.
_COUNTS = {
    "sog": "sog", "pim": "pim", "hits": "hits", "blockedShots": "blocked_shots",
    "giveaways": "giveaways", "takeaways": "takeaways",
}


def stage_team_game_stats(df: DataFrame) -> DataFrame:
    keys = ["game_id", "season_id"]
    long = explode_categories(newest_load(df, ["game_id"]), keys)
    stems = {**_COUNTS, "powerPlay": "pp", "faceoffWinningPctg": "faceoff_pct"}
    wide = pivot_categories(long, keys, "category", {
        f"{side}_{stem}": (cat, f"{side}_value") for cat, stem in stems.items() for side in ("away", "home")
    })
    out: list[Column] = []
    for side in ("away", "home"):
        out += [F.col(f"{side}_{stem}").cast("long").alias(f"{side}_{stem}") for stem in _COUNTS.values()]
        out += [
            S.ratio_part(f"{side}_pp", 0, strict=True).alias(f"{side}_pp_goals"),
            S.ratio_part(f"{side}_pp", 1, strict=True).alias(f"{side}_pp_opportunities"),
            F.col(f"{side}_faceoff_pct").cast("double").alias(f"{side}_faceoff_pct"),
        ]
    return wide.select(*keys, *out)


def _with_game_type(df: DataFrame, keys: list[str]) -> DataFrame:
    staged = newest_load(df, keys)
    first, *rest = staged.columns
    return staged.select(first, game_type().alias("game_type"), *rest)


def stage_player_games(df: DataFrame) -> DataFrame:
    staged = _with_game_type(df, ["game_id", "player_id"])
    return staged.withColumn("game_date", F.to_date("game_date"))


def stage_shots(df: DataFrame) -> DataFrame:
    return _with_game_type(df, ["game_id", "event_id"]).drop("sort_order")


def build_staging(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every staging frame whose raw feed is given."""
    special = {
        "schedule": ("raw_schedule", stage_schedule),
        "team_game_stats": ("raw_rightrail", stage_team_game_stats),
        "player_games": ("raw_player_games", stage_player_games),
        "shots": ("raw_shots", stage_shots),
    }
    out = {f"stg_{n}": stage(raw[f"raw_{n}"], spec) for n, spec in SPECS.items() if f"raw_{n}" in raw}
    out |= {f"stg_{n}": fn(raw[src]) for n, (src, fn) in special.items() if src in raw}
    return out
