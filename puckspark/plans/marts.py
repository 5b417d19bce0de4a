"""Mart tables. Each takes a dict of published staging and mart tables and returns a frame.

Whether a group must be split over tasks is left to the operators, which measure it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puckspark.functions import scalars as S
from puckspark.operators.flatten import PLAYOFF, REGULAR
from puckspark.operators.names import name_parts
from puckspark.operators.ordered import latest_per, percentile_within, sequence_number, windowed
from puckspark.operators.rates import career, for_against, ratio_of_sums, share, tracked_ratio
from puckspark.operators.relate import attach_within, left_chain, resolve_via, two_perspectives, with_name
from puckspark.operators.sizing import dealt, has_large_group, lookup, tasks_for

CURRENT_SEASON = 20252026
MIN_GAMES_RANKED = 20
FORM_GAMES = 10
ROLLING_GAMES = (5, 10, 15)
Tables = dict[str, DataFrame]

_PLAYER_SEASON = ["player_id", "season_id"]


def dim_players(t: Tables) -> DataFrame:
    cols = ["player_id", "season_id", "full_name", "position_code", "team_abbrevs"]
    goalies = t["stg_goalie_summary"].withColumn("position_code", F.lit("G"))
    everyone = t["stg_skater_summary"].select(*cols).unionByName(goalies.select(*cols))
    newest = latest_per(everyone, ["player_id"], [F.desc("season_id"), "position_code", "full_name", "team_abbrevs"])
    return newest.select(
        "player_id", "full_name", "position_code", S.position_group("position_code").alias("position_group"),
        F.col("team_abbrevs").alias("latest_team_abbrevs"),
        S.last_in_list("team_abbrevs").alias("current_team_abbrev"),
        F.col("season_id").alias("latest_season_id"),
    )


def dim_teams(t: Tables, current: int = CURRENT_SEASON) -> DataFrame:
    """One row per code ever used, under its newest team id."""
    seasons = t["stg_team_summary"].groupBy("team_id").agg(F.max("season_id").alias("latest_season_id"))
    newest = latest_per(
        t["stg_teams"].join(seasons, "team_id"), ["tri_code"], [F.desc("latest_season_id"), F.desc("team_id")]
    )
    standings = t["stg_standings"].select(F.col("team_abbrev").alias("tri_code"), "conference", "division")
    return newest.join(standings, "tri_code", "left").select(
        "team_id", "team_name", "tri_code", "latest_season_id",
        (F.col("latest_season_id") == current).alias("is_active"), "conference", "division",
    )


def _game_sides(t: Tables, kind: int) -> DataFrame:
    """Both teams' view of each game of one type that has statistics."""
    games = t["stg_schedule"].filter(F.col("game_type") == kind)
    stats = t["stg_team_game_stats"].drop("season_id")

    def view(own: str, other: str, is_home: bool) -> dict[str, Column]:
        c = F.col
        return {
            "team_abbrev": c(f"{own}_abbrev"), "opponent": c(f"{other}_abbrev"), "is_home": F.lit(is_home),
            "goals_for": c(f"{own}_score"), "goals_against": c(f"{other}_score"),
            "pp_goals_for": c(f"{own}_pp_goals"), "pp_opportunities": c(f"{own}_pp_opportunities"),
            "pp_goals_against": c(f"{other}_pp_goals"), "times_shorthanded": c(f"{other}_pp_opportunities"),
            "shots_for": c(f"{own}_sog"), "shots_against": c(f"{other}_sog"),
            **{m: c(f"{own}_{m}") for m in ("pim", "hits", "blocked_shots", "faceoff_pct")},
        }

    return two_perspectives(
        games.join(stats, "game_id"), ["game_id", "season_id", "game_date", "last_period_type"],
        view("home", "away", True), view("away", "home", False),
    )


_SIDE_STATS = [
    "last_period_type", "pp_goals_for", "pp_opportunities", "pp_goals_against", "times_shorthanded",
    "shots_for", "shots_against", "pim", "hits", "blocked_shots", "faceoff_pct",
]
_SIDE_GAME = ["team_abbrev", "opponent", "is_home", "goals_for", "goals_against"]


def _large_team(t: Tables, kind: int) -> bool:
    """Whether a team has too many games for one task, by the schedule alone: the statistics only take games away."""
    games = t["stg_schedule"].filter(F.col("game_type") == kind)
    return has_large_group(games.select(F.explode(F.array("home_abbrev", "away_abbrev")).alias("team")), ["team"])


def rest_columns(day: str):
    """Days since the previous row and whether that is exactly one (never for the first)."""
    def build(w):
        gap = F.datediff(F.col(day), F.lag(day).over(w)).cast("long")
        return {"rest_days": gap, "is_back_to_back": F.coalesce(gap == 1, F.lit(False))}
    return build


def fct_team_games(t: Tables) -> DataFrame:
    numbered = windowed(
        _game_sides(t, REGULAR), ["team_abbrev"], ["game_date", "game_id"], 1,
        rest_columns("game_date"), number="game_number", large=_large_team(t, REGULAR),
    )
    return numbered.select(
        S.surrogate_key("game_id", "team_abbrev").alias("game_team_key"), "game_id", "season_id", "game_date",
        "game_number", "rest_days", "is_back_to_back", *_SIDE_GAME,
        S.game_result("goals_for", "goals_against", "last_period_type").alias("result"), *_SIDE_STATS,
    )


def fct_team_playoff_games(t: Tables) -> DataFrame:
    numbered = sequence_number(
        _game_sides(t, PLAYOFF), ["team_abbrev"], ["game_date", "game_id"], "game_number", large=_large_team(t, PLAYOFF)
    )
    return numbered.select(
        S.surrogate_key("game_id", "team_abbrev").alias("game_team_key"), "game_id", "season_id", "game_date",
        S.digits("game_id", 8, 1).alias("round"), S.digits("game_id", 9, 1).alias("series"),
        S.digits("game_id", 10, 1).alias("game_in_series"), "game_number", *_SIDE_GAME,
        S.game_result("goals_for", "goals_against").alias("result"), *_SIDE_STATS,
    )


def team_slice(t: Tables, team: str) -> DataFrame:
    """One team's games."""
    return t["fct_team_games"].filter(F.col("team_abbrev") == team)


_PLAYER_GAME_STATS = [
    "goals", "assists", "points", "plus_minus", "pim", "hits", "blocked_shots", "pp_goals", "shots", "faceoff_pct",
]


def _player_games(t: Tables, kind: int, extra: dict[str, Column]) -> DataFrame:
    games = t["stg_player_games"].filter(F.col("game_type") == kind)
    large = has_large_group(games, ["player_id"])  # before the name join, which adds no rows
    if not large:
        games = dealt(games, tasks_for(games.sparkSession, games.count()), ["player_id"])
    games = with_name(games, t["dim_players"], "player_id", "full_name")
    games = sequence_number(games, ["player_id"], ["game_date", "game_id"], "player_game_number", large)
    return games.select(
        S.surrogate_key("game_id", "player_id").alias("player_game_key"), "game_id", "season_id", "game_date",
        *[c.alias(o) for o, c in extra.items()],
        "player_game_number", "team_abbrev", "opponent_abbrev", "is_home", "player_id", "full_name",
        "position_code", S.position_group("position_code").alias("position_group"), *_PLAYER_GAME_STATS,
        S.minutes("toi_seconds").alias("toi_minutes"), "shifts", "saves", "shots_against",
        S.ratio("saves", "shots_against", 4).alias("save_pct"),
    )


def fct_player_games(t: Tables) -> DataFrame:
    return _player_games(t, REGULAR, {})


def fct_player_playoff_games(t: Tables) -> DataFrame:
    return _player_games(t, PLAYOFF, {"round": S.digits("game_id", 8, 1)})


# Output of the percentile step -> ranked column.
PERCENTILES = {
    "pct_points_per_gp": "points_per_gp",
    "pct_goals_per_gp": "goals_per_gp",
    "pct_shots_per_gp": "shots_per_gp",
    "pct_toi_per_gp": "toi_minutes_per_gp",
    "pct_pp_points_per_gp": "pp_points_per_gp",
    "pct_hits_per_gp": "hits_per_gp",
    "pct_blocks_per_gp": "blocks_per_gp",
    "pct_shooting": "shooting_pct",
    "pct_plus_minus": "plus_minus",
    "pct_ev_points_per_60": "ev_points_per_60",
}
_STRENGTH_TOTALS = ["pp_goals", "pp_points", "sh_goals", "sh_points", "ev_goals", "ev_points", "game_winning_goals"]


def _skater_lines(t: Tables, suffix: str) -> DataFrame:
    """Summary, real-time, ice-time and bio reports of a skater-season side by side."""
    realtime = t[f"stg_skater_realtime{suffix}"].select(*_PLAYER_SEASON, "hits", "blocked_shots", "takeaways", "giveaways")
    toi = t[f"stg_skater_toi{suffix}"].drop("games_played", "shifts")
    bios = t["stg_skater_bios"].select(*_PLAYER_SEASON, "birth_date", "draft_year", "draft_round", "draft_overall")
    base = t[f"stg_skater_summary{suffix}"]
    return left_chain(base, [realtime, toi, bios], _PLAYER_SEASON, base.count())


def mart_player_season(t: Tables) -> DataFrame:
    lines = _skater_lines(t, "")
    base = lines.select(
        S.surrogate_key(*_PLAYER_SEASON).alias("player_season_key"), *_PLAYER_SEASON, "full_name", "position_code",
        S.position_group("position_code", goalies=False).alias("position_group"), "team_abbrevs", "birth_date",
        S.age_at_season_end("birth_date", "season_id").alias("age"), "draft_year", "draft_round", "draft_overall",
        "games_played", "goals", "assists", "points", "shots", "shooting_pct",
        S.minutes("toi_per_gp_seconds").alias("toi_minutes_per_gp"),
        *[S.minutes(f"{st}_toi_per_gp_seconds").alias(f"{st}_toi_minutes_per_gp") for st in ("ev", "pp", "sh")],
        *_STRENGTH_TOTALS, "hits", "blocked_shots", "takeaways", "giveaways",
        F.col("penalty_minutes").alias("pim"), "plus_minus", F.col("faceoff_win_pct").alias("faceoff_pct"),
        *[c.alias(o) for o, c in S.per_game({
            "goals_per_gp": "goals", "assists_per_gp": "assists", "points_per_gp": "points",
            "shots_per_gp": "shots", "pp_points_per_gp": "pp_points", "hits_per_gp": "hits",
            "blocks_per_gp": "blocked_shots", "pim_per_gp": "penalty_minutes",
        }, "games_played").items()],
        *[c.alias(o) for o, c in S.per_60({
            "goals_per_60": ("goals", "toi_seconds"), "assists_per_60": ("assists", "toi_seconds"),
            "points_per_60": ("points", "toi_seconds"), "shots_per_60": ("shots", "toi_seconds"),
            "hits_per_60": ("hits", "toi_seconds"), "blocks_per_60": ("blocked_shots", "toi_seconds"),
            "ev_points_per_60": ("ev_points", "ev_toi_seconds"), "ev_goals_per_60": ("ev_goals", "ev_toi_seconds"),
            "pp_points_per_60": ("pp_points", "pp_toi_seconds"),
        }).items()],
    )
    return percentile_within(
        base, ["season_id", "position_group"], PERCENTILES,
        F.col("games_played") >= MIN_GAMES_RANKED, lambda c: S.rnd(c, 3),
    )


def player_names(t: Tables) -> DataFrame:
    """Parts of the names of every season's skaters and goalies, for lookups by name."""
    cols = ["player_id", "season_id", "full_name", "position_code", "team_abbrevs", "games_played"]
    both = [t[m].select(*cols, F.lit(goalie).alias("is_goalie")) for m, goalie in (("mart_player_season", False), ("mart_goalie_season", True))]
    return name_parts(both[0].unionByName(both[1]), "full_name", [c for c in both[0].columns if c != "full_name"])


def mart_player_playoff_season(t: Tables) -> DataFrame:
    return _skater_lines(t, "_playoffs").select(
        S.surrogate_key(*_PLAYER_SEASON).alias("player_season_key"), *_PLAYER_SEASON, "full_name", "position_code",
        S.position_group("position_code", goalies=False).alias("position_group"), "team_abbrevs", "birth_date",
        "games_played", "goals", "assists", "points", "shots", "shooting_pct",
        S.minutes("toi_per_gp_seconds").alias("toi_minutes_per_gp"), *_STRENGTH_TOTALS, "hits", "blocked_shots",
        F.col("penalty_minutes").alias("pim"), "plus_minus", F.col("faceoff_win_pct").alias("faceoff_pct"),
        S.ratio("goals", "games_played", 4).alias("goals_per_gp"),
        S.ratio("points", "games_played", 4).alias("points_per_gp"),
        *[c.alias(o) for o, c in S.per_60({
            "ev_points_per_60": ("ev_points", "ev_toi_seconds"), "pp_points_per_60": ("pp_points", "pp_toi_seconds"),
        }).items()],
    )


def _span(count: str) -> list[Column]:
    return [
        F.count("*").alias(count), F.min("season_id").alias("first_season_id"), F.max("season_id").alias("last_season_id"),
    ]


def _active(current: int) -> Column:
    return (F.max("season_id") == current).alias("is_active")


def _sums(*cols: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in cols]


def mart_player_career(t: Tables, current: int = CURRENT_SEASON) -> DataFrame:
    return career(
        t["mart_player_season"], "player_id", "season_id",
        {
            "full_name": "full_name", "position_code": "position_code", "position_group": "position_group",
            "last_team_abbrevs": "team_abbrevs", "birth_date": "birth_date",
        },
        [
            *_span("seasons_played"), _active(current), *_sums("games_played", "goals", "assists", "points"),
            ratio_of_sums("points", "games_played", 3).alias("points_per_gp"), *_sums("shots"),
            tracked_ratio("goals", "shots", 4).alias("shooting_pct"),
            *_sums("pp_goals", "pp_points", "sh_goals", "game_winning_goals", "pim", "plus_minus", "hits", "blocked_shots"),
        ],
    )


def mart_player_playoff_career(t: Tables) -> DataFrame:
    return career(
        t["mart_player_playoff_season"], "player_id", "season_id",
        {"full_name": "full_name", "position_code": "position_code", "position_group": "position_group"},
        [
            *_span("playoff_seasons"), *_sums("games_played", "goals", "assists", "points"),
            ratio_of_sums("points", "games_played", 3).alias("points_per_gp"), *_sums("game_winning_goals", "pim"),
        ],
    )


def _goalie_lines(t: Tables, suffix: str) -> DataFrame:
    bios = t["stg_goalie_bios"].select(*_PLAYER_SEASON, "birth_date", "draft_year", "draft_round", "draft_overall")
    base = t[f"stg_goalie_summary{suffix}"]
    return left_chain(base, [bios], _PLAYER_SEASON, base.count()).withColumns({
        "player_season_key": S.surrogate_key(*_PLAYER_SEASON),
        "position_code": F.lit("G"), "position_group": F.lit("G"), "toi_minutes": S.minutes("toi_seconds", 1),
    })


_GOALIE_HEAD = [
    "player_season_key", *_PLAYER_SEASON, "full_name", "position_code", "position_group", "team_abbrevs", "birth_date",
]
_GOALIE_RECORD = ["games_played", "games_started", "wins", "losses", "ot_losses"]
_GOALIE_SAVES = ["save_pct", "goals_against_average", "saves", "shots_against", "goals_against", "shutouts", "toi_minutes"]


def mart_goalie_season(t: Tables) -> DataFrame:
    return _goalie_lines(t, "").select(
        *_GOALIE_HEAD, S.age_at_season_end("birth_date", "season_id").alias("age"),
        "draft_year", "draft_round", "draft_overall", *_GOALIE_RECORD,
        S.ratio("wins", "games_started", 4).alias("win_pct_per_start"), *_GOALIE_SAVES,
        S.ratio("saves", "games_started", 2).alias("saves_per_start"),
        S.ratio("shots_against", "games_started", 2).alias("shots_against_per_start"),
        S.ratio("shutouts", "games_started", 4).alias("shutout_rate"),
    )


def mart_goalie_playoff_season(t: Tables) -> DataFrame:
    return _goalie_lines(t, "_playoffs").select(*_GOALIE_HEAD, *_GOALIE_RECORD, *_GOALIE_SAVES)


def mart_goalie_career(t: Tables, current: int = CURRENT_SEASON) -> DataFrame:
    """No career goals-against average: minutes are missing for the older eras."""
    rows = career(
        t["mart_goalie_season"], "player_id", "season_id",
        {
            "full_name": "full_name", "position_group": "position_group",
            "last_team_abbrevs": "team_abbrevs", "birth_date": "birth_date",
        },
        [
            *_span("seasons_played"), _active(current),
            *_sums("games_played", "games_started", "wins", "losses", "ot_losses", "shutouts", "saves", "shots_against"),
            ratio_of_sums("saves", "shots_against", 4).alias("save_pct"),
        ],
    )
    return rows


def mart_goalie_playoff_career(t: Tables) -> DataFrame:
    return career(
        t["mart_goalie_playoff_season"], "player_id", "season_id",
        {"full_name": "full_name", "position_group": "position_group"},
        [
            *_span("playoff_seasons"),
            *_sums("games_played", "wins", "losses", "shutouts", "saves", "shots_against"),
            ratio_of_sums("saves", "shots_against", 4).alias("save_pct"),
        ],
    )


_TEAM_GOALS = ["goals_for", "goals_against", "goals_for_per_game", "goals_against_per_game", "pp_pct", "pk_pct"]
_TEAM_SHOTS = ["shots_for_per_game", "shots_against_per_game", "faceoff_win_pct"]


def mart_team_season(t: Tables) -> DataFrame:
    """The code comes from the full team reference: a rebrand changes the id, not the code."""
    rows = resolve_via(
        t["stg_team_summary"], t["stg_teams"].select("team_id", "tri_code"), "team_id", "tri_code",
        t["dim_teams"].select("tri_code", "conference", "division"),
    )
    return rows.select(
        S.surrogate_key("team_id", "season_id").alias("team_season_key"), "team_id", "tri_code", "season_id",
        "team_name", "conference", "division", "games_played", "wins", "losses", "ot_losses", "regulation_wins",
        "shootout_wins", "points", "point_pct", *_TEAM_GOALS, "pp_net_pct", "pk_net_pct", *_TEAM_SHOTS, "shutouts",
    )


def mart_team_playoff_season(t: Tables) -> DataFrame:
    codes = lookup(t["stg_teams"].select("team_id", "tri_code"), materialise=False)
    return t["stg_team_summary_playoffs"].join(codes, "team_id", "left").select(
        S.surrogate_key("team_id", "season_id").alias("team_season_key"), "team_id", "tri_code", "season_id",
        "team_name", "games_played", "wins", "losses", *_TEAM_GOALS, *_TEAM_SHOTS,
    )


@dataclass(frozen=True)
class TrailingRatio:
    """sum(made) / sum(chances) over the last 5, 10, ... rows, or one minus it."""

    stem: str
    made: str
    chances: str
    complement: bool = False

    def value(self, size: int, digits: int = 4) -> Column:
        share = S.sdiv(f"_{self.made}_{size}", f"_{self.chances}_{size}")
        return S.rnd(1 - share if self.complement else share, digits)


def trailing_ratios(
    df: DataFrame, part: list[str], order: list[str], ratios: list[TrailingRatio], sizes=ROLLING_GAMES,
    number: str | None = None, large: bool | None = None,
) -> DataFrame:
    """Adds <stem>_last_<size> for every ratio and size; each column is summed once per size."""
    summed = sorted({c for r in ratios for c in (r.made, r.chances)})

    def build(w):
        return {f"_{c}_{n}": F.sum(c).over(w.rowsBetween(1 - n, 0)) for c in summed for n in sizes}

    rows = windowed(df, part, order, max(sizes) - 1, build, number, large)
    rows = rows.withColumns({f"{r.stem}_last_{n}": r.value(n) for r in ratios for n in sizes})
    return rows.drop(*[f"_{c}_{n}" for c in summed for n in sizes])


def mart_team_special_teams_rolling(t: Tables) -> DataFrame:
    games = t["fct_team_games"].select(
        "game_team_key", "game_id", "season_id", "game_date", "game_number", "team_abbrev", "opponent", "result",
        "pp_goals_for", "pp_opportunities", "pp_goals_against", "times_shorthanded",
    )
    return trailing_ratios(games, ["team_abbrev"], ["game_number"], [
        TrailingRatio("pp_pct", "pp_goals_for", "pp_opportunities"),
        TrailingRatio("pk_pct", "pp_goals_against", "times_shorthanded", complement=True),
    ])


def rolling_form(
    games: DataFrame, entity: str, position: str, sums: dict[str, str], xg: str, size: int = FORM_GAMES, large: bool | None = None,
) -> DataFrame:
    """Sums of the last ``size`` games; ``sums`` maps output -> column, ``xg`` is rounded to 2."""
    def build(w):
        frame = w.rowsBetween(1 - size, 0)
        out = {o: F.sum(c).over(frame) for o, c in sums.items()}
        return out | {f"xg_last_{size}": F.sum(xg).over(frame)}

    rows = windowed(games, [entity], [position], size - 1, build, large=large)
    return rows.withColumns({
        f"xg_last_{size}": S.rnd(f"xg_last_{size}", 2), "games_in_window": F.least(position, F.lit(size)),
    })


def form_against(baseline: str, size: int = FORM_GAMES) -> dict[str, Column]:
    """Pace, finishing (against the rounded xG) and distance from the season's own pace."""
    pace = S.sdiv(f"points_last_{size}", "games_in_window")
    return {
        f"points_per_gp_last_{size}": S.rnd(pace, 3),
        f"finishing_last_{size}": S.rnd(F.col(f"goals_last_{size}") - F.col(f"xg_last_{size}"), 2),
        "form_delta": S.rnd(pace - F.col(baseline), 3),
    }


_FORM_GAME = [
    "game_id", "season_id", "game_date", "player_game_number", "player_id", "full_name", "position_group", "team_abbrev",
    "opponent_abbrev", "goals", "assists", "points", "shots",
]


def mart_player_form(t: Tables) -> DataFrame:
    """A game's row moves once: it meets its xG and the season's pace where the window needs it, beside its player's other games.
    Where a player has too many games or shots for one task, they are joined, each join dealt by its own keys."""
    skaters = t["fct_player_games"].filter(F.col("position_code") != "G").select(*_FORM_GAME)
    scored = _regular_scored(t).withColumn("player_id", F.col("shooting_player_id"))
    game = ["game_id", "player_id"]
    per_game = scored.groupBy(*game).agg(F.sum("xg").alias("game_xg"))
    baseline = t["mart_player_season"].select(*_PLAYER_SEASON, F.col("points_per_gp").alias("season_points_per_gp"))
    # a task sorts its rows more than once at a time
    tasks = tasks_for(skaters.sparkSession, 2 * skaters.count())
    large = has_large_group(skaters, ["player_id"]) or has_large_group(scored, ["player_id"])
    if large:
        games = dealt(skaters, tasks, game).join(dealt(per_game, tasks, game), game, "left")
        games = dealt(games, tasks, _PLAYER_SEASON).join(dealt(baseline, tasks, _PLAYER_SEASON), _PLAYER_SEASON, "left")
    else:
        games = attach_within(skaters, [(per_game, game), (baseline, _PLAYER_SEASON)], "player_id", tasks)
    form = rolling_form(
        games.withColumn("game_xg", F.coalesce("game_xg", F.lit(0.0))), "player_id", "player_game_number",
        {"points_last_10": "points", "goals_last_10": "goals", "shots_last_10": "shots"}, "game_xg", large=large,
    )
    derived = form_against("season_points_per_gp")
    return form.select(
        S.surrogate_key(*game).alias("player_game_key"), *_FORM_GAME,
        "games_in_window", "points_last_10", "goals_last_10", "shots_last_10", "xg_last_10",
        derived["points_per_gp_last_10"].alias("points_per_gp_last_10"),
        derived["finishing_last_10"].alias("finishing_last_10"), "season_points_per_gp",
        derived["form_delta"].alias("form_delta"),
    )


def shooter_season(shots: DataFrame, shooter: str, season: str, goal: Column, xg: str, flags: dict[str, Column], distance: str) -> DataFrame:
    """Attempts, goals, xG and flag counts per shooter and season."""
    goals = F.count_if(goal)
    return shots.groupBy(shooter, season).agg(
        F.count("*").alias("unblocked_attempts"), goals.alias("goals"),
        S.rnd(F.sum(xg), 2).alias("expected_goals"), S.rnd(goals - F.sum(xg), 2).alias("goals_above_expected"),
        S.ratio(F.sum(xg), F.count("*"), 4).alias("xg_per_attempt"),
        *[F.count_if(c).alias(o) for o, c in flags.items()],
        S.rnd(F.avg(distance), 1).alias("avg_shot_distance_ft"),
    )


def _regular_scored(t: Tables) -> DataFrame:
    return t["fct_shots"].filter(F.col("xg").isNotNull() & (F.col("game_type") == REGULAR))


def mart_player_xg_season(t: Tables) -> DataFrame:
    rows = shooter_season(
        _regular_scored(t), "shooting_player_id", "season_id", F.col("is_goal"), "xg",
        {"rebound_attempts": F.col("is_rebound"), "rush_attempts": F.col("is_rush")}, "distance_ft",
    ).withColumnRenamed("shooting_player_id", "player_id")
    names = t["dim_players"].select("player_id", "full_name", "position_group")
    return rows.join(names, "player_id", "left").select(
        S.surrogate_key(*_PLAYER_SEASON).alias("player_season_key"), *_PLAYER_SEASON, "full_name", "position_group",
        "unblocked_attempts", "goals", "expected_goals", "goals_above_expected", "xg_per_attempt",
        "rebound_attempts", "rush_attempts", "avg_shot_distance_ft",
    )


def mart_team_xg_season(t: Tables) -> DataFrame:
    sides = for_against(
        _regular_scored(t), "team_abbrev", "opponent_abbrev", ["season_id"],
        {"unblocked_attempts": F.lit(1), "goals": F.col("is_goal").cast("long"), "xg": F.col("xg")}, "team_abbrev",
    )
    return sides.select(
        S.surrogate_key("team_abbrev", "season_id").alias("team_season_key"), "team_abbrev", "season_id",
        "unblocked_attempts_for", "unblocked_attempts_against",
        F.col("goals_for").alias("goals_for_model"), F.col("goals_against").alias("goals_against_model"),
        S.rnd("xg_for", 2).alias("xg_for"), S.rnd("xg_against", 2).alias("xg_against"),
        share("xg_for", "xg_against").alias("xg_share"),
        S.rnd(F.col("goals_for") - F.col("xg_for"), 2).alias("goals_above_expected_for"),
        S.rnd(F.col("goals_against") - F.col("xg_against"), 2).alias("goals_above_expected_against"),
    )
