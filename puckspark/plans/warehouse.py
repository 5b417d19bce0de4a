"""The whole refresh: raw folder -> published marts, with a quality gate between stages."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from puckspark.operators import quality as dq
from puckspark.operators.flatten import flatten_boxscores, flatten_shots
from puckspark.plans import comps, marts, xg
from puckspark.plans.staging import build_staging
from puckspark.session import Pins
from puckspark.sources.raw import read_payloads, read_raw, stamp_loaded
from puckspark.sources.schemas import RAW
from puckspark.sources.sinks import publish, run_path, serve_run

MARTS_LAYER = "nhl_marts"

# In dependency order. The second group needs the scored shots.
BASE_MARTS = {
    "dim_players": marts.dim_players,
    "dim_teams": marts.dim_teams,
    "fct_team_games": marts.fct_team_games,
    "fct_team_playoff_games": marts.fct_team_playoff_games,
    "fct_player_games": marts.fct_player_games,
    "fct_player_playoff_games": marts.fct_player_playoff_games,
    "mart_player_season": marts.mart_player_season,
    "mart_player_playoff_season": marts.mart_player_playoff_season,
    "mart_player_career": marts.mart_player_career,
    "mart_player_playoff_career": marts.mart_player_playoff_career,
    "mart_goalie_season": marts.mart_goalie_season,
    "mart_goalie_playoff_season": marts.mart_goalie_playoff_season,
    "mart_goalie_career": marts.mart_goalie_career,
    "mart_goalie_playoff_career": marts.mart_goalie_playoff_career,
    "mart_team_season": marts.mart_team_season,
    "mart_team_playoff_season": marts.mart_team_playoff_season,
    "mart_team_special_teams_rolling": marts.mart_team_special_teams_rolling,
}
MODEL_MARTS = {
    "fct_shots": xg.fct_shots,
    "mart_player_similarity": comps.mart_player_similarity,
    "mart_player_form": marts.mart_player_form,
    "mart_player_xg_season": marts.mart_player_xg_season,
    "mart_team_xg_season": marts.mart_team_xg_season,
}
REPORTS = ["xg_report", "xg_top_teams"]

# Mart -> column that must be unique and present.
KEYS = {
    "dim_players": "player_id",
    "fct_team_games": "game_team_key",
    "fct_team_playoff_games": "game_team_key",
    "fct_player_games": "player_game_key",
    "fct_player_playoff_games": "player_game_key",
    "mart_player_season": "player_season_key",
    "mart_player_playoff_season": "player_season_key",
    "mart_player_career": "player_id",
    "mart_player_playoff_career": "player_id",
    "mart_goalie_season": "player_season_key",
    "mart_goalie_playoff_season": "player_season_key",
    "mart_goalie_career": "player_id",
    "mart_goalie_playoff_career": "player_id",
    "mart_team_season": "team_season_key",
    "mart_team_playoff_season": "team_season_key",
    "mart_team_special_teams_rolling": "game_team_key",
}
MODEL_KEYS = {
    "mart_player_form": "player_game_key",
    "mart_player_xg_season": "player_season_key",
    "mart_team_xg_season": "team_season_key",
}
ACCEPTED = [
    ("dim_players", "position_group", ["F", "D", "G"]),
    ("mart_player_season", "position_group", ["F", "D"]),
    ("fct_team_games", "result", ["W", "L", "OTL"]),
    ("fct_player_games", "position_group", ["F", "D", "G"]),
    ("fct_team_playoff_games", "result", ["W", "L"]),
    ("fct_team_playoff_games", "round", [1, 2, 3, 4]),
]
PRESENT = [
    ("dim_players", "position_group"), ("mart_player_season", "position_group"),
    ("mart_player_season", "games_played"), ("mart_team_season", "tri_code"),
    ("fct_team_games", "team_abbrev"), ("fct_team_games", "result"), ("fct_team_games", "pp_opportunities"),
    ("fct_team_games", "times_shorthanded"), ("fct_player_games", "player_id"), ("mart_player_career", "points"),
    ("fct_team_playoff_games", "result"),
]
# Special teams are recorded from 1977-78, shots on goal from 1959-60.
PRESENT_SINCE = [
    ("mart_team_season", "pp_pct", "season_id >= 19771978"),
    ("mart_team_season", "pk_pct", "season_id >= 19771978"),
    ("mart_goalie_season", "save_pct", "season_id >= 19591960 AND shots_against > 0"),
]
MODEL_PRESENT = [
    ("mart_player_form", "points_last_10"), ("mart_player_xg_season", "expected_goals"),
    ("mart_team_xg_season", "xg_share"),
]
CALIBRATION_TOLERANCE = 0.05
SEASON_GAMES = 82


def _key_checks(t: dict[str, DataFrame], keys: dict[str, str]) -> dict[str, DataFrame]:
    out = {}
    for name, key in keys.items():
        out[f"{name}.{key} unique"] = dq.unique(t[name], key)
        out[f"{name}.{key} present"] = dq.absent(t[name], key)
    return out


def base_checks(t: dict[str, DataFrame], team: str | None = None, season_games: int | None = SEASON_GAMES) -> dict[str, DataFrame]:
    checks = _key_checks(t, KEYS)
    for key in ("team_id", "tri_code"):
        checks |= {f"dim_teams.{key} unique": dq.unique(t["dim_teams"], key),
                   f"dim_teams.{key} present": dq.absent(t["dim_teams"], key)}
    checks |= {f"{m}.{c} accepted": dq.ListCheck(t[m], c, tuple(v)) for m, c, v in ACCEPTED}
    checks |= {f"{m}.{c} present": dq.absent(t[m], c) for m, c in PRESENT}
    checks |= {f"{m}.{c} present where tracked": dq.absent(t[m], c, F.expr(w)) for m, c, w in PRESENT_SINCE}
    if season_games:
        checks["every team plays a full season"] = dq.group_count(t["fct_team_games"], "team_abbrev", season_games)
    if team:
        mine = marts.team_slice(t, team)
        checks |= {f"{team} game_id unique": dq.unique(mine, "game_id"), f"{team} game_id present": dq.absent(mine, "game_id")}
        if season_games:
            checks[f"{team} plays a full season"] = dq.SizeCheck(mine, season_games)
    return checks


def model_checks(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    regular = t["fct_shots"].filter("game_type = 2")
    checks = _key_checks(t, MODEL_KEYS)
    checks |= {f"{m}.{c} present": dq.absent(t[m], c) for m, c in MODEL_PRESENT}
    checks["xg calibrated"] = dq.calibration(regular, "xg", F.col("is_goal"), CALIBRATION_TOLERANCE)
    return checks


def agreement_checks(t: dict[str, DataFrame], tolerance: float) -> dict[str, DataFrame]:
    """Power play and penalty kill summed over the games against the season report."""
    games = t["fct_team_games"].groupBy(F.col("team_abbrev").alias("tri_code"), "season_id").agg(
        F.try_divide(F.sum("pp_goals_for"), F.sum("pp_opportunities")).alias("pp_pct"),
        (1 - F.try_divide(F.sum("pp_goals_against"), F.sum("times_shorthanded"))).alias("pk_pct"))
    return {f"{c} agrees with the games": dq.reconcile(t["mart_team_season"], games, ["tri_code", "season_id"], c, tolerance) for c in ("pp_pct", "pk_pct")}


def landed_checks(raw: dict[str, DataFrame], declared: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Feeds against the totals that came with them; ``declared`` maps a feed to (season_id, total)."""
    return {f"{feed} is complete": dq.declared_total(raw[feed], ["season_id"], totals, "total") for feed, totals in declared.items()}


def build_marts(
    spark: SparkSession, staging: dict[str, DataFrame], out_dir: str, team: str | None = None,
    season_games: int | None = SEASON_GAMES, season: int = marts.CURRENT_SEASON, previous: int | None = None,
    agreement: float | None = None, spot: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Publish every mart under a folder of this run; each later mart reads the published form of the earlier ones.

    ``season`` is the current one and ``previous`` the one before it (default: by a year). A failing check raises before any later
    stage runs. Only when all have passed do the served names move to this run, so a failed one leaves them as they were.
    ``agreement`` is the tolerance between games and season reports; ``spot`` names players whose comparisons are published apart.
    """
    tables: dict[str, DataFrame] = {}
    run = uuid.uuid4().hex
    previous = previous or season - 10001
    seasonal = {"dim_teams", "mart_player_career", "mart_goalie_career"}

    def put(name: str, df: DataFrame):
        path = run_path(out_dir, name, df.columns, run)
        publish(df, path)
        tables[name] = spark.read.schema(df.schema).parquet(path)

    with Pins(spark):  # what the marts stored on the way goes once they are published, or once a check has failed
        # Staging is stored too: several marts and their size checks read it, and each read
        # of a view would parse the landed JSON again.
        for name, df in staging.items():
            put(name, df)
        for name, build in BASE_MARTS.items():
            put(name, build(tables, season) if name in seasonal else build(tables))
        put("player_names", marts.player_names(tables))  # for lookups, not among the names served to SQL
        dq.gate(base_checks(tables, team, season_games) | (agreement_checks(tables, agreement) if agreement is not None else {}))
        model, report = xg.train_xg(tables["stg_shots"])
        put("fct_shots", xg.score_xg(model, tables["stg_shots"]))
        put("xg_report", spark.createDataFrame([(model.n_train, *(float(report[k]) for k in ("auc", "predicted", "actual")))], "n_train long, auc double, predicted double, actual double"))
        put("xg_top_teams", xg.top_teams(tables["fct_shots"]))
        for name, build in MODEL_MARTS.items():
            if name != "fct_shots":
                put(name, build(tables, season, previous) if name == "mart_player_similarity" else build(tables))
        if spot:
            put("comps_spot_check", comps.spot_check(tables["mart_player_similarity"], tables["dim_players"].select("player_id", "full_name"), list(spot)))
        dq.gate(model_checks(tables))
        served = [*BASE_MARTS, *MODEL_MARTS, *REPORTS, *(["comps_spot_check"] if spot else [])]
        serve_run(spark, MARTS_LAYER, out_dir, run, {n: tables[n].columns for n in served}, f"{out_dir}/_names")
    return tables


def from_documents(spark: SparkSession, boxscores: str | None, plays: str | None, loaded: str) -> dict[str, DataFrame]:
    """The player-game and shot feeds out of landed game documents, one JSON document per file."""
    out = {}
    if boxscores:
        out["raw_player_games"] = stamp_loaded(flatten_boxscores(read_payloads(spark, boxscores)), loaded)
    if plays:
        out["raw_shots"] = stamp_loaded(flatten_shots(read_payloads(spark, plays)), loaded)
    return out


def build_all(
    spark: SparkSession, raw_dir: str, out_dir: str, boxscores: str | None = None, plays: str | None = None, loaded: str | None = None,
    declared: dict[str, DataFrame] | None = None, **options,
) -> dict[str, DataFrame]:
    """Landed files to published, checked and named marts.

    ``boxscores`` and ``plays`` are globs of game documents; where given, the feeds made from them take the place of the flat ones.
    ``loaded`` is their load time (default: now). ``declared`` holds the totals that the feeds must have.
    """
    loaded = loaded or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    made = from_documents(spark, boxscores, plays, loaded)
    raw = {name: read_raw(spark, raw_dir, name) for name in RAW if name not in made} | made
    if declared:
        dq.gate(landed_checks(raw, declared))
    with Pins(spark):  # the rows that staging stored go once the marts are published
        return build_marts(spark, build_staging(raw), out_dir, **options)
