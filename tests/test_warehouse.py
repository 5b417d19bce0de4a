"""Landed files to checked, named marts, and the serving queries on top."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from puckspark.harness.league import CURRENT, PREVIOUS, League, boxscore_docs
from puckspark.harness.registry import Tables
from puckspark.operators.flatten import flatten_boxscores
from puckspark.operators.quality import QualityError
from puckspark.operators.search import run_select
from puckspark.plans import serving, warehouse
from puckspark.plans.staging import build_staging, game_type
from puckspark.session import Pins, pin, shared_dir
from puckspark.sources.raw import read_raw, stamp_loaded
from puckspark.sources.schemas import RAW
from puckspark.sources.sinks import write_ndjson
from test_flatten import random_game


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """The derived league as landed files; playoff games only of the four rounds."""
    folder = tmp_path_factory.mktemp("landed")
    league = League(Tables(spark, "/root/testdata/sf0.001"))
    for table in RAW:
        df = league.raw(table.removeprefix("raw_"))
        if "game_id" in df.columns:
            df = df.filter((game_type() == 2) | F.substring(F.col("game_id").cast("string"), 8, 1).isin("1", "2", "3", "4"))
        write_ndjson(df, f"{folder}/{table}.ndjson")
    return str(folder)


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """Every game's two documents, a file each."""
    folder = tmp_path_factory.mktemp("documents")
    tables = Tables(spark, "/root/testdata/sf0.001")
    for name, df in (("boxscores", boxscore_docs(tables)), ("plays", played_games(tables))):
        df.repartition(1).write.text(f"{folder}/{name}_lines")
        (folder / name).mkdir()
        lines = [line for part in sorted((folder / f"{name}_lines").glob("part-*")) for line in part.read_text().splitlines()]
        for i, line in enumerate(lines):
            (folder / name / f"{i}.json").write_text(line)
    return str(folder)


def played_games(tables):
    """Regular and playoff games with random plays."""
    rng = random.Random(3)
    ids = [r[0] for r in tables.spark.createDataFrame([(2000020000 + i,) for i in range(30)], "id long").collect()]
    games = []
    for i in ids:
        game = random_game(rng, i)
        for p in game["plays"]:
            p.get("details", {}).update(shootingPlayerId=1000000 + rng.randrange(40), goalieInNetId=5, shotType=rng.choice(["wrist", "slap"]))
        games.append((json.dumps({**game, "season": CURRENT}),))
    return tables.spark.createDataFrame(games, "payload string")


@pytest.fixture(scope="module")
def built(spark, landed, tmp_path_factory):
    return warehouse.build_all(spark, landed, str(tmp_path_factory.mktemp("marts")), season_games=None, season=CURRENT, previous=PREVIOUS, spot=[f"Player {i}" for i in range(200)])


def test_nothing_stored_on_the_way_is_left(spark, landed, tmp_path):
    stored = lambda: set(Path(f"{shared_dir(spark)}/puckspark").iterdir())
    pin(spark.range(1))
    before = stored()
    with Pins(spark) as outer:
        kept = pin(spark.range(3))
        with pytest.raises(QualityError):
            warehouse.build_all(spark, landed, str(tmp_path / "out"), season_games=82)
        assert stored() - before == {Path(p) for p in outer.paths} and kept.count() == 3
    assert stored() == before


def test_all_marts_have_rows(built):
    for name in [*warehouse.BASE_MARTS, *warehouse.MODEL_MARTS, *warehouse.REPORTS, "comps_spot_check"]:
        assert not built[name].isEmpty(), name
    assert not built["dim_teams"].filter("is_active").isEmpty()
    report = built["xg_report"].first()
    assert report.n_train > 0 and 0 < report.auc < 1


def test_feeds_from_documents(spark, documents):
    feeds = warehouse.from_documents(spark, f"{documents}/boxscores/*.json", f"{documents}/plays/*.json", "2001-01-01 00:00:00")
    staged = build_staging(feeds)
    flat = build_staging({"raw_player_games": stamp_loaded(flatten_boxscores(boxscore_docs(Tables(spark, "/root/testdata/sf0.001"))), "2001-01-01 00:00:00")})
    key = lambda df: sorted((r.game_id, r.player_id) for r in df.select("game_id", "player_id").collect())
    assert key(staged["stg_player_games"]) == key(flat["stg_player_games"])
    assert staged["stg_shots"].select("game_id", "event_id").distinct().count() == staged["stg_shots"].count() > 0


def test_short_feed_stops_the_build(spark, landed, tmp_path):
    rows = read_raw(spark, landed, "raw_skater_summary")
    totals = rows.groupBy("season_id").agg((F.count("*") + 1).alias("total"))
    with pytest.raises(QualityError) as error:
        warehouse.build_all(spark, landed, str(tmp_path), declared={"raw_skater_summary": totals})
    assert error.value.failures == {"raw_skater_summary is complete": totals.count()}
    assert not list(tmp_path.iterdir())


def test_scores_only_in_scope(built):
    shots = built["fct_shots"]
    scope = (F.col("event_type") != "blocked-shot") & ~F.col("is_empty_net")
    assert shots.filter(scope & F.col("xg").isNull()).isEmpty()
    assert shots.filter(~scope & F.col("xg").isNotNull()).isEmpty()
    assert shots.count() == built["stg_shots"].count()
    assert shots.filter("xg <= 0 or xg >= 1").isEmpty()


def test_named_marts_answer_sql(spark, built):
    out = run_select(spark, "SELECT count(*) AS n FROM nhl_marts.fct_team_games WHERE team_abbrev = :team", {"team": "T07"})
    assert out.first()["n"] == built["fct_team_games"].filter("team_abbrev = 'T07'").count()


def test_serving_on_built_marts(built):
    assert {r.section for r in serving.season_leaders(built, CURRENT).select("section").distinct().collect()} >= {"points", "goals", "xg", "xg_share"}
    assert serving.alltime_leaders(built).count() == 60
    player, comps, _ = serving.comps(built, player_id=1000007, season=CURRENT)
    assert player is None or player["player_id"] == 1000007
    with pytest.raises(ValueError):
        serving.comps(built, name="x")


def test_gate_stops_the_build_and_keeps_what_is_served(spark, built, landed, tmp_path):
    count = lambda: run_select(spark, "SELECT count(*) AS n FROM nhl_marts.fct_team_games").first()["n"]
    before = count()
    with pytest.raises(QualityError) as error:
        warehouse.build_all(spark, landed, str(tmp_path), season_games=82, agreement=0.0)
    assert error.value.failures["every team plays a full season"] > 0
    assert error.value.failures["pp_pct agrees with the games"] > 0
    assert not list(tmp_path.glob("fct_shots*"))
    assert count() == before
