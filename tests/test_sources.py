import pytest
import json

from pyspark.sql import functions as F

from puckspark.harness import league
from puckspark.harness.registry import Tables
from puckspark.plans.staging import SPECS, newest_load, stage, stage_schedule
from puckspark.sources import raw, sinks
from puckspark.sources.schemas import RAW


def write_lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))


def test_read_raw_uses_the_declared_schema(spark, tmp_path):
    write_lines(tmp_path / "raw_teams.ndjson", [{"id": 5, "triCode": "PIT", "extra": 1}, {"id": 6, "fullName": "Bruins"}])
    df = raw.read_raw(spark, str(tmp_path), "raw_teams")
    assert df.columns == ["id", "fullName", "triCode", "franchiseId", "_loaded_at"]
    assert sorted(map(tuple, df.collect())) == [(5, None, "PIT", None, None), (6, "Bruins", None, None, None)]


def test_standings_season(spark, tmp_path):
    write_lines(tmp_path / "raw_standings.ndjson", [{"teamAbbrev": {"default": "PIT"}, "seasonId": 20242025}, {"teamAbbrev": {"default": "BOS"}}])
    df = raw.read_raw(spark, str(tmp_path), "raw_standings", 20252026)
    assert {r.teamAbbrev["default"]: r.season_id for r in df.collect()} == {"PIT": 20242025, "BOS": 20252026}
    assert "seasonId" not in df.columns


def test_one_document_per_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": i, "text": "a\nb"}, indent=1))
    df = raw.read_payloads(spark, f"{tmp_path}/*.json").select(F.get_json_object("payload", "$.id").alias("id"))
    assert sorted(r.id for r in df.collect()) == ["0", "1", "2"]


def test_season_spine(spark):
    ids = [r.season_id for r in raw.season_spine(spark, 1917, 2025).orderBy("season_id").collect()]
    assert (len(ids), ids[0], ids[-1]) == (109, 19171918, 20252026)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "id long, v string")
    path = str(tmp_path / "t")
    assert sinks.publish(df, path) == 2
    assert sinks.publish(df.filter("id = 1"), path) == 1  # replaced in full
    assert raw.table(spark, str(tmp_path), "t").count() == 1
    assert sinks.write_ndjson(df, str(tmp_path / "n")) == 2
    assert '"v":null' in "".join(r.value for r in spark.read.text(str(tmp_path / "n")).collect())


def test_log_appends_whole_texts_or_cuts(spark, tmp_path):
    row = [("q" * 3000, 5, ["s" * 9990, "tail " * 10], 3, 7, "ok", "m")]
    df = spark.createDataFrame(row, "question string, answer_chars int, sql array<string>, row_count int, duration_ms int, status string, model string")
    for _ in range(2):
        sinks.append_log(df, str(tmp_path / "log"), 2000, 10000)
    back = spark.read.json(str(tmp_path / "log")).collect()
    assert len(back) == 2 and back[0].sql_count == 2
    assert (len(back[0].question), len(back[0].sql_queries)) == (2000, 10000)
    assert back[0].sql_queries[9990:] == "\n---\ntail "
    whole = sinks.log_rows(df).first()
    assert (len(whole.question), len(whole.sql_queries)) == (3000, 9990 + 5 + 50)


def test_broken_lines_fail(spark, tmp_path):
    (tmp_path / "raw_teams.ndjson").write_text('{"id": 1}\n{"id": 2, "fullNa')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        raw.read_raw(spark, str(tmp_path), "raw_teams").collect()


def loaded(df, day):
    return raw.stamp_loaded(df, f"2026-01-{day:02d}")


def test_stage_takes_the_newest_load_and_reads_text_numbers(spark):
    names = [c.split()[0] for c in RAW["raw_skater_toi"].split(", ") if not c.startswith("_")]
    row = lambda **v: spark.createDataFrame([tuple(v.get(n) for n in names)], RAW["raw_skater_toi"].rsplit(",", 1)[0])
    key = {"playerId": 1, "season_id": 20252026}
    new, old = row(**key, timeOnIce="90.5", evTimeOnIce="n/a"), row(**key, timeOnIce="1")
    out = stage(loaded(old, 1).unionByName(loaded(new, 2)), SPECS["skater_toi"]).collect()
    assert [(r.player_id, r.toi_seconds, r.ev_toi_seconds, r.pp_toi_seconds) for r in out] == [(1, 90.5, None, None)]


def test_newest_load_counts_keys_and_moves_only_rows_left_over(spark):
    """Keys with one row in the last load, with several, with none, without a load time, and a null key: as by one window over all rows."""
    at = lambda d: F.lit(f"2026-01-{d:02d}" if d else None).cast("timestamp")
    ids = spark.range(400).select(F.when(F.col("id") != 7, F.col("id")).alias("k"), F.col("id").alias("v"))
    parts = [ids.withColumn("_loaded_at", at(3)).where("v % 10 <> 1"), ids.withColumn("_loaded_at", at(2)), ids.withColumn("_loaded_at", at(1)),
             ids.where("v % 50 = 2").withColumn("v", F.col("v") + 1000).withColumn("_loaded_at", at(3)), ids.where("k is null or v = 11").withColumn("_loaded_at", at(0)),
             spark.range(900, 903).select(F.col("id").alias("k"), F.col("id").alias("v"), at(0).alias("_loaded_at"))]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    seen = lambda: newest_load(df, ["k"])
    want = sorted(seen().collect(), key=repr)
    assert len(want) == 403 and "Window" in seen()._jdf.queryExecution().optimizedPlan().toString()
    whole = lambda: newest_load(df.where("v % 10 not in (1, 2) and v < 900"), ["k"])
    for limit in ("100", "5"):  # 52 keys are left over: by broadcast, too many
        spark.conf.set("puckspark.maxBroadcastRows", limit)
        try:
            assert sorted(seen().collect(), key=repr) == want
            assert "Window" not in whole()._jdf.queryExecution().optimizedPlan().toString() and whole().count() == 320
        finally:
            spark.conf.unset("puckspark.maxBroadcastRows")


def test_era_guard_nulls_a_season_of_zeros(spark):
    names = [c.split()[0] for c in RAW["raw_skater_realtime"].split(", ") if not c.startswith("_")]
    data = [(1, 1, 0, 4), (2, 1, 0, 0), (1, 2, 3, None), (2, 2, 0, None)]
    rows = [tuple({"playerId": p, "season_id": s, "hits": h, "takeaways": t, "hitsPer60": 1.5}.get(n) for n in names) for p, s, h, t in data]
    df = loaded(spark.createDataFrame(rows, RAW["raw_skater_realtime"].rsplit(",", 1)[0]), 1)
    got = {(r.player_id, r.season_id): (r.hits, r.takeaways, r.hits_per_60) for r in stage(df, SPECS["skater_realtime"]).collect()}
    assert got == {(1, 1): (None, 4, None), (2, 1): (None, 0, None), (1, 2): (3, None, 1.5), (2, 2): (0, None, 1.5)}


def test_schedule_paths(spark):
    doc = {"gameDate": "2025-10-07", "gameState": "OFF", "startTimeUTC": "2025-10-07T23:00:00Z", "homeTeam": {"abbrev": "AAA", "score": 3},
           "awayTeam": {"abbrev": "BBB"}, "gameOutcome": {"lastPeriodType": "REG"}, "venue": {"default": "Rink"}}
    df = loaded(spark.createDataFrame([(2025030415, 20252026, json.dumps(doc))], "game_id long, season_id long, payload string"), 1)
    r = stage_schedule(df).first()
    assert (r.game_type, str(r.game_date), r.home_abbrev, r.home_score, r.away_score, r.last_period_type, r.venue) == (3, "2025-10-07", "AAA", 3, None, "REG", "Rink")


def test_served_names_move_together(spark, tmp_path):
    folder = str(tmp_path / "out")

    def run(name, shots, teams):
        for table, rows in (("shots", shots), ("teams", teams)):
            sinks.publish(rows, sinks.run_path(folder, table, rows.columns, name))

    one, two = spark.range(3), spark.range(5)
    run("a1", one, one)
    sinks.serve_run(spark, "moving", folder, "a1", {"shots": ["id"], "teams": ["id"]}, f"{folder}/_names")
    seen = lambda: tuple(spark.sql("SELECT (SELECT count(*) FROM moving.shots), (SELECT count(*) FROM moving.teams)").first())
    assert seen() == (3, 3)
    run("1e5", two, two)  # written, not served; a run's name is never read as a number
    assert seen() == (3, 3)
    held = spark.table("moving.shots")
    sinks.serve_run(spark, "moving", folder, "1e5", {"shots": ["id"], "teams": ["id"]}, f"{folder}/_names")
    assert seen() == (5, 5) and held.count() in (3, 5)
    wide = two.withColumn("extra", F.lit(1))
    run("c", wide, one)
    sinks.serve_run(spark, "moving", folder, "c", {"shots": ["id", "extra"], "teams": ["id"]}, f"{folder}/_names")
    assert spark.table("moving.shots").columns == ["id", "extra"] and seen() == (5, 3)
    pruned = spark.sql("SELECT count(*) FROM moving.teams")
    assert "PartitionFilters: [isnotnull(_run" in pruned._jdf.queryExecution().executedPlan().toString()


def test_both_loads_of_a_feed_come_from_one_pass(spark):
    g = league.League(Tables(spark, "/root/testdata/sf0.001"))
    for name in ("schedule", "player_games"):
        feed, landed = g.feed(name), g.raw(name)
        assert landed._jdf.queryExecution().optimizedPlan().toString().count("Relation") == feed._jdf.queryExecution().optimizedPlan().toString().count("Relation")
        loads = {str(r["_loaded_at"]): r["count"] for r in landed.groupBy("_loaded_at").count().collect()}
        assert loads == dict.fromkeys((league.NEW, league.OLD), feed.count())
    assert landed.where(F.col("team_abbrev").isNull()).groupBy("_loaded_at").count().collect()[0]["_loaded_at"] == landed.agg(F.min("_loaded_at")).first()[0]
    new = landed.where(F.col("_loaded_at") == league.NEW).drop("_loaded_at")
    assert new.exceptAll(feed).isEmpty() and feed.exceptAll(new).isEmpty()
