import pytest
from pyspark.sql import functions as F

from puckspark.operators import search as se
from puckspark.operators.search import check_select

GOALS = "SELECT full_name, max(goals) AS best FROM nhl_marts.mart_player_career GROUP BY full_name"


@pytest.mark.parametrize("sql", [
    GOALS, f"\n{GOALS} ORDER BY best DESC\t", "WITH top AS (SELECT * FROM nhl_marts.mart_player_season WHERE season_id IN (20252026)) SELECT count(*) FROM top",
    "SELECT `goals` FROM nhl_marts.mart_player_career WHERE full_name LIKE 'O''%(x)'", "SELECT loaded_at, created FROM NHL_MARTS . dim_players"])
def test_accepted_texts(sql):
    assert check_select(sql) == sql.strip()


@pytest.mark.parametrize("word", se.BLOCKED_WORDS)
def test_blocked_words_do_not_pass_inside_strings(word):
    with pytest.raises(ValueError, match="keyword"):
        check_select(f"{GOALS} HAVING full_name <> 'please {word.title()} it'")


@pytest.mark.parametrize("sql", [
    "", " \n", f"{GOALS} ;", f"{GOALS} -- all", f"{GOALS} /* all */", "SHOW TABLES IN nhl_marts", "TABLE nhl_marts.dim_teams", "SELECT 2 + 2",
    "SELECT 'nhl_marts.dim_teams'", "SELECT * FROM nhl_raw.raw_skaters, nhl_marts.dim_teams", "SELECT * FROM nhl_marts.dim_teams WHERE 'x",
    "SELECT value FROM text.`/etc/hostname` WHERE 'nhl_marts.t' <> ''", "SELECT t.* FROM nhl_marts.dim_teams t, json.`s3a://b/k`",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM nhl_marts.dim_teams",
    "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home') FROM nhl_marts.dim_teams", "SELECT input_file_name() FROM nhl_marts.dim_teams"])
def test_refused_texts(sql):
    with pytest.raises(ValueError):
        check_select(sql)


def test_only_files_of_the_marts_are_read(spark, tmp_path):
    from puckspark.sources import sinks

    sinks.publish(spark.range(3), f"{tmp_path}/open")
    sinks.publish(spark.range(5), f"{tmp_path}/closed")
    sinks.register(spark, "guarded", {"open": f"{tmp_path}/open"})
    spark.read.parquet(f"{tmp_path}/closed").createOrReplaceTempView("closed")
    read = lambda sql, **more: se.run_select(spark, sql, marts="guarded", **more).count()
    assert read("SELECT id FROM guarded.open") == 3
    assert read("SELECT id FROM guarded.open", max_rows=2) == 2
    assert read("SELECT id FROM guarded.open WHERE id > :least", args={"least": 0}) == 2
    with pytest.raises(ValueError, match="only tables"):
        read("SELECT c.id FROM closed c, guarded.open o WHERE c.id = o.id")
    spark.range(5).createOrReplaceTempView("inner_view")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS elsewhere LOCATION '{tmp_path}/elsewhere'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS elsewhere.open USING parquet LOCATION '{tmp_path}/closed'")
    for foreign in (
        "SELECT i.id FROM inner_view i JOIN guarded.open ON true", "SELECT id FROM guarded.open WHERE id IN (SELECT id FROM elsewhere.open)",
        "WITH open AS (SELECT id FROM inner_view) SELECT o.id FROM open o, guarded.open g", "SELECT (SELECT max(id) FROM inner_view) AS m FROM guarded.open",
        "SELECT id FROM guarded.open UNION ALL SELECT id FROM elsewhere.open",
    ):
        with pytest.raises(ValueError, match="only tables"):
            read(foreign)
    for text in ("SELECT current_user AS u FROM guarded.open", "SELECT user AS u FROM guarded.open", "SELECT id FROM guarded.open WHERE session_user = 'x'",
                 "SELECT id FROM guarded.open WHERE id IN (SELECT id FROM guarded.open WHERE current_user = 'x')"):
        with pytest.raises(ValueError, match="not allowed"):
            read(text)
    assert read("WITH o AS (SELECT id, rank() OVER (ORDER BY id) AS r FROM guarded.open) SELECT a.id FROM o a JOIN o b ON a.id = b.id WHERE b.r = 1 AND current_date > DATE'2000-01-01'") == 1
    assert read("SELECT x.id FROM guarded.open x WHERE x.id = (SELECT max(id) FROM guarded.open) AND exists(array(1, 2), e -> e = 1)") == 1


def test_a_plan_tells_what_it_reads(spark, tmp_path):
    from puckspark.sources import sinks
    spark.range(3).write.parquet(f"{tmp_path}/open")
    sinks.register(spark, "guarded", {"open": f"{tmp_path}/open"})
    facts = se.PlanFacts(spark.sql(f"SELECT g.id, current_user() AS u FROM guarded.open g, parquet.`{tmp_path}/open` f WHERE g.id > (SELECT avg(id) FROM guarded.open)"))
    assert ("guarded", "open") in facts.relations and len(facts.relations) == 2 and facts.context == {"CurrentUser"}


@pytest.fixture
def names(spark):
    rows = [(1, "Tim Stützle", 70), (2, "Sidney Crosby", 80), (3, "Ryan Nugent-Hopkins", 82), (4, "Alexis Lafrenière", 60), (5, "Bo Horvat", 9), (6, "Hopper Stutz", 8)]
    return spark.createDataFrame(rows, "id long, name string, gp long")


@pytest.mark.parametrize("query,want", [("stutzle", [1]), ("STÜT", [6, 1]), ("hop", [6, 3]), ("ryan nug", [3]), ("ro", [2]), ("x", []), (" ", []), ("fren", [4])])
def test_suggestions(names, query, want):
    assert [r.id for r in se.suggest(names, "name", query, "id").collect()] == want


def test_part_hits_come_before_inner_hits(names):
    got = [(r.id, r.tier) for r in se.suggest(names, "name", "ho", "id").collect()]
    assert got == [(5, 1), (6, 1), (3, 1)]


def test_find(names):
    assert [r.id for r in se.find_by_name(names, "name", "S", "gp", "id", 2).collect()] == [3, 2]
    assert [r.id for r in se.find_by_name(names, "name", "stutzle", "gp", "id").collect()] == []  # accents count here


def test_age_band(spark):
    df = spark.createDataFrame([(1, 30, 30), (2, 34, 30), (3, None, 30), (4, 27, 30)], "rank int, age int, mine int")
    assert [r["rank"] for r in se.age_band(df, "age", "mine", "rank").collect()] == [1, 4]


def test_profiles_side_by_side(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, 0.25, 0.75), (3, 9.0, 9.0)], "id long, a double, b double")
    got = [tuple(r) for r in se.compare_profiles(df, "id", 1, 2, {"b": "B", "a": "A"}).collect()]
    assert got == [(0, "B", 0.0, 0.75), (1, "A", 0.5, 0.25)]


def test_row_cap(spark, tmp_path):
    from puckspark.sources.sinks import publish, register
    publish(spark.range(500).withColumn("name", F.concat(F.lit("n"), "id")), str(tmp_path / "t"))
    register(spark, "nhl_marts", {"cap_test": str(tmp_path / "t")})
    assert se.run_select(spark, "SELECT * FROM nhl_marts.cap_test").count() == 200
    assert se.run_select(spark, "SELECT * FROM nhl_marts.cap_test LIMIT 5").count() == 5
    assert se.run_select(spark, "SELECT * FROM nhl_marts.cap_test", max_rows=300).count() == 300
    assert se.run_select(spark, "SELECT * FROM nhl_marts.cap_test WHERE name = :n", {"n": "n7"}).first()["id"] == 7
