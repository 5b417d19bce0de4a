"""Lookups by name parts must find what a comparison with every name finds."""

import random

import pytest
from pyspark.sql import functions as F

from puckspark.operators import names as nm
from puckspark.operators import search as se

NAMES = [
    "Tim Stützle", "Sidney Crosby", "Ryan Nugent-Hopkins", "Alexis Lafrenière", "Bo Horvat", "Hopper Stutz", "Bo", "", "x", "Jørgen Ærø", "Łukasz Straße",
    "Zoë Loose", "ΑΛΕΞ Ovi", "İzmir O'Neil", "Tim Stützle", "TIM STUTZLE", "A. J. Greer", "ﬁn Ligature", "line\nbreak", "SKate", None,
]


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(5)
    letters = "aAáÅbBñÑoöØ -.'tT"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(200)]
    rows = [(i, n, (i * 7) % 30 or None) for i, n in enumerate(NAMES + made + made[:40] + ["Bo Common"] * 300)]
    return spark.createDataFrame(rows, "id long, name string, gp long")


@pytest.fixture(scope="module")
def stored(spark, people, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("names") / "parts")
    nm.name_parts(people, "name", ["id", "gp"]).write.parquet(path)
    return spark.read.parquet(path)


QUERIES = [
    "", "b", "bo", "BO", "stutzle", "STÜT", "hop", "ryan nug", "fren", "nugent-h", "ær", "aero", "strasse", "loose", "zoe", "zoë l", "αλεξ", "ovi", "izmir", "i̇z", "o'n", "fin",
    "line", "\n", "skate", "t", " ", "ño", "oo", "å-", "no such name", "Common",
]


@pytest.mark.parametrize("query", QUERIES)
def test_lookups_find_the_same(people, stored, query):
    few = nm.candidates(stored, "name", query)
    ids = lambda df: [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    assert ids(se.find_by_name(few, "name", query, "gp", "id", 500)) == ids(se.find_by_name(people.where("name is not null"), "name", query, "gp", "id", 500))
    q = query.strip()
    few = nm.candidates(stored, "name", q)
    assert ids(se.suggest(few, "name", q, "id", 500)) == ids(se.suggest(people, "name", q, "id", 500))


def test_every_fold_is_equal_without_case_or_accents(spark):
    folds = spark.createDataFrame(list(nm.FOLDS.items()), "a string, b string")
    assert len(nm.FOLDS) > 300
    assert folds.where(se.folded(F.col("a")) != se.folded(F.col("b"))).isEmpty()
    plain = spark.range(32, 127).select(F.char("id").alias("c")).where(F.lower("c") == F.col("c"))
    assert plain.groupBy(se.folded(F.col("c"))).count().where("count > 1").isEmpty()


def test_few_names_are_read(spark, stored, people):
    few = nm.candidates(stored, "name", "crosby")
    odd = people.where(~nm.folded_name(F.col("name")).rlike(r"\A[ -~]*\z")).count()
    assert few.count() == 1 + odd
    scan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or" in scan or "In(_gram" in scan


def test_empty_table(spark):
    none = spark.createDataFrame([], "id long, name string")
    parts = nm.name_parts(none, "name", ["id"])
    assert nm.candidates(parts, "name", "bo h").columns == ["name", "id"] and nm.candidates(parts, "name", "bo h").isEmpty()
