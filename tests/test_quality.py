import pytest
from pyspark.sql import functions as F

from puckspark.operators import quality as dq


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, "W", 2020), (1, "L", 2021), (2, None, 1990), (None, "X", 2021)], "id long, r string, season long")


def test_unique_ignores_nulls(df):
    assert [tuple(r) for r in dq.unique(df, "id").collect()] == [(1, 2)]


def test_not_null_and_scope(df):
    assert dq.not_null(df, "r").count() == 1
    assert dq.not_null(df, "r", F.col("season") >= 2000).count() == 0


def test_accepted_lets_nulls_pass(df):
    assert [tuple(r) for r in dq.accepted(df, "r", ["W", "L"]).collect()] == [("X", 1)]


def test_counts(df):
    assert dq.row_count(df, 4).isEmpty() and not dq.row_count(df, 82).isEmpty()
    assert sorted(r.id for r in dq.group_count(df.filter("id is not null"), "id", 2).collect()) == [2]


@pytest.mark.parametrize("xg,failing", [(1.0, 0), (0.9, 1), (1.04, 0), (1.06, 1)])
def test_calibration(spark, xg, failing):
    df = spark.range(100).select((F.lit(xg) / 4).alias("xg"), (F.col("id") % 4 == 0).alias("is_goal"))
    df = df.unionByName(spark.range(50).select(F.lit(None).cast("double").alias("xg"), F.lit(True).alias("is_goal")))
    assert dq.calibration(df, "xg", F.col("is_goal"), 0.05).count() == failing


def test_declared_totals(spark):
    got = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    said = spark.createDataFrame([("a", 2), ("b", 3), ("c", 1), ("d", None)], "k string, total long")
    assert sorted(map(tuple, dq.declared_total(got, ["k"], said, "total").collect())) == [("b", 3, 1), ("c", 1, 0)]


def test_reconcile(spark):
    a = spark.createDataFrame([("PIT", 0.2414), ("BOS", 0.2)], "t string, v double")
    b = spark.createDataFrame([("PIT", 0.24141), ("BOS", 0.21)], "t string, v double")
    assert [r.t for r in dq.reconcile(a, b, ["t"], "v", 0.0001).collect()] == ["BOS"]


def test_gate(df):
    assert dq.gate({"rows": dq.row_count(df, 4)}) == {"rows": 0}
    with pytest.raises(dq.QualityError) as error:
        dq.gate({"rows": dq.row_count(df, 4), "ids": dq.unique(df, "id")})
    assert error.value.failures == {"ids": 1}


def test_checks_of_one_table_share_a_scan(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    checks = {
        "r": dq.absent(t, "r"), "late": dq.absent(t, "r", F.col("season") >= 2000), "kinds": dq.ListCheck(t, "r", ("W", "L")), "none": dq.ListCheck(t, "id", ()),
        "rows": dq.SizeCheck(t, 4), "more": dq.SizeCheck(t, 5),
    }
    out = dq.summary(checks)
    assert {r["check"]: r.failures for r in out.collect()} == {"r": 1, "late": 0, "kinds": 1, "none": 2, "rows": 0, "more": 1}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    both = dq.summary(checks | {"ids": dq.unique(t, "id")})
    assert {r["check"]: r.failures for r in both.collect()}["ids"] == 1
    empty = dq.summary({k: type(c)(t.limit(0), *[getattr(c, f) for f in list(c.__dataclass_fields__)[1:]]) for k, c in checks.items()})
    assert {r["check"]: r.failures for r in empty.collect()} == {"r": 0, "late": 0, "kinds": 0, "none": 0, "rows": 1, "more": 1}
