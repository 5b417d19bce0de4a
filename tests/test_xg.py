import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from puckspark.plans import xg

SCHEMA = ("game_id long, event_id long, game_type int, event_type string, is_goal boolean, is_empty_net boolean, "
          "distance_ft double, angle_deg double, is_rebound boolean, is_rush boolean, shot_type string, strength_state string")


def shots(spark, n=4000, seed=0):
    """Attempts drawn by hash, so that any number of partitions gives the same rows; goals follow a known law."""
    draw = lambda k: F.pmod(F.xxhash64("event_id", F.lit(seed), F.lit(k)), F.lit(100_003)) / 100_003.0
    pick = lambda k, *levels: F.element_at(F.array(*[F.lit(v) for v in levels]), (draw(k) * len(levels)).cast("int") + 1)
    rows = spark.range(n).withColumnRenamed("id", "event_id").withColumns({
        "distance_ft": F.floor(6 + 52 * draw(1)).cast("double"), "angle_deg": F.floor(75 * draw(2)).cast("double"),
        "is_rebound": draw(3) < 0.4, "is_rush": draw(4) < 0.3, "is_empty_net": draw(5) < 0.04,
        "shot_type": F.when(F.col("event_id") % 37 > 0, pick(6, "snap", "backhand", "deflected")), "strength_state": pick(7, "EV", "PP", "SH"),
        "game_id": F.floor(F.col("event_id") / 40).cast("long"), "game_type": F.when(F.col("event_id") % 11 == 0, 3).otherwise(2),
    })
    chance = 1 / (1 + F.exp(0.3 + 0.055 * F.col("distance_ft") - 0.9 * F.col("is_rebound").cast("int")))
    rows = rows.withColumn("is_goal", draw(8) < chance)
    kind = F.when(F.col("is_goal"), "goal").otherwise(pick(9, "missed-shot", "shot-on-goal", "blocked-shot"))
    return rows.withColumn("event_type", kind).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def features(spark, train, df):
    stages = Pipeline(stages=xg.feature_stages()).fit(xg.with_inputs(train))
    return [r.features.toArray() for r in stages.transform(xg.with_inputs(df)).collect()]


def test_features(spark):
    df = shots(spark, 60)
    rows = features(spark, df, df)
    assert {len(r) for r in rows} == {4 + 4 + 3}  # four numbers, three types and 'unknown', three states
    assert all(np.isfinite(r).all() and r[4:8].sum() == 1 and r[8:].sum() == 1 for r in rows)


def test_unseen_category_is_all_zeros(spark):
    df = shots(spark, 60)
    new = df.limit(1).withColumn("shot_type", F.lit("batted out of the air"))
    assert features(spark, df, new)[0][4:8].sum() == 0


def test_split_is_stratified_and_repeatable(spark):
    df = shots(spark)
    split = lambda d: {r.event_id for r in xg.stratified_split(d, "is_goal", ["game_id", "event_id"]).filter("is_test").collect()}
    once = split(df)
    assert once == split(df.repartition(13, "event_id"))
    for goal in (True, False):
        ids = {r.event_id for r in df.filter(F.col("is_goal") == goal).collect()}
        assert abs(len(once & ids) - 0.2 * len(ids)) <= 1


def test_unseen_level_weighs_nothing(spark):
    model = xg.XgModel(0.0, {"distance_ft": 0.0}, {"shot_type": {"wrist": 2.0}}, 1)
    df = spark.createDataFrame([(1.0, "wrist"), (1.0, "lob"), (1.0, None)], "distance_ft double, shot_type string")
    assert [round(r._p, 6) for r in model.probability(df).collect()] == [0.880797, 0.5, 0.5]


def newton(x, y):
    """Unit-strength L2 logistic regression (free intercept) by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x1.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x1 @ w))
        step = np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + penalty, x1.T @ (p - y) + penalty @ w)
        w -= step
    return w


def test_model_is_the_unit_strength_optimum(spark):
    train = xg.eligible_shots(shots(spark, 1500))
    model = xg.fit(train, "is_goal")
    assert model.n_train == train.count()
    x = np.array(features(spark, train, train))
    y = np.array([float(r.is_goal) for r in train.collect()])
    want = newton(x, y)
    weights = [*model.numeric.values(), *(w for levels in model.levels.values() for w in levels.values()), model.intercept]
    assert np.allclose(weights, want, atol=2e-3)
    scored = model.probability(train.withColumn("pos", F.monotonically_increasing_id())).orderBy("pos").select("_p").collect()
    x1 = np.hstack([x, np.ones((len(x), 1))])
    assert np.allclose([r._p for r in scored], 1 / (1 + np.exp(-x1 @ np.array(weights))), atol=1e-12)


def test_training_report_and_scores(spark):
    df = shots(spark)
    model, report = xg.train_xg(df)
    regular = xg.eligible_shots(df).filter("game_type = 2").count()
    assert abs(model.n_train - 0.8 * regular) <= 2
    assert 0.6 < report["auc"] < 0.95
    assert report["predicted"] == pytest.approx(report["actual"], rel=0.35)
    scored = xg.score_xg(model, df)
    assert scored.count() == df.count()
    assert scored.filter("xg is not null").count() == xg.eligible_shots(df).count()
    assert scored.filter("xg is not null and xg <> round(xg, 5)").isEmpty()
    sums = xg.calibration(scored.filter("game_type = 2")).first()
    assert sums["predicted_goals"] == pytest.approx(sums["actual_goals"], rel=0.1)
    assert xg.top_teams(scored.withColumn("team_abbrev", F.concat(F.lit("T"), F.col("game_id") % 7))).count() == 5


def test_exact_auc(spark):
    df = shots(spark, 1200)
    model = xg.fit(xg.eligible_shots(df), "is_goal")
    auc = xg.holdout_report(model, xg.eligible_shots(df), "is_goal")["auc"]
    rows = model.probability(xg.eligible_shots(df)).select("_p", "is_goal").collect()
    pos, neg = [r._p for r in rows if r.is_goal], [r._p for r in rows if not r.is_goal]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(want, abs=1e-9)
