"""Expected goals: logistic regression on shot features, trained and applied on Spark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puckspark.functions.scalars import rnd
from puckspark.operators.flatten import REGULAR, UNBLOCKED_EVENTS
from puckspark.operators.ordered import nth_rows
from puckspark.operators.sizing import lookup, null_safe_join
from puckspark.session import pin

NUMERIC = ["distance_ft", "angle_deg", "is_rebound", "is_rush"]
CATEGORICAL = ["shot_type", "strength_state"]
HOLDOUT = 0.2
SEED = 42
MAX_ITER = 2000


def eligible_shots(df: DataFrame) -> DataFrame:
    """Unblocked attempts on a goalie."""
    return df.filter(eligible())


def eligible() -> Column:
    return F.col("event_type").isin(UNBLOCKED_EVENTS) & ~F.col("is_empty_net")


def with_inputs(df: DataFrame, numeric=NUMERIC, categorical=CATEGORICAL) -> DataFrame:
    """Numeric columns as doubles; a missing category is the level 'unknown'."""
    return df.withColumns({
        **{f"_x_{c}": F.col(c).cast("double") for c in numeric},
        **{f"_c_{c}": F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in categorical},
    })


def feature_stages(numeric=NUMERIC, categorical=CATEGORICAL) -> list:
    """A level unseen in training gets the extra index, which the encoder drops: all zeros."""
    index = StringIndexer(
        inputCols=[f"_c_{c}" for c in categorical], outputCols=[f"_i_{c}" for c in categorical],
        handleInvalid="keep", stringOrderType="alphabetAsc",
    )
    one_hot = OneHotEncoder(
        inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_o_{c}" for c in categorical], dropLast=True
    )
    assemble = VectorAssembler(
        inputCols=[f"_x_{c}" for c in numeric] + [f"_o_{c}" for c in categorical], outputCol="features"
    )
    return [index, one_hot, assemble]


def stratified_split(df: DataFrame, label: str, keys: list[str], frac: float = HOLDOUT, seed: int = SEED) -> DataFrame:
    """Adds ``is_test``: within each label the first ``frac`` of the rows in seeded hash order.

    The order depends only on the keys, so a retried task repeats the same split; null is a label like any other. A label holds
    a large part of all rows, which are neither sorted nor written again: the last test row of each label is found by counts of
    leading hash bits (``nth_rows``), and every row is compared with it. ``df`` is read a few times, so it should be stored.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *keys))
    sizes = pin(df.groupBy(label).agg(F.round(F.count(F.lit(1)) * frac).cast("long").alias("target")))
    cuts = nth_rows(hashed, [label], "_h", keys, sizes)
    marked = null_safe_join(hashed, lookup(cuts), [label], "left")
    return marked.withColumn("is_test", F.coalesce(F.struct("_h", *keys) <= F.col("cut"), F.lit(False))).drop("_h", "cut")


@dataclass
class XgModel:
    """A fitted model as plain numbers, so that scoring is column arithmetic."""

    intercept: float
    numeric: dict[str, float]  # column -> weight
    levels: dict[str, dict[str, float]]  # column -> {level: weight}; other levels weigh nothing
    n_train: int

    def probability(self, df: DataFrame, out: str = "_p") -> DataFrame:
        inputs = with_inputs(df, list(self.numeric), list(self.levels))
        score = F.lit(self.intercept)
        for c, w in self.numeric.items():
            score = score + F.col(f"_x_{c}") * w
        for c, weights in self.levels.items():
            level = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])
            score = score + F.coalesce(F.try_element_at(level, F.col(f"_c_{c}")), F.lit(0.0))
        work = [c for c in inputs.columns if c[:3] in ("_x_", "_c_")]
        return inputs.withColumn(out, 1 / (1 + F.exp(-score))).drop(*work)


def as_model(fitted: PipelineModel, numeric: list[str], categorical: list[str], n: int) -> XgModel:
    """Weights by column and level, read in the order the features were assembled."""
    indexer, regression = fitted.stages[0], fitted.stages[-1]
    weights = iter(float(w) for w in regression.coefficients.toArray())
    return XgModel(
        float(regression.intercept), {c: next(weights) for c in numeric},
        {c: {level: next(weights) for level in levels} for c, levels in zip(categorical, indexer.labelsArray)}, n,
    )


def fit(train: DataFrame, label: str, numeric=NUMERIC, categorical=CATEGORICAL) -> XgModel:
    """L2 logistic regression with unit strength on unscaled features.

    Rows with equal features and outcome count once with a weight: rink coordinates are
    whole feet, so the iterations run over a table that stops growing with the data.
    Spark averages the loss over the weights, so strength 1 on the sum is 1/n here.
    """
    cols = [f"_x_{c}" for c in numeric] + [f"_c_{c}" for c in categorical]
    rows = with_inputs(train, numeric, categorical).withColumn("_y", F.col(label).cast("double"))
    inputs = pin(rows.groupBy(*cols, "_y").agg(F.count("*").cast("double").alias("_w")))
    n = int(inputs.agg(F.sum("_w")).first()[0] or 0)
    lr = LogisticRegression(
        featuresCol="features", labelCol="_y", weightCol="_w", maxIter=MAX_ITER, regParam=1.0 / max(n, 1),
        elasticNetParam=0.0, standardization=False, tol=1e-6,
    )
    model = Pipeline(stages=[*feature_stages(numeric, categorical), lr]).fit(inputs)
    return as_model(model, list(numeric), list(categorical), n)


def holdout_report(model: XgModel, test: DataFrame, label: str) -> dict[str, float]:
    """Exact area under the ROC curve, and predicted against actual totals, on unseen rows."""
    rows = model.probability(test, "p").groupBy("p", F.col(label).cast("double").alias("y"))
    scored = pin(rows.agg(F.count("*").cast("double").alias("w")))
    auc = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", weightCol="w", numBins=0).evaluate(scored)
    totals = scored.agg(F.sum(F.col("p") * F.col("w")).alias("p"), F.sum(F.col("y") * F.col("w")).alias("y")).first()
    return {"auc": auc, "predicted": totals["p"], "actual": totals["y"]}


def train_xg(shots: DataFrame, report: bool = True) -> tuple[XgModel, dict[str, float]]:
    """Train on the regular season's eligible shots, holding out a fifth of each outcome."""
    eligible_rows = eligible_shots(shots).filter(F.col("game_type") == REGULAR)
    split = pin(stratified_split(pin(eligible_rows), "is_goal", ["game_id", "event_id"]))
    model = fit(split.filter("not is_test"), "is_goal")
    return model, holdout_report(model, split.filter("is_test"), "is_goal") if report else {}


def score_xg(model: XgModel, shots: DataFrame) -> DataFrame:
    """All shots with ``xg`` (5 digits), null outside the model's scope. No join: the
    model runs on every row and the score is kept where it applies."""
    return model.probability(shots).withColumn("xg", F.when(eligible(), rnd("_p", 5))).drop("_p")


def fct_shots(tables: dict[str, DataFrame]) -> DataFrame:
    model, _ = train_xg(tables["stg_shots"], report=False)
    return score_xg(model, tables["stg_shots"])


def calibration(scored: DataFrame) -> DataFrame:
    """Predicted and actual goals over the scored shots."""
    rows = scored.filter(F.col("xg").isNotNull())
    return rows.agg(F.sum("xg").alias("predicted_goals"), F.count_if("is_goal").alias("actual_goals"))


def top_teams(scored: DataFrame, n: int = 5) -> DataFrame:
    totals = scored.filter(F.col("xg").isNotNull()).groupBy("team_abbrev").agg(F.sum("xg").alias("xg"))
    return totals.orderBy(F.desc("xg"), "team_abbrev").limit(n)
