"""Training and scoring (M4-M6, M8) and linear explanations (M9)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.profile import class_balance
from . import boosting
from .boosting import Booster
from .trees import top_contributions


def _weighted(df: DataFrame, label: str, balanced: bool) -> tuple[DataFrame, dict]:
    if not balanced:
        return df, {}
    weight = class_balance(df, label).first()["positive_weight"]  # one scalar
    return df.withColumn("__w", F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(1.0)), {"weightCol": "__w"}


def train_logistic(train: DataFrame, id_col: str, label: str = "label", features_col: str = "features",
                   reg: float = 1e-4, balanced: bool = False, folds: int = 3, max_iter: int = 50, tol: float = 1e-6) -> PipelineModel:
    """L2 logistic model with sigmoid calibration on out-of-fold margins of the train rows (M4)."""
    data, extra = _weighted(train, label, balanced)
    data = data.withColumn("__fold", F.pmod(F.xxhash64(id_col), F.lit(folds)))
    base = LogisticRegression(featuresCol=features_col, labelCol=label, regParam=reg, maxIter=max_iter, tol=tol,
                              rawPredictionCol="margin_vec", probabilityCol="p_raw", predictionCol="pred_raw", **extra)
    out_of_fold = reduce(DataFrame.unionByName, [
        base.fit(data.where(F.col("__fold") != k)).transform(data.where(F.col("__fold") == k)).select(label, "margin_vec")
        for k in range(folds)])
    # the margin vector is (-m, m): a logistic model on it is the sigmoid a*m + b
    sigmoid = LogisticRegression(featuresCol="margin_vec", labelCol=label, maxIter=max_iter,
                                 rawPredictionCol="raw_cal", probabilityCol="probability", predictionCol="prediction")
    return PipelineModel(stages=[base.fit(data), sigmoid.fit(out_of_fold)])


def train_boosted_trees(train: DataFrame, val: DataFrame, id_col: str, numeric: Sequence[str], categorical: Sequence[str] = (), label: str = "label",
                        balanced: bool = False, metric: Callable[[DataFrame], DataFrame] | None = None, **params) -> Booster:
    """Boosted trees that stop while they train, by validation average precision or a metric of the caller's (M5).

    ``params`` are those of ``boosting.Params``. Columns go in as they are: NULLs and categories are the splits' matter.
    """
    weight = float(class_balance(train, label).first()["positive_weight"]) if balanced else None  # one scalar
    return boosting.train(train, val, id_col, numeric, categorical, label, weight, boosting.Params(**params), metric=metric)


def feature_importance(spark: SparkSession, model: Booster) -> DataFrame:
    """Features by split gain (M6): (feature, gain, importance, rank)."""
    return model.importance(spark)


def score_rows(model, df: DataFrame, score: str = "score") -> DataFrame:
    """Positive-class probability of every row (M8); intermediate ML columns are dropped."""
    out = model.transform(df).withColumn(score, vector_to_array("probability")[1])
    return out.select(*[c for c in df.columns if c != score], score)


def explain_linear(model, df: DataFrame, train: DataFrame, names: Sequence[str], keep: Sequence[str], top: int = 5,
                   features_col: str = "features") -> DataFrame:
    """coef * (x - mean) per feature, exact, in SQL (M9). ``model`` is a LogisticRegressionModel."""
    coef, intercept = [float(c) for c in model.coefficients], float(model.intercept)
    xs = vector_to_array(features_col)
    means = train.select(xs.alias("x")).agg(*[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(len(coef))]).first()
    mu = [float(means[i]) for i in range(len(coef))]
    base = intercept + sum(c * m for c, m in zip(coef, mu))
    def literal(v):
        return F.array(*[F.lit(x) for x in v])
    phi = F.zip_with(F.zip_with(xs, literal(mu), lambda x, m: x - m), literal(coef), lambda d, c: d * c)
    total = F.aggregate("phi", F.lit(0.0), lambda s, v: s + v)
    margin = F.lit(intercept) + F.aggregate(F.zip_with(xs, literal(coef), lambda x, c: x * c), F.lit(0.0), lambda s, v: s + v)
    return df.select(*keep, margin.alias("margin"), F.lit(base).alias("base_value"), phi.alias("phi")).select(
        *keep, "margin", "base_value", total.alias("total_contribution"),
        top_contributions(F.col("phi"), list(names), top).alias("contributions"))
