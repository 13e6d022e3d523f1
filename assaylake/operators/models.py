"""Fitting per endpoint with MLlib, ablations, grids and ensembles. Linear, Huber and censored fits are in `linear`.

The driver sees coefficients and scalar metrics only; rows stay in Spark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from .. import registry as R
from ..session import cut_lineage
from . import linear as A, metrics as M
from .censoring import rank_gaussian, rank_gaussian_inverse
from .features import concat_blocks
from .joins import salted_join


def positive_weight(train: DataFrame, label: str) -> float:
    """Weight of positive rows: (1 - p) / p with p clipped away from 0 and 1, at most 20."""
    p = train.agg(F.avg(label)).first()[0]
    p = min(max(p if p is not None else 0.5, R.MIN_POSITIVE_RATE), 1 - R.MIN_POSITIVE_RATE)
    return min((1 - p) / p, R.MAX_POSITIVE_WEIGHT)


def fit_binary(train: DataFrame, features: str, label: str, prefix: str = "", nonlinear: bool = False,
               classes: int = 2, seed: int = 42, max_iter: int = 30) -> PipelineModel:
    """Weighted classifier; output columns `<prefix>prediction` and `<prefix>probability`."""
    weight = f"{prefix}weight"
    if classes == 2:
        w = positive_weight(train, label)
        train = train.withColumn(weight, F.when(F.col(label) == 1, F.lit(w)).otherwise(F.lit(1.0)))
    else:
        train = train.withColumn(weight, F.lit(1.0))
    common = dict(featuresCol=features, labelCol=label, weightCol=weight, predictionCol=f"{prefix}prediction",
                  probabilityCol=f"{prefix}probability", rawPredictionCol=f"{prefix}raw")
    if nonlinear:
        stage = GBTClassifier(maxIter=max_iter, seed=seed, **common)
    else:
        stage = LogisticRegression(maxIter=max_iter, regParam=1e-3,
                                   family="binomial" if classes == 2 else "multinomial", **common)
    return Pipeline(stages=[stage]).fit(train)


def fit_regression(train: DataFrame, features: str, label: str, prefix: str = "", loss: str = "squared",
                   max_iter: int = 50) -> PipelineModel:
    """Linear regression with squared or Huber loss; output column `<prefix>prediction`."""
    if loss not in ("squared", "huber"):
        raise ValueError(f"unknown loss {loss!r}")
    name = "huber" if loss == "huber" else "squaredError"
    stage = LinearRegression(featuresCol=features, labelCol=label, predictionCol=f"{prefix}prediction",
                             loss=name, regParam=1e-2, maxIter=max_iter)
    return Pipeline(stages=[stage]).fit(train)


def fit_endpoint(train: DataFrame, ep: R.Endpoint, features: str, label: str = "y", loss: str = "huber") -> PipelineModel:
    prefix = f"{ep.name}_"
    if ep.kind == R.REGRESSION:
        return fit_regression(train, features, label, prefix, loss)
    return fit_binary(train, features, label, prefix)


def class_probability(column: str, index: int = 1) -> Column:
    return vector_to_array(F.col(column))[index]


def predictions(model: PipelineModel, df: DataFrame, keep: Sequence[str], kind: str, prefix: str = "") -> DataFrame:
    """`keep` columns and `pred`: probability of the positive class, or the regression value."""
    out = model.transform(df)
    value = class_probability(f"{prefix}probability") if kind == R.BINARY else F.col(f"{prefix}prediction")
    return out.select(*keep, value.alias("pred"))


def class_prediction(probability: Column) -> Column:
    """Class id with the largest probability, the smallest id among equals."""
    return F.array_position(probability, F.array_max(probability)).cast("int") - 1


def class_predictions(model: PipelineModel, df: DataFrame, keep: Sequence[str], prefix: str = "") -> DataFrame:
    """`keep` columns, `pred` (class id) and `probabilities` of a multiclass fit."""
    out = model.transform(df).withColumn("probabilities", vector_to_array(F.col(f"{prefix}probability")))
    return out.select(*keep, class_prediction(F.col("probabilities")).alias("pred"), "probabilities")


def leakage_contrast(evaluated: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """(protocol, metric) rows -> controlled, random and the inflation by leakage."""
    def pick(name):
        return F.max(F.when(F.col("protocol") == name, F.col(metric)))
    out = M.grouped(evaluated, by, [pick("controlled").alias("controlled"), pick("random").alias("random")])
    return out.withColumn("inflation", F.col("random") - F.col("controlled"))


def feature_ablation(df: DataFrame, blocks: Mapping[str, int], configs: Mapping[str, Sequence[str]], label: str = "y", split: str = "split",
                     penalty: float = 1e-2) -> DataFrame:
    """The same regression and split over several block combinations: (config, dim, n, r2, rmse) on test rows.

    `blocks` are vector columns and their widths. All configurations are solved from one matrix of sums, and told on one of the test rows.
    """
    rows = concat_blocks(df, list(blocks), "__x")
    found = A.ablation(rows, blocks, configs, "__x", label, split, penalty)
    return df.sparkSession.createDataFrame([(c, d, n, None if r is None else float(r), float(e)) for c, d, n, r, e in found], "config string, dim int, n long, r2 double, rmse double")


def staged_errors(model, rows: DataFrame, y: str) -> list[float]:
    """Mean squared error of a boosted fit after each of its trees, in one pass over the rows."""
    prediction, total, states = F.lit(0.0), [], rows
    for k, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
        tree.setPredictionCol(f"__t{k}")
        states = tree.transform(states)
        prediction = prediction + F.col(f"__t{k}") * float(weight)
        total.append(F.avg((F.col(y) - prediction) ** 2).alias(f"e{k}"))
    return [float(e) for e in states.agg(*total).first()]


def best_stage(errors: Sequence[float], patience: int) -> int:
    """Number of trees with the least error before `patience` trees in a row brought no better one."""
    best = 0
    for k, e in enumerate(errors):
        if e < errors[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def boosted_grid(df: DataFrame, features: str, grid: Sequence[Mapping], label: str = "y", split: str = "split", seed: int = 42, trees: int = 20,
                 patience: int = 10, side_by_side: int = 4) -> DataFrame:
    """Boosted-tree regressors over a grid of tree parameters: (config, n_trees, r2_val, r2_test).

    One fit of `trees` trees per setting; every smaller number of trees is read from the staged errors on the fixed validation split, where early
    stopping with `patience` ends. Fits are submitted side by side. Rank on `r2_val`; the test value is only reported.
    """
    rows = cut_lineage(df.select(features, label, split))
    spread = {r[split]: (r["v"], r["n"]) for r in rows.groupBy(split).agg(F.var_pop(label).alias("v"), F.count(label).alias("n")).collect()}

    def one(params: Mapping) -> tuple:
        model = GBTRegressor(featuresCol=features, labelCol=label, seed=seed, maxIter=trees, **params).fit(rows.where(F.col(split) == "train"))
        count = best_stage(staged_errors(model, rows.where(F.col(split) == "val"), label), patience)
        errors = {side: staged_errors(model, rows.where(F.col(split) == side), label)[count - 1] for side in ("val", "test")}
        r2 = {side: 1.0 - e / spread[side][0] if side in spread and spread[side][0] else None for side, e in errors.items()}
        return ",".join(f"{k}={v}" for k, v in sorted(params.items())), count, r2["val"], r2["test"]

    with ThreadPoolExecutor(side_by_side) as pool:
        runs = list(pool.map(one, grid))
    return df.sparkSession.createDataFrame(runs, "config string, n_trees int, r2_val double, r2_test double")


def seed_ensemble(preds: DataFrame, row_id: str = "row_id", y: str = "y", pred: str = "pred") -> DataFrame:
    """One row per row_id with the mean prediction over seeds."""
    return preds.groupBy(row_id).agg(F.max(y).alias(y), F.avg(pred).alias(pred), F.count(F.lit(1)).alias("n_seeds"))


def rank_ensemble(preds: DataFrame, train_values: DataFrame, row_id: str = "row_id", y: str = "y",
                  z: str = "z") -> DataFrame:
    """Average in normal-score space, then back to target units through the train quantiles."""
    mean = seed_ensemble(preds, row_id, y, z)
    back = rank_gaussian_inverse(mean, train_values, z, y)
    return salted_join(mean, back.withColumnRenamed("value", "pred"), z)


def gaussian_targets(df: DataFrame, y: str = "y", split: str = "split") -> DataFrame:
    """Adds the train-fitted normal score `z` of the target."""
    scores = rank_gaussian(df, y, F.col(split) == "train").select(F.col("value").alias(y), "z")
    return salted_join(df, scores, y, "left")
