"""Fits from sums, staged grids and multiclass scoring against plain numpy, MLlib and first-order conditions."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from assaylake.operators import linear as A, metrics as M, models as L


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4)) * [1, 5, 0.1, 1] + [0, 3, 1, 0]
    x[:, 3] = 2.5  # a constant feature
    return x, x @ [1, -0.5, 3, 0] + 2 + rng.standard_t(2, size=600)


def frame(spark, x, y, **more):
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], ", ".join(f"f{i} double" for i in range(x.shape[1])) + ", y double")
    return VectorAssembler(inputCols=df.columns[:-1], outputCol="x").transform(df)


def test_ridge_equals_the_solver_of_mllib(spark, data):
    x, y = data
    df = frame(spark, x, y).repartition(5)
    sums = A.moments(df, "x", "y")[0]
    z = np.column_stack((x, np.ones(len(y)), y))
    assert np.allclose(sums, z.T @ z)
    for penalty in (0.0, 1e-2, 3.0):
        fit, model = A.ridge(sums, penalty=penalty), LinearRegression(featuresCol="x", labelCol="y", solver="normal", regParam=penalty).fit(df)
        assert np.allclose(fit.coefficients, model.coefficients.toArray(), atol=1e-6) and fit.intercept == pytest.approx(model.intercept, abs=1e-6)
        n, r2, rmse = A.fit_metrics(sums, fit)
        assert (n, r2, rmse) == (600, pytest.approx(model.summary.r2, abs=1e-9), pytest.approx(model.summary.rootMeanSquaredError, abs=1e-9))
    told = df.select(F.max(F.abs(fit.predict("x") - F.lit(0))).alias("m")).first()["m"]
    assert told == pytest.approx(np.abs(x @ fit.coefficients + fit.intercept).max())


def test_ablation_equals_single_fits(spark, data):
    x, y = data
    df = frame(spark, x, y).withColumn("split", F.when(F.abs(F.xxhash64("y")) % 3 == 0, "test").otherwise("train"))
    df = df.withColumns({"one": array_to_vector(F.array("f0")), "two": array_to_vector(F.array("f1", "f2")), "flat": array_to_vector(F.array("f3"))})
    configs = {"one": ["one"], "two": ["two"], "both": ["two", "one"], "all": ["one", "two", "flat"], "flat": ["flat"]}
    got = {r["config"]: r for r in L.feature_ablation(df, {"one": 1, "two": 2, "flat": 1}, configs).collect()}
    for name, blocks in configs.items():
        rows = VectorAssembler(inputCols=blocks, outputCol="v").transform(df)
        model = LinearRegression(featuresCol="v", labelCol="y", solver="normal", regParam=1e-2).fit(rows.where("split = 'train'"))
        summary = model.evaluate(rows.where("split = 'test'"))
        assert got[name]["r2"] == pytest.approx(summary.r2, abs=1e-6) and got[name]["rmse"] == pytest.approx(summary.rootMeanSquaredError, abs=1e-6)
        assert (got[name]["dim"], got[name]["n"]) == (sum({"one": 1, "two": 2, "flat": 1}[b] for b in blocks), rows.where("split = 'test'").count())


@pytest.mark.parametrize("delta, penalty", [(1.0, 0.0), (1.0, 0.05), (0.1, 0.0), (100.0, 0.0)])
def test_huber_meets_its_first_order_condition(spark, data, delta, penalty):
    x, y = data
    fit = A.huber_fit(frame(spark, x, y), "x", delta=delta, penalty=penalty)
    pull = np.clip(y - x @ fit.coefficients - fit.intercept, -delta, delta)
    spread = x.std(axis=0)
    slope = (pull @ x) / len(y) - penalty * spread ** 2 * fit.coefficients
    assert abs(pull.mean()) < 1e-7 and np.all(np.abs(slope[:3]) < 1e-6) and fit.coefficients[3] == 0
    losses = [h[1] for h in fit.history]
    assert losses[-1] <= losses[0] and fit.passes <= 30
    if delta == 100.0:  # no residual is beyond: the plain fit
        assert np.allclose(fit.coefficients, A.ridge(A.moments(frame(spark, x, y), "x", "y")[0], penalty=0.0).coefficients, atol=1e-6)


def test_censored_fit_recovers_and_is_stationary(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 2)) * [2, 0.5]
    latent = x @ [1.5, -2.0] - 9 + rng.normal(size=2000)
    fit = A.tobit_fit(frame(spark, x, np.maximum(latent, -10.0)), "x")
    assert fit.passes <= 15 and fit.gradient < 1e-8
    for value, error, want in zip((*fit.coefficients, fit.intercept, fit.sigma), fit.errors, (1.5, -2.0, -9.0, 1.0)):
        assert 0 < error < 0.15 and abs(value - want) < 4 * error
    # without a censored row it is least squares
    plain = A.tobit_fit(frame(spark, x, latent + 1000), "x")
    least = A.ridge(A.moments(frame(spark, x, latent + 1000), "x", "y")[0], penalty=0.0)
    assert np.allclose(plain.coefficients, least.coefficients, atol=1e-7)
    assert plain.sigma == pytest.approx(math.sqrt(np.mean((latent + 1000 - x @ least.coefficients - least.intercept) ** 2)))
    with pytest.raises(ValueError, match="no rows"):
        A.tobit_fit(frame(spark, x[:1], latent[:1]).where("false"), "x")


def test_mills_ratio_in_both_tails():
    z = np.array([-400.0, -31.0, -30.0, -29.0, -5.0, 0.0, 5.0, 40.0])
    ratio, log_cdf = A._mills(z)
    assert np.all(np.diff(ratio) < 0) and ratio[0] == pytest.approx(400.0025, rel=1e-6) and ratio[5] == pytest.approx(math.sqrt(2 / math.pi))
    assert np.all(np.diff(log_cdf) >= 0) and log_cdf[5] == pytest.approx(math.log(0.5)) and log_cdf[-1] == 0
    assert ratio[1] - ratio[2] == pytest.approx(1.0, abs=0.01)


def test_grid_reads_stages_and_ranks_on_validation(spark, data):
    x, y = data
    df = frame(spark, x, y).withColumn("split", F.element_at(F.array(*[F.lit(s) for s in ("train", "train", "val", "test")]), (F.abs(F.xxhash64("f0")) % 4 + 1).cast("int")))
    out = L.boosted_grid(df, "x", [{"maxDepth": 2}, {"maxDepth": 4, "stepSize": 0.5}], trees=6, patience=2).collect()
    assert [r["config"] for r in out] == ["maxDepth=2", "maxDepth=4,stepSize=0.5"] and all(1 <= r["n_trees"] <= 6 for r in out)
    model = GBTRegressor(featuresCol="x", labelCol="y", seed=42, maxIter=6, maxDepth=2).fit(df.where("split = 'train'"))
    staged = L.staged_errors(model, df.where("split = 'val'"), "y")
    plain = model.evaluateEachIteration(df.where("split = 'val'"), "squared")
    assert np.allclose(staged, plain) and out[0]["n_trees"] == L.best_stage(staged, 2)
    assert [L.best_stage(e, 2) for e in ([3, 2, 1], [1, 2, 3, 0], [2, 1, 3, 0], [1])] == [3, 1, 4, 1]


def test_multiclass_confusion_and_ties(spark):
    rows = [(0, [0.5, 0.5, 0.0]), (1, [0.2, 0.3, 0.5]), (2, [0.0, 0.1, 0.9]), (1, [0.0, 1.0, 0.0]), (3, [0.4, 0.3, 0.3])]
    df = spark.createDataFrame(rows, "y int, p array<double>").withColumn("pred", L.class_prediction(F.col("p")))
    got = {r["class"]: r for r in M.multiclass_confusion(df).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    cells = {c: (r["support"], r["n_predicted"], r["hits"]) for c, r in got.items()}
    assert cells == {0: (1, 2, 1), 1: (2, 1, 1), 2: (1, 2, 1), 3: (1, 0, 0)}
    assert got[3]["precision"] is None and got[0]["precision"] == 0.5 and got[1]["recall"] == 0.5 and all(r["accuracy"] == 0.6 for r in got.values())
