"""Radix quantiles, correlations from one scan, and ridge from normal equations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import eda, quantiles
from tablewright.operators.estimators import Training, fit_model
from tablewright.operators.gram import NormalEquations
from tablewright.plans.fitting import load_fitted, prepare, fit_and_measure
from tablewright.session import cut_lineage, scratch_path

PROBABILITIES = [0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 1]


def odd_numbers():
    v = np.random.default_rng(4).normal(size=3000)
    return [
        (x, None if i % 7 == 0 else float(int(x * 10)), float("nan") if i % 5 == 0 else 1e18 * x, -0.0 if i % 2 else 0.0, None, x * 5e-324, i % 3 == 0)
        for i, x in enumerate(v.tolist())
    ]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame(odd_numbers(), "a double, b double, c double, d double, e double, f double, g boolean").repartition(5)


def test_keys_sort_like_values():
    values = np.array([-np.inf, -1e300, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1.5, 2.0, 1e300, np.inf])
    keys = quantiles.keys_of(values)
    assert (np.diff(keys.astype(object)) >= 0).all() and keys[4] == keys[5]
    assert [quantiles.value_of(int(k)) for k in keys] == (values + 0.0).tolist()


def test_quantiles_are_exact(numbers):
    got = quantiles.quantiles(numbers, list("abcdefg"), PROBABILITIES)
    for k, c in enumerate("abcdfg"):
        values = np.array([float(r["abcdefg".index(c)]) for r in odd_numbers() if r["abcdefg".index(c)] is not None])
        want = np.quantile(values[~np.isnan(values)], PROBABILITIES)
        assert np.allclose(got[c], want, rtol=1e-15, atol=0), c
    assert got["e"] == [None] * len(PROBABILITIES)
    assert quantiles.quantiles(numbers.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_more_buckets_than_tables(numbers, monkeypatch):
    want = quantiles.quantiles(numbers, list("abcdf"), PROBABILITIES)
    monkeypatch.setattr(quantiles, "TABLES", 3)
    assert quantiles.quantiles(numbers, list("abcdf"), PROBABILITIES) == want


def test_quantile_plans_hold_no_percentile(numbers):
    plan = quantiles._histograms(numbers.select(F.col("a").alias("v0")), [(0, 0)], 0)._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_correlations_are_pairwise_complete(spark, numbers):
    shifted = numbers.withColumn("far", F.col("a") + 1e7).withColumn("one", F.lit(1e9 / 3))
    got = {(r["x"], r["y"]): r["corr"] for r in eda.correlation_matrix(shifted.drop("f")).collect()}
    frame = pd.DataFrame(odd_numbers(), columns=list("abcdefg")).drop(columns="f").astype(float)
    frame["far"], frame["one"] = frame["a"] + 1e7, 1e9 / 3
    want = frame.corr()
    assert len(got) == len(want) ** 2
    for (x, y), corr in got.items():
        assert (corr is None) == bool(np.isnan(want.loc[x, y])) and (corr is None or abs(corr - want.loc[x, y]) < 1e-8), (x, y)


def test_correlations_are_one_scan(spark, small):
    plan = eda.correlation_matrix(spark.read.parquet(f"{small}/lineitem.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(50, 3, size=(500, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 7 + rng.normal(size=500)
    df = spark.createDataFrame([(i, r, v) for i, (r, v) in enumerate(zip(x.tolist(), y.tolist()))], "row_id bigint, x array<double>, label double")
    return x, y, cut_lineage(df.repartition(4).select("row_id", array_to_vector("x").alias("features"), "label"))


@pytest.mark.parametrize("alpha", [0.1, 1.0, 100.0])
def test_ridge_solves_the_normal_equations(points, alpha):
    x, y, data = points
    model = fit_model("regression", "ridge_regression", {"alpha": alpha}, Training(data, 500))
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), want, rtol=1e-9) and np.isclose(model.intercept, y.mean() - x.mean(0) @ want)
    told = {r["row_id"]: r["prediction"] for r in model.transform(data).collect()}
    assert np.allclose([told[i] for i in range(500)], x @ want + model.intercept)


def test_a_search_scans_once(points, monkeypatch):
    _, _, data = points
    made = []
    real = NormalEquations.__init__
    monkeypatch.setattr(NormalEquations, "__init__", lambda self, *a: (made.append(1), real(self, *a))[1])
    training = Training(data, 500)
    models = [fit_model("regression", "ridge_regression", {"alpha": a}, training) for a in (0.1, 1.0, 10.0)]
    assert len(made) == 1 and len({m.intercept for m in models}) == 3


@pytest.mark.parametrize("name", ["ridge_regression", "random_forest_regressor"])
def test_fitted_models_come_back(spark, name):
    df = cut_lineage(spark.range(300).select((F.col("id") % 17).cast("double").alias("a"), F.concat(F.lit("k"), F.col("id") % 3).alias("b"), F.concat(F.lit("x"), F.col("id") % 5).alias("c"), (F.col("id") % 17 * 3 + F.col("id") % 3).cast("double").alias("y")))
    bench = prepare("regression", df, df, "y")
    model = fit_and_measure(bench, name, {"n_estimators": 5})
    again = load_fitted(spark, model.save(scratch_path(spark, "model")))
    told = [sorted((r["a"], r["b"], r["prediction"]) for r in m.predict(df).collect()) for m in (model, again)]
    assert told[0] == told[1] and len(told[0]) == 300 and model.metrics["rmse"] < 1.5
