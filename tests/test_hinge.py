"""Squared hinge: the minimum itself, both ways to the step, and models that predict, save and load."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import hinge
from tablewright.operators.estimators import Training, fit_model
from tablewright.plans.fitting import fit_and_measure, load_fitted, prepare
from tablewright.session import cut_lineage, scratch_path


def points(spark, classes, n=240, d=4):
    rng = np.random.default_rng(classes)
    x = rng.normal(size=(n, d)) * [1, 3, 0.2, 1]
    y = (np.argmax(x @ rng.normal(size=(d, classes)) + rng.normal(size=(n, classes)), axis=1)).astype(float)
    df = spark.createDataFrame([(i, r, v) for i, (r, v) in enumerate(zip(x.tolist(), y.tolist()))], "row_id bigint, x array<double>, label double")
    return x, y, cut_lineage(df.repartition(3).select("row_id", array_to_vector("x").alias("features"), "label"))


def gradient(x, y, cls, w, b, c):
    z, full, sign = np.c_[x, np.ones(len(x))], np.r_[w, b], np.where(y == cls, 1.0, -1.0)
    room = np.maximum(1 - sign * (z @ full), 0)
    return full - 2 * c * z.T @ (sign * room)


@pytest.mark.parametrize("classes,c", [(2, 1.0), (2, 0.01), (4, 3.0)])
@pytest.mark.parametrize("widest", [hinge.MATRIX_FEATURES, 1])
def test_the_gradient_vanishes(spark, monkeypatch, classes, c, widest):
    monkeypatch.setattr(hinge, "MATRIX_FEATURES", widest)
    x, y, data = points(spark, classes)
    asked = [float(k) for k in range(classes)] if classes > 2 else [1.0]
    fit = hinge.fit_squared_hinge(data, 4, asked, c)
    assert fit.residual <= hinge.TOLERANCE
    for k, cls in enumerate(asked):
        start = np.abs(gradient(x, y, cls, np.zeros(4), 0.0, c)).max()
        assert np.abs(gradient(x, y, cls, fit.weights[k], fit.intercepts[k], c)).max() <= 1e-8 * start


@pytest.mark.parametrize("classes", [2, 3])
def test_models_predict_and_come_back(spark, classes):
    x, y, data = points(spark, classes)
    model = fit_model("classification", "linear_svc", {}, Training(data, 240, list(range(classes))))
    told = {r["row_id"]: r["prediction"] for r in model.transform(data).collect()}
    assert np.mean([told[i] == v for i, v in enumerate(y)]) > 0.6
    df = spark.createDataFrame([(*r, f"c{int(v)}") for r, v in zip(x.tolist(), y)], "a double, b double, c double, d double, y string")
    df = cut_lineage(df)
    fitted = fit_and_measure(prepare("classification", df, df, "y"), "linear_svc")
    again = load_fitted(spark, fitted.save(scratch_path(spark, "model")))
    rows = [sorted((r["a"], r["predicted_label"]) for r in m.predict(df).collect()) for m in (fitted, again)]
    assert rows[0] == rows[1] and fitted.metrics["accuracy"] > 0.6
