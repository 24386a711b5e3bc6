"""Boosting: the trees of MLlib, whatever the layout of blocks, and models that come back."""

import os

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import boosting
from tablewright.operators.estimators import Training, build_estimator, fit_model, settings
from tablewright.plans.fitting import fit_and_measure, load_fitted, prepare
from tablewright.session import cut_lineage, scratch_path, shared_dir

NAME = "gradient_boosting_regressor"


def numbers(spark, n):
    i = F.col("id")
    x = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)).cast("double") for k, m in ((1, 5000), (2, 2), (3, 7), (4, 1))]
    y = x[0] / 100 + 9 * x[1] * x[2] + F.pmod(F.xxhash64("id"), F.lit(1000)) / 77
    return cut_lineage(spark.range(n).repartition(5).select(i.alias("row_id"), array_to_vector(F.array(*x)).alias("features"), y.cast("double").alias("label")))


def told(model, data):
    return np.array([r["prediction"] for r in model.transform(data).orderBy("row_id").collect()])


def test_trees_are_those_of_mllib(spark, monkeypatch):
    data = numbers(spark, 3000)
    before = set(os.listdir(shared_dir(spark)))
    params = {"n_estimators": 7}
    real, passes = boosting.fit_boosted, []
    monkeypatch.setattr(boosting, "fit_boosted", lambda *a, **k: passes.append(k) or real(*a, **k))
    model = fit_model("regression", NAME, params, Training(data, 3000))
    assert passes and len(model.trees) == 7 and list(model.treeWeights) == [1.0] + [0.1] * 6
    other = build_estimator(NAME, settings("regression", NAME, params), Training(data, 3000)).fit(data)
    assert told(model, data) == pytest.approx(told(other, data), rel=1e-9)
    for name, v in (("BLOCK_ROWS", 100), ("FOLDED", 2), ("FAN_IN", 1)):
        monkeypatch.setattr(boosting, name, v)
    assert told(fit_model("regression", NAME, params, Training(data, 3000)), data) == pytest.approx(told(model, data), rel=1e-9)
    assert not [name for name in set(os.listdir(shared_dir(spark))) - before if name.startswith("boosting-")]
    # Histograms that are too large are left to MLlib.
    monkeypatch.setattr(boosting, "CELLS", 4)
    assert told(fit_model("regression", NAME, {"n_estimators": 2}, Training(data, 3000)), data) is not None and len(passes) == 2


def test_cuts_from_ranks(spark, monkeypatch):
    """Rare values of a feature with two stay apart, few values are all told apart, many in even shares."""
    rows = [(float(i), float(i == 7), float(i % 5), 2.0) for i in range(4000)]
    data = spark.createDataFrame([(list(r),) for r in rows], "x array<double>").select(array_to_vector("x").alias("features"))
    exact = boosting.find_cuts(data, 4000, 4)
    monkeypatch.setattr(boosting, "EXACT_ROWS", 0)
    ranked = boosting.find_cuts(data, 4000, 4)
    for f in (1, 2, 3):
        assert exact[f].tolist() == ranked[f].tolist()
    assert [len(c) for c in exact] == [31, 1, 4, 0] and len(ranked[0]) == 31 and abs(exact[0] - ranked[0]).max() < 40


def test_odd_labels_and_saved_models(spark):
    flat = numbers(spark, 50).withColumn("label", F.lit(3.0))
    assert set(told(fit_model("regression", NAME, {"n_estimators": 3}, Training(flat, 50)), flat)) == {3.0}
    for odd in (None, float("nan")):
        with pytest.raises(Exception, match="finite numbers"):
            fit_model("regression", NAME, None, Training(flat.withColumn("label", F.when(F.col("row_id") == 9, F.lit(odd)).otherwise(3.0)), 50))
    df = cut_lineage(spark.range(200).select((F.col("id") % 17).cast("double").alias("a"), F.concat(F.lit("k"), F.col("id") % 3).alias("b"), (F.col("id") % 17 * 3).cast("double").alias("y")))
    model = fit_and_measure(prepare("regression", df, df, "y"), NAME, {"n_estimators": 5})
    again = load_fitted(spark, model.save(scratch_path(spark, "model")))
    found = [sorted((r["a"], r["b"], r["prediction"]) for r in m.predict(df).collect()) for m in (model, again)]
    assert found[0] == found[1] and len(found[0]) == 200
