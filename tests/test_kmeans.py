"""K-means starts that move together."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors

from tablewright.operators import kmeans
from tablewright.operators.estimators import SEED, Training, fit_kmeans


def test_starts_share_their_scans(spark, monkeypatch, tmp_path):
    x = np.random.default_rng(5).normal(size=(300, 3)) + np.repeat(np.eye(3) * 6, 100, axis=0)
    rows = [(i, Vectors.dense(v)) for i, v in enumerate(x)]
    data = spark.createDataFrame(rows, ["row_id", "features"])
    rounds, one = [], kmeans._round
    monkeypatch.setattr(kmeans, "_round", lambda b, starts, w: rounds.append(len(starts)) or one(b, starts, w))
    model = fit_kmeans({"n_clusters": 4, "n_init": 3}, Training(data, 300))
    assert rounds[0] == 3 and rounds == sorted(rounds, reverse=True)
    alone = [KMeans(k=4, seed=SEED + i, maxIter=300, tol=1e-4).fit(data) for i in range(3)]
    assert len(rounds) <= max(m.summary.numIter for m in alone)
    best = min(alone, key=lambda m: m.summary.trainingCost)
    by_place = lambda m: np.array(sorted(map(tuple, m.clusterCenters())))
    assert np.allclose(by_place(model), by_place(best), atol=1e-9)
    model.save(str(tmp_path / "m"))
    assert model.transform(data).select("prediction").distinct().count() == 4
