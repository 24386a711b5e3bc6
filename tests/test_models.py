import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablewright.operators import cluster_metrics, density, metrics, neighbors
from tablewright.operators.components import connected_components
from tablewright.operators.estimators import MODELS, Training, build_estimator, fit_model, settings
from tablewright.plans.config import RunConfig, choose_models
from tablewright.plans.tuning import combinations


def points(n, dims, seed=1, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    return np.round(x * grid) / grid if grid else x


def frame(spark, x, name="features"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"id bigint, {name} array<double>")


def brute_knn(x, q, k, skip_self):
    out = {}
    for i, p in enumerate(q):
        far = sorted((math.sqrt(((p - t) ** 2).sum()), j) for j, t in enumerate(x) if not (skip_self and i == j))
        out[i] = far[:k]
    return out


@pytest.mark.parametrize("grid,pivots,tile", [(None, 7, 40), (1, 5, 50)])
def test_knn_is_exact(spark, grid, pivots, tile):
    x = points(150, 3, grid=grid)
    x = np.vstack([x, np.repeat(x[:1], 75, axis=0)])  # a third of the rows are copies
    df = frame(spark, x)
    got = {}
    for r in neighbors.knn_join(df, df, 4, exclude_self=True, tile_rows=tile, pivots=pivots).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["distance"], r["neighbor_id"]))
    want = brute_knn(x, x, 4, True)
    assert got.keys() == want.keys()
    for i in want:
        assert [j for _, j in got[i]] == [j for _, j in want[i]]
        assert [d for d, _ in got[i]] == pytest.approx([d for d, _ in want[i]])


def test_knn_with_few_points_votes_and_ties(spark):
    df = frame(spark, np.array([[0.0], [1.0], [5.0]])).withColumn("label", F.col("id") % 2)
    asked = frame(spark, np.array([[0.4], [0.5]]))
    near = neighbors.knn_join(asked, df, 5, payload=["label"])
    assert near.groupBy("id").count().filter("count = 3").count() == 2
    two = neighbors.knn_join(asked, df, 2, payload=["label"])
    assert {r["id"]: r["prediction"] for r in neighbors.vote(two).collect()} == {0: 0, 1: 0}  # tie: smallest label
    assert {r["id"]: r["prediction"] for r in neighbors.mean(two).collect()} == {0: 0.5, 1: 0.5}
    assert [r["neighbor_id"] for r in two.filter("id = 1").orderBy("rank").collect()] == [0, 1]
    loose = neighbors.knn_join_approx(asked, df, 2, threshold=10.0)
    assert loose.count() > 0


def brute_dbscan(x, eps, m):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = far <= eps
    core = near.sum(1) >= m
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], i
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if label[j] < 0:
                        label[j] = i
                        stack.append(j)
    for i in np.flatnonzero(~core):
        hits = label[near[i] & core]
        label[i] = hits.min() if len(hits) else -1
    return label, core


@pytest.mark.parametrize(
    "make,eps,m,tile,pivots",
    [
        (lambda: np.vstack([points(60, 2), points(150, 2, 2) * 0.02 + 3, np.tile([[9.0, 9.0]], (70, 1))]), 0.4, 6, 60, 4),
        (lambda: points(120, 6), 1.2, 4, 60, 3),
    ],
)
def test_dbscan_equals_brute_force(spark, make, eps, m, tile, pivots):
    x = make()
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in density.dbscan(frame(spark, x), eps, m, tile_rows=tile, pivots=pivots).collect()}
    label, core = brute_dbscan(x, eps, m)
    assert [got[i] for i in range(len(x))] == list(zip(label.tolist(), core.tolist()))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(7, 7), (500, 500)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(31)} | {i: 100 for i in range(100, 160)} | {500: 500}
    assert got == want


def silhouette_by_pairs(x, c):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = far[i][own].sum() / (own.sum() - 1)
        b = min(far[i][c == k].mean() for k in set(c) - {c[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def test_cluster_metrics(spark):
    x = np.vstack([points(60, 2), points(40, 2, 3) + 4, np.tile([[8.0, 0.0]], (30, 1)), [[20.0, 20.0]]])
    c = np.array([0] * 60 + [1] * 40 + [2] * 30 + [-1])
    df = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, c)], "features array<double>, prediction int")
    for tile in (60,):
        got = cluster_metrics.silhouette(df, tile_rows=tile).first()[0]
        assert got == pytest.approx(silhouette_by_pairs(x, c))
    centres = {k: x[c == k].mean(0) for k in set(c)}
    s = {k: np.sqrt(((x[c == k] - centres[k]) ** 2).sum(1)).mean() for k in centres}
    worst = [max((s[i] + s[j]) / np.linalg.norm(centres[i] - centres[j]) for j in centres if j != i) for i in centres]
    assert cluster_metrics.davies_bouldin(df).first()[0] == pytest.approx(np.mean(worst))
    b = sum((c == k).sum() * ((centres[k] - x.mean(0)) ** 2).sum() for k in centres)
    w = sum(((x[c == k] - centres[k]) ** 2).sum() for k in centres)
    want = (b / (len(centres) - 1)) / (w / (len(x) - len(centres)))
    assert cluster_metrics.calinski_harabasz(df).first()[0] == pytest.approx(want)
    one = df.withColumn("prediction", F.lit(0))
    assert cluster_metrics.silhouette(one).first()[0] is None
    assert cluster_metrics.davies_bouldin(one).first()[0] is None
    assert cluster_metrics.calinski_harabasz(one).first()[0] is None
    assert cluster_metrics.silhouette_squared(one) is None


@pytest.mark.parametrize("per_range", [3, 1000])
def test_auc_by_pairs(spark, per_range):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 12) / 10, rng.choice("xy")) for _ in range(200)]
    df = spark.createDataFrame(rows, "label int, score double, m string")

    def auc(sub):
        pairs = [(p > q) + 0.5 * (p == q) for (a, p, _), (b, q, _) in itertools.product(sub, sub) if a == 1 and b == 0]
        return sum(pairs) / len(pairs)

    assert metrics.roc_auc(df, scores_per_range=per_range).first()[0] == pytest.approx(auc(rows))
    got = {r["m"]: r["roc_auc"] for r in metrics.roc_auc(df, by=["m"], scores_per_range=per_range).collect()}
    assert got == pytest.approx({m: auc([r for r in rows if r[2] == m]) for m in "xy"})
    assert metrics.roc_auc(df.filter("label = 1")).first()[0] is None


def test_class_metrics_at_the_edges(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 0)], "label int, prediction int")
    assert metrics.precision_recall_f1(df, positive=1).first() == (0.0, 0.0, 0.0)
    weighted = metrics.precision_recall_f1(df).first()
    assert weighted["precision"] == pytest.approx(2 / 3 * 2 / 3) and weighted["recall"] == pytest.approx(2 / 3)
    assert metrics.accuracy(df).first()[0] == pytest.approx(2 / 3)


def test_leaderboard_order(spark):
    rows = [("c", None, None), ("b", 0.5, None), ("a", 0.5, None), ("d", None, 0.9), ("e", float("-inf"), None)]
    df = spark.createDataFrame(rows, "model_name string, rank_score double, score double")
    assert [r["model_name"] for r in metrics.leaderboard(df).collect()] == ["d", "a", "b", "c", "e"]
    scores = spark.createDataFrame([(0.0, 0.4), (0.7, 0.4), (None, 0.0)], "roc_auc double, f1 double")
    assert [r[0] for r in scores.select(metrics.rank_score("classification")).collect()] == [0.4, 0.7, float("-inf")]


def training(spark, x, y, classes=None):
    rows = [(i, Vectors.dense(r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return Training(spark.createDataFrame(rows, ["row_id", "features", "label"]), len(rows), classes)


def test_ridge_equals_the_closed_form(spark):
    x = points(80, 3) * [1, 5, 0.2] + 1
    y = x @ [2.0, -1.0, 4.0] + points(80, 1, 9)[:, 0]
    for alpha in (0.1, 10.0):
        model = fit_model("regression", "ridge_regression", {"alpha": alpha}, training(spark, x, y))
        xc, yc = x - x.mean(0), y - y.mean()
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        assert model.coefficients.toArray() == pytest.approx(want, abs=1e-9)
        assert model.intercept == pytest.approx(y.mean() - x.mean(0) @ want)


def test_elastic_net_meets_its_conditions(spark):
    x = points(120, 4)
    y = 3 * x[:, 0] - 0.5 * x[:, 1] + 0.1 * points(120, 1, 4)[:, 0]
    alpha, ratio = 0.05, 0.15
    t = training(spark, x, y)
    w = fit_model("regression", "sgd_regressor", {"alpha": alpha}, t)
    c = w.coefficients.toArray()
    slope = x.T @ (x @ c + w.intercept - y) / len(y) + alpha * (1 - ratio) * c
    for g, v in zip(slope, c):
        assert abs(g + alpha * ratio * np.sign(v)) < 1e-3 if v else abs(g) <= alpha * ratio + 1e-3


def test_logistic_gradient_is_zero(spark):
    x = points(100, 3)
    y = (x[:, 0] + 0.5 * points(100, 1, 8)[:, 0] > 0).astype(float)
    m = fit_model("classification", "logistic_regression", {"C": 0.5}, training(spark, x, y, [0, 1]))
    w = m.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + m.intercept)))
    assert np.abs(w + 0.5 * x.T @ (p - y)).max() < 1e-3


def test_settings_and_grids(spark):
    assert settings("regression", "ridge_regression", {"alpha": 3, "junk": 1}) == {"alpha": 3}
    with pytest.raises(ValueError):
        settings("regression", "kmeans")
    grid = {"b": [1, 2, 3], "a": [4, 5]}
    assert combinations(grid, 6)[0] == {"a": 4, "b": 1} and len(combinations(grid, 4)) == 4
    assert combinations(grid, 4) == combinations(grid, 4)
    for task, names in MODELS.items():
        for name in names:
            settings(task, name)
    t = training(spark, points(10, 2), [0, 1] * 5, [0, 1, 2])
    assert type(build_estimator("linear_svc", settings("classification", "linear_svc"), t)).__name__ == "OneVsRest"


def test_choose_models():
    assert choose_models("regression", ["Ridge", "linear_regression"]) == ["ridge_regression", "random_forest_regressor"]
    assert choose_models("clustering", []) == ["kmeans", "agglomerative_clustering"]
    assert choose_models("classification", ["KNeighborsClassifier", "ridge", "linear_svc"]) == ["k_neighbors_classifier", "linear_svc"]
    with pytest.raises(ValueError):
        RunConfig("regression", "y").check(["x"])
