"""The model families, their settings in Spark terms, and fitting on feature tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    OneVsRest,
    OneVsRestModel,
)
from pyspark.ml.clustering import BisectingKMeans, KMeans, KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.mllib.common import _py2java as _py2java_old
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import boosting
from .density import dbscan
from .forest import ForestModel, fit_forest
from .gram import NormalEquations
from .hinge import fit_squared_hinge
from .kmeans import lloyd
from .neighbors import knn_join, mean

SEED = 42

# Supported model names per task.
MODELS = {
    "classification": [
        "logistic_regression",
        "random_forest_classifier",
        "gradient_boosting_classifier",
        "linear_svc",
        "k_neighbors_classifier",
    ],
    "regression": [
        "ridge_regression",
        "sgd_regressor",
        "random_forest_regressor",
        "gradient_boosting_regressor",
        "k_neighbors_regressor",
    ],
    "clustering": ["kmeans", "agglomerative_clustering", "dbscan"],
}

# Search grids, the default.
FULL_SPACES = {
    "ridge_regression": {"alpha": [0.1, 1.0, 10.0, 100.0]},
    "sgd_regressor": {"alpha": [0.0001, 0.001]},
    "random_forest_regressor": {"n_estimators": [100, 200], "max_depth": [None, 10, 20]},
    "gradient_boosting_regressor": {"n_estimators": [100, 200], "learning_rate": [0.05, 0.1]},
    "k_neighbors_regressor": {"n_neighbors": [5, 9, 11, 15]},
    "logistic_regression": {"C": [0.1, 1.0, 3.0]},
    "random_forest_classifier": {"n_estimators": [100, 200], "max_depth": [None, 10, 20]},
    "gradient_boosting_classifier": {"n_estimators": [100, 200], "learning_rate": [0.05, 0.1]},
    "linear_svc": {"C": [0.1, 1.0, 3.0]},
    "k_neighbors_classifier": {"n_neighbors": [5, 9, 11, 15]},
    "kmeans": {"n_clusters": [2, 3, 4, 5]},
    "agglomerative_clustering": {"n_clusters": [2, 3, 4, 5]},
    "dbscan": {"eps": [0.5, 0.7, 1.0], "min_samples": [5, 10]},
}

# An explicit choice for a quick look: the same grids, with smaller ensembles.
_FOREST = {"n_estimators": [20, 50], "max_depth": [5, 10]}
_BOOSTING = {"n_estimators": [20, 50], "learning_rate": [0.05, 0.1]}
LIGHT_SPACES = {
    **FULL_SPACES,
    "random_forest_regressor": _FOREST,
    "random_forest_classifier": _FOREST,
    "gradient_boosting_regressor": _BOOSTING,
    "gradient_boosting_classifier": _BOOSTING,
}

# Settings when nothing is searched.
DEFAULTS = {
    "logistic_regression": {"C": 1.0, "max_iter": 2000},
    "random_forest_classifier": {"n_estimators": 400, "max_depth": None},
    "gradient_boosting_classifier": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
    "linear_svc": {"C": 1.0, "max_iter": 1000},
    "k_neighbors_classifier": {"n_neighbors": 11},
    "ridge_regression": {"alpha": 1.0},
    "sgd_regressor": {"alpha": 0.0001, "l1_ratio": 0.15, "max_iter": 2000},
    "random_forest_regressor": {"n_estimators": 400, "max_depth": None},
    "gradient_boosting_regressor": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
    "k_neighbors_regressor": {"n_neighbors": 11},
    "kmeans": {"n_clusters": 3, "n_init": 20},
    "agglomerative_clustering": {"n_clusters": 3},
    "dbscan": {"eps": 0.7, "min_samples": 10},
}

NORMAL_EQUATION_FEATURES = 1024  # of wider tables the products are not brought together


def settings(task_type: str, model_name: str, params: Mapping | None = None) -> dict:
    """Defaults overridden by ``params``; unknown parameters are ignored."""
    if model_name not in MODELS.get(task_type, ()):
        raise ValueError(f"unknown model for {task_type}: {model_name}")
    known = DEFAULTS[model_name]
    return {**known, **{k: v for k, v in (params or {}).items() if k in known}}


@dataclass
class Training:
    """A feature table (``row_id``, ``features``, ``label``) with what fits need to know of it."""

    data: DataFrame
    rows: int
    classes: Sequence | None = None

    def label_spread(self) -> tuple[float, float]:
        row = self.data.agg(F.stddev_pop("label").alias("p"), F.stddev_samp("label").alias("s")).first()
        return row["p"] or 0.0, row["s"] or 0.0

    @cached_property
    def width(self) -> int:
        return int(self.data.select(F.size(vector_to_array("features")).alias("d")).first()["d"])

    @cached_property
    def equations(self) -> NormalEquations:
        """One scan, for all penalties of a search."""
        return NormalEquations(self.data, self.width)


def build_estimator(model_name: str, s: Mapping, training: Training):
    """The MLlib estimator of a model name, penalties rescaled to MLlib's objective."""
    n, many = training.rows, training.classes is not None and len(training.classes) > 2
    if model_name == "logistic_regression":
        return LogisticRegression(regParam=1 / (s["C"] * n), standardization=False, maxIter=s["max_iter"])
    if model_name == "gradient_boosting_classifier":
        gbt = GBTClassifier(maxIter=s["n_estimators"], stepSize=s["learning_rate"], maxDepth=s["max_depth"], seed=SEED)
        return OneVsRest(classifier=gbt) if many else gbt
    if model_name == "linear_svc":
        # With the plain hinge; fits take the squared one (``fit_hinge``).
        svc = LinearSVC(regParam=1 / (s["C"] * n), standardization=False, maxIter=s["max_iter"])
        return OneVsRest(classifier=svc) if many else svc
    if model_name == "ridge_regression":
        # Too wide for normal equations. MLlib divides the loss by n and works on the label scaled by its sample deviation.
        _, sample = training.label_spread()
        return LinearRegression(solver="l-bfgs", elasticNetParam=0.0, standardization=False, regParam=s["alpha"] * sample / n)
    if model_name == "sgd_regressor":
        _, sample = training.label_spread()
        l1, l2 = s["alpha"] * s["l1_ratio"], s["alpha"] * (1 - s["l1_ratio"]) * sample
        return LinearRegression(
            solver="l-bfgs",
            standardization=False,
            maxIter=s["max_iter"],
            regParam=l1 + l2,
            elasticNetParam=l1 / (l1 + l2) if l1 + l2 else 0.0,
        )
    if model_name == "gradient_boosting_regressor":
        # For deep trees and wide tables; others are fitted by ``fit_boosting``.
        return GBTRegressor(maxIter=s["n_estimators"], stepSize=s["learning_rate"], maxDepth=s["max_depth"], seed=SEED)
    if model_name == "agglomerative_clustering":
        return BisectingKMeans(k=s["n_clusters"], seed=SEED)
    raise ValueError(f"no MLlib estimator for {model_name}")


def fit_hinge(s: Mapping, training: Training):
    """Squared hinge, as MLlib models: one for two classes, else one for each class against the rest."""
    many = len(training.classes) > 2
    classes = [float(k) for k in range(len(training.classes))] if many else [1.0]
    found = fit_squared_hinge(training.data, training.width, classes, float(s["C"]), int(s["max_iter"]))
    sc = training.data.sparkSession.sparkContext
    made = [
        LinearSVCModel(sc._jvm.org.apache.spark.ml.classification.LinearSVCModel(f"hinge{k}", _py2java(sc, Vectors.dense(w)), float(b)))
        for k, (w, b) in enumerate(zip(found.weights, found.intercepts))
    ]
    if not many:
        return made[0]
    model = OneVsRestModel(made)
    model.set(model.classifier, LinearSVC())
    return model


def fit_trees(task_type: str, s: Mapping, training: Training) -> ForestModel:
    """A random forest: for classes the root of the number of features is drawn for each split, else all are tried."""
    width = training.width
    classes, most = (len(training.classes), max(int(width**0.5), 1)) if task_type == "classification" else (0, None)
    depth = None if s["max_depth"] is None else int(s["max_depth"])
    return fit_forest(
        training.data, rows=training.rows, width=width, trees=int(s["n_estimators"]), classes=classes, depth=depth, most=most, seed=SEED
    )


def fit_ridge(alpha: float, training: Training) -> LinearRegressionModel:
    """The ridge solution of the normal equations as an MLlib model, which scores, saves and loads like any other."""
    slope, intercept = training.equations.ridge(alpha)
    sc = training.data.sparkSession.sparkContext
    java = sc._jvm.org.apache.spark.ml.regression.LinearRegressionModel("ridge", _py2java(sc, Vectors.dense(slope)), intercept)
    return LinearRegressionModel(java)


def fit_kmeans(s: Mapping, training: Training) -> Model:
    """K-means from several starts of MLlib, which then move together, a scan a round; the one with the lowest cost."""
    data = training.data
    starts = [KMeans(k=s["n_clusters"], seed=SEED + i, maxIter=0).fit(data) for i in range(int(s["n_init"]))]
    centres, _ = lloyd(data, [np.stack(m.clusterCenters()) for m in starts], rounds=300, tol=1e-4)
    sc = data.sparkSession.sparkContext
    plain = sc._jvm.org.apache.spark.mllib.clustering.KMeansModel(_py2java_old(sc, [OldVectors.dense(c) for c in centres]))
    model = KMeansModel(sc._jvm.org.apache.spark.ml.clustering.KMeansModel("kmeans", plain))
    model.set(model.k, s["n_clusters"])
    return model


def fit_boosting(s: Mapping, training: Training) -> GBTRegressionModel:
    """Boosted trees as an MLlib model; leaves keep the counts and means of their rows, not their spread."""
    rounds, step, depth = int(s["n_estimators"]), float(s["learning_rate"]), int(s["max_depth"])
    trees, cuts = boosting.fit_boosted(training.data, rows=training.rows, width=training.width, rounds=rounds, step=step, depth=depth)
    sc = training.data.sparkSession.sparkContext
    ml, doubles = sc._jvm.org.apache.spark.ml, lambda v: sc._gateway.new_array(sc._jvm.double, len(v))
    filled = lambda v: [a := doubles(v), *(a.__setitem__(i, float(x)) for i, x in enumerate(v))][0]

    def java(node: boosting.Node):
        kept = sc._jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(filled([node.count, node.total, node.total * node.mean]), int(node.count))
        if not node.children:
            return ml.tree.LeafNode(node.mean, 0.0, kept)
        split = ml.tree.ContinuousSplit(node.feature, float(cuts[node.feature][node.place]))
        return ml.tree.InternalNode(node.mean, 0.0, node.gain, *map(java, node.children), split, kept)

    made = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    for i, root in enumerate(trees):
        made[i] = ml.regression.DecisionTreeRegressionModel(f"boosted{i}", java(root), training.width)
    weights = filled([1.0, *[step] * (len(trees) - 1)])
    return GBTRegressionModel(ml.regression.GBTRegressionModel("boosted", made, weights, training.width))


@dataclass
class NeighborModel:
    """K nearest neighbours: the training table is the model."""

    points: DataFrame
    k: int
    classes: Sequence | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (and ``score`` for two classes) to a table with ``row_id``."""
        near = knn_join(df, self.points, self.k, "row_id", "row_id", "features", payload=["label"])
        if self.classes is None:
            found = mean(near, "row_id", "label")
        else:
            counts = near.groupBy("row_id", "label").agg(F.count(F.lit(1)).alias("n"))
            best = F.min(F.struct((-F.col("n")).alias("neg"), "label"))
            ones = F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)) / F.sum("n")
            found = counts.groupBy("row_id").agg(best.alias("b"), ones.alias("score")).select(
                "row_id", F.col("b.label").alias("prediction"), *(["score"] if len(self.classes) == 2 else [])
            )
        return df.join(found, "row_id")


@dataclass
class DensityModel:
    """DBSCAN labels its own rows and nothing else."""

    labels: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        return df.join(self.labels, "row_id")


def fit_model(task_type: str, model_name: str, params: Mapping | None, training: Training):
    """Fit one model; the result has ``transform`` over feature tables."""
    s = settings(task_type, model_name, params)
    if model_name.startswith("k_neighbors"):
        return NeighborModel(training.data, int(s["n_neighbors"]), training.classes)
    if model_name == "dbscan":
        labels = dbscan(training.data, float(s["eps"]), int(s["min_samples"]), "row_id", "features")
        return DensityModel(cut_lineage(labels.select("row_id", F.col("cluster").alias("prediction")), "labels"))
    if model_name.startswith("random_forest"):
        return fit_trees(task_type, s, training)
    if model_name == "linear_svc":
        return fit_hinge(s, training)
    if model_name == "ridge_regression" and training.width <= NORMAL_EQUATION_FEATURES:
        return fit_ridge(float(s["alpha"]), training)
    if model_name == "kmeans":
        return fit_kmeans(s, training)
    if model_name == "gradient_boosting_regressor" and boosting.fits(training.width, int(s["max_depth"])):
        return fit_boosting(s, training)
    return build_estimator(model_name, s, training).fit(training.data)


def with_score(predicted: DataFrame, classes: Sequence | None) -> DataFrame:
    """Add ``score``, the probability of class 1, where two classes and a probability exist."""
    if "score" in predicted.columns:
        return predicted
    if classes is not None and len(classes) == 2 and "probability" in predicted.columns:
        return predicted.withColumn("score", vector_to_array("probability")[1])
    return predicted.withColumn("score", F.lit(None).cast("double"))
