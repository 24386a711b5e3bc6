"""Fitting, predicting, measuring: one model on prepared tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import as_double
from ..operators import cluster_metrics, metrics
from ..operators.estimators import DensityModel, NeighborModel, Training, fit_model, with_score
from ..operators.forest import ForestModel, load_forest, save_forest
from ..operators.prep import Preprocessor, encode_labels, fit_preprocessor, label_classes
from ..sources.artifacts import load_model, read_artifact, save_model, write_artifact
from ..session import cut_lineage

METRICS = {
    "classification": ["accuracy", "precision", "recall", "f1", "roc_auc"],
    "regression": ["rmse", "mae"],
    "clustering": ["silhouette", "silhouette_squared", "davies_bouldin", "calinski_harabasz"],
}
# The two kinds of silhouette are different numbers with names of their own: by distances, which is quadratic in
# rows, or by squared distances, which is linear. A run has the one that it asks for.
SILHOUETTES = {"exact": "silhouette", "squared": "silhouette_squared"}
META = "task_type string, model_name string, params string, target string, classes string, class_type string, kind string"


@dataclass
class Workbench:
    """Feature tables of a training part and a scored part, prepared once for many fits."""

    task_type: str
    target: str | None
    prep: Preprocessor
    training: Training
    scored: DataFrame | None
    silhouette: str = "exact"

    def fit(self, model_name: str, params: Mapping | None = None):
        return fit_model(self.task_type, model_name, params, self.training)

    def measure(self, model) -> dict:
        """Metrics on the scored part, or on the training part for clustering."""
        table = self.training.data if self.task_type == "clustering" else self.scored
        predicted = with_score(model.transform(table), self.training.classes)
        return measure(self.task_type, predicted, self.training.classes, self.silhouette)


def feature_table(
    df: DataFrame, prep: Preprocessor, task_type: str, target: str | None, classes: Sequence | None
) -> DataFrame:
    """``(row_id, features, label)``, written once: row ids must not change between passes."""
    # The label gets a name of its own first: the table may have a feature called "label".
    if task_type == "classification":
        df = encode_labels(df, target, classes, "__label")
    elif task_type == "regression":
        df = df.withColumn("__label", as_double(df, target))
    out = prep.model.transform(df).withColumn("__id", F.monotonically_increasing_id())
    label = [F.col("__label").alias("label")] if task_type != "clustering" else []
    return cut_lineage(out.select(F.col("__id").alias("row_id"), "features", *label), "features")


def prepare(
    task_type: str,
    train: DataFrame,
    scored: DataFrame | None,
    target: str | None,
    roles: Mapping[str, str] | None = None,
    silhouette: str = "exact",
    quantile_method: str = "exact",
) -> Workbench:
    """Fit preprocessing and label codes on ``train`` and apply them to both parts."""
    prep = fit_preprocessor(train, target, roles, quantile_method)
    classes = label_classes(train, target) if task_type == "classification" else None
    data = feature_table(train, prep, task_type, target, classes)
    other = None if scored is None or task_type == "clustering" else feature_table(scored, prep, task_type, target, classes)
    return Workbench(task_type, target, prep, Training(data, data.count(), classes), other, silhouette)


def _first(df: DataFrame) -> dict:
    row = df.first()
    return row.asDict() if row else {}


def measure(task_type: str, predicted: DataFrame, classes: Sequence | None, silhouette: str = "exact") -> dict:
    """All metrics of a table of predictions, with ``rank_score``."""
    if task_type == "classification":
        positive = 1.0 if len(classes) == 2 else None
        predicted = cut_lineage(predicted.select("label", "prediction", "score"), "predicted")
        found = _first(metrics.accuracy(predicted)) | _first(
            metrics.precision_recall_f1(predicted, positive=positive)
        )
        found["roc_auc"] = None
        if len(classes) == 2 and predicted.filter(F.col("score").isNotNull()).limit(1).count():
            found["roc_auc"] = _first(metrics.roc_auc(predicted)).get("roc_auc")
    elif task_type == "regression":
        found = _first(metrics.regression_errors(predicted))
    else:
        predicted = cut_lineage(predicted.select("features", "prediction"), "predicted")
        if predicted.select("prediction").distinct().limit(2).count() < 2:
            found = dict.fromkeys(METRICS["clustering"])
        else:
            found = dict.fromkeys(SILHOUETTES.values())
            if silhouette == "exact":
                found |= _first(cluster_metrics.silhouette(predicted))
            else:
                found["silhouette_squared"] = cluster_metrics.silhouette_squared(predicted)
            found |= _first(cluster_metrics.davies_bouldin(predicted))
            found |= _first(cluster_metrics.calinski_harabasz(predicted))
    names = METRICS[task_type]
    row = SparkSession.active().createDataFrame(
        [tuple(None if found[m] is None else float(found[m]) for m in names)], ", ".join(f"{m} double" for m in names)
    )
    return found | _first(row.select(metrics.rank_score(task_type).alias("rank_score")))


@dataclass
class FittedModel:
    """A fitted model with its preprocessing: raw rows in, predictions out."""

    task_type: str
    model_name: str
    params: dict
    target: str | None
    prep: Preprocessor
    core: object
    classes: Sequence | None = None
    metrics: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` and, for classes, ``predicted_label`` and ``score``.

        Batch scoring: one pass, except for neighbour models and forests, which number and write the
        rows first.
        """
        if isinstance(self.core, DensityModel):
            raise ValueError("a density clustering has no predictions for new rows")
        # The row travels whole, so that its columns meet none of the model's.
        features = self.prep.model.transform(df.withColumn("__row", F.struct("*"))).select("__row", "features")
        if isinstance(self.core, (NeighborModel, ForestModel)):
            features = cut_lineage(features.withColumn("row_id", F.monotonically_increasing_id()), "scoring")
        out = with_score(self.core.transform(features), self.classes)
        keep = [F.col("prediction").cast("double").alias("prediction")]
        if self.classes is not None:
            names = F.array(*[F.lit(c) for c in self.classes])
            keep += [F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted_label"), F.col("score")]
        return out.select("__row.*", *keep)

    def save(self, path: str) -> str:
        spark = SparkSession.active()
        kind = {NeighborModel: "neighbors", DensityModel: "density", ForestModel: "forest"}.get(type(self.core), "mllib")
        stages = list(self.prep.stages) + ([self.core] if kind == "mllib" else [])
        save_model(PipelineModel(stages=stages), f"{path}/stages")
        if kind == "neighbors":
            self.core.points.write.mode("overwrite").parquet(f"{path}/points")
        if kind == "forest":
            save_forest(self.core, f"{path}/forest")
        if kind == "density":
            self.core.labels.write.mode("overwrite").parquet(f"{path}/labels")
        plain = None if self.classes is None else json.dumps([_plain(c) for c in self.classes])
        class_type = type(self.classes[0]).__name__ if self.classes else None
        meta = [(self.task_type, self.model_name, json.dumps(self.params), self.target, plain, class_type, kind)]
        write_artifact(spark.createDataFrame(meta, META).coalesce(1), f"{path}/meta")
        return path


def _plain(value):
    return value.isoformat() if isinstance(value, (date, datetime)) else value


def load_fitted(spark: SparkSession, path: str) -> FittedModel:
    meta = read_artifact(spark, f"{path}/meta", META).first()
    stages = list(load_model(f"{path}/stages").stages)
    again = {"date": date.fromisoformat, "datetime": datetime.fromisoformat}.get(meta["class_type"], lambda c: c)
    classes = None if meta["classes"] is None else [again(c) for c in json.loads(meta["classes"])]
    params = json.loads(meta["params"])
    if meta["kind"] == "neighbors":
        core = NeighborModel(spark.read.parquet(f"{path}/points"), int(params.get("n_neighbors", 11)), classes)
    elif meta["kind"] == "forest":
        core = load_forest(spark, f"{path}/forest")
    elif meta["kind"] == "density":
        core = DensityModel(spark.read.parquet(f"{path}/labels"))
    else:
        core = stages.pop()
    return FittedModel(
        meta["task_type"], meta["model_name"], params, meta["target"], Preprocessor([], [], stages), core, classes
    )


def fit_and_measure(bench: Workbench, model_name: str, params: Mapping | None = None) -> FittedModel:
    core = bench.fit(model_name, params)
    return FittedModel(
        bench.task_type,
        model_name,
        dict(params or {}),
        bench.target,
        bench.prep,
        core,
        bench.training.classes,
        bench.measure(core),
    )
