"""Model fits, searches, evaluation, scoring and the full run: rows-only checks.

Whole tables go in; every query gives the metrics of a fit, trials or scored rows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators.estimators import MODELS
from ..operators.features import FeatureSpec, derive_features
from ..operators.split import exact_split, parts
from ..plans.config import RunConfig
from ..plans.fitting import METRICS, fit_and_measure, load_fitted, prepare
from ..plans.job import run_job
from ..plans.tuning import evaluate, evaluation_frame, rows_frame, tune
from ..session import cut_lineage, scratch_path
from .common import modeling_table, plain, table

# The radius in which these embeddings have neighbours; all other models run with DEFAULTS, and searches with FULL_SPACES.
PARAMS = {"dbscan": {"eps": 1.15, "min_samples": 5}}
TEXT_SPECS = [
    FeatureSpec("words", "text_word_count", ["text"]),
    FeatureSpec("word_length", "ratio", ["n_chars", "words"]),
    FeatureSpec("source_share", "category_frequency", ["source"]),
]


def labelled_documents(spark, d):
    """Documents with a quality label, and features of their texts."""
    joined = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return derive_features(joined, TEXT_SPECS, "quality")[0]


def price_table(spark, d):
    """The modelling table without keys; the target is the extended price."""
    return modeling_table(spark, d).drop("l_orderkey", "l_partkey", "l_suppkey", "o_custkey")


def vectors(spark, d):
    """Embeddings as a table of 64 numeric columns."""
    df = table(spark, d, "embeddings")
    size = df.select(F.size("embedding").alias("n")).first()["n"]
    return df.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(size)])


def _split(spark, d, task):
    """The split table, written once: many passes read it."""
    if task == "classification":
        df = labelled_documents(spark, d)
        return cut_lineage(exact_split(df, key="doc_id", stratify="quality").drop("text")), "quality"
    if task == "regression":
        return cut_lineage(exact_split(cut_lineage(price_table(spark, d)))), "l_extendedprice"
    return cut_lineage(exact_split(vectors(spark, d), key="vec_id").drop("vec_id")), None


def _bench(spark, d, task):
    split, target = _split(spark, d, task)
    return prepare(task, parts(split, "train"), parts(split, "val"), target)


def _metrics(spark, task, name, found):
    rows = [(name, m, None if found[m] is None else float(found[m])) for m in [*METRICS[task], "rank_score"]]
    return spark.createDataFrame(rows, "model_name string, metric string, value double")


def train_model(spark, d, task, name):
    model = fit_and_measure(_bench(spark, d, task), name, PARAMS.get(name))
    return _metrics(spark, task, name, model.metrics)


def tune_classification(spark, d):
    bench = _bench(spark, d, "classification")
    found = tune(bench, ["logistic_regression", "random_forest_classifier"])
    return found.frame(spark, "classification")


def tune_regression(spark, d):
    found = tune(_bench(spark, d, "regression"), ["ridge_regression", "sgd_regressor"])
    return found.frame(spark, "regression")


def tune_clustering(spark, d):
    found = tune(_bench(spark, d, "clustering"), ["kmeans", "agglomerative_clustering"])
    return found.frame(spark, "clustering")


def evaluate_best(spark, d):
    split, target = _split(spark, d, "regression")
    leader = {"model_name": "ridge_regression", "params": {"alpha": 1.0}}
    model = evaluate("regression", leader, parts(split, "train", "val"), parts(split, "test"), target)
    return evaluation_frame(spark, model, {})


def batch_score(spark, d):
    """Fit, save, load, and score every row of the price table."""
    fitted = fit_and_measure(_bench(spark, d, "regression"), "ridge_regression")
    loaded = load_fitted(spark, fitted.save(scratch_path(spark, "model")))
    return plain(loaded.predict(price_table(spark, d)).select("l_quantity", "l_extendedprice", "prediction"), 2)


def run_config(**kw) -> RunConfig:
    base = dict(
        task_type="classification",
        target="quality",
        task_text="find good documents",
        dataset="documents with labels",
        features=TEXT_SPECS,
        models=["logistic_regression", "random_forest_classifier"],
        key="doc_id",
    )
    return RunConfig(**{**base, **kw})


def _documents(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


def full_run(spark, d, root=None):
    """The whole job; its leaderboard."""
    config = run_config(root=root or scratch_path(spark, "run"))
    return run_job(spark, _documents(spark, d), config).leaderboard.drop("model_path")


def run_summary(spark, d):
    """The whole job; its summary lines."""
    config = run_config(root=scratch_path(spark, "run"))
    return run_job(spark, _documents(spark, d), config).summary.groupBy("section").agg(F.count(F.lit(1)).alias("lines"))


def trial_table(spark, d):
    """One fit per linear model, as leaderboard rows."""
    bench = _bench(spark, d, "regression")
    rows = []
    for name in ("ridge_regression", "sgd_regressor"):
        found = fit_and_measure(bench, name).metrics
        rows.append({"model_name": name, "metrics": found, "rank_score": found["rank_score"]})
    return rows_frame(spark, "regression", rows)


QUERIES = {f"train_{name}": partial(train_model, task=task, name=name) for task, names in MODELS.items() for name in names}
QUERIES |= {
    "tune_classification": tune_classification,
    "tune_regression": tune_regression,
    "tune_clustering": tune_clustering,
    "evaluate_best": evaluate_best,
    "batch_score": batch_score,
    "full_run": full_run,
    "run_summary": run_summary,
    "trial_table": trial_table,
}

ORACLE: dict[str, str] = {}
