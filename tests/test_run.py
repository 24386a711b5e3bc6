import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablewright.operators.features import FeatureSpec
from tablewright.plans.config import RunConfig
from tablewright.plans.fitting import load_fitted, prepare
from tablewright.plans.job import run_job
from tablewright.plans.tuning import tune


def test_registered_queries_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["profile_columns", "clean_chain", "split_stratified"])
def test_queries_equal_their_sql(spark, small, name):
    from check_oracles import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = entry.queries()[name](spark, small)
    result = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert repr(rows_of(df.columns, df.collect())) == repr(rows_of(names, result.fetchall()))


def test_registered_fits_are_whole(monkeypatch):
    """Registered fits run with the default models on the table of their task, searches with the full grids."""
    from tablewright.catalog import modelling
    from tablewright.operators.estimators import DEFAULTS, MODELS, settings

    fits, searches = [], []

    class Found:
        metrics = None

        def frame(self, *_):
            return None

    def fit(bench, name, params=None):
        fits.append((bench, name, settings(bench, name, params)))
        return Found()

    def search(bench, models, n_iter=4, spaces=None, full=True, parallelism=2):
        searches.append((bench, n_iter, spaces, full))
        return Found()

    monkeypatch.setattr(modelling, "_bench", lambda spark, d, task: task)
    monkeypatch.setattr(modelling, "_metrics", lambda *_: None)
    monkeypatch.setattr(modelling, "fit_and_measure", fit)
    monkeypatch.setattr(modelling, "tune", search)
    for task, names in MODELS.items():
        for name in names:
            entry.queries()[f"train_{name}"](None, "")
            assert fits[-1][:2] == (task, name)
            assert name == "dbscan" or fits[-1][2] == DEFAULTS[name]
        entry.queries()[f"tune_{task}"](None, "")
        assert searches[-1] == (task, 4, None, True)
    config = modelling.run_config()
    assert config.full_spaces and config.n_iter == 4 and config.spaces is None


def table(spark, n=120):
    # Three classes that one column tells apart, with gaps and a repeated row.
    df = spark.range(n).select(
        F.concat(F.lit("row"), F.col("id")).alias("row_code"),
        F.when(F.col("id") % 17 != 0, (F.col("id") % 3) * 2.0 + F.sin("id") / 4).alias("x"),
        F.element_at(F.array(F.lit("u"), F.lit("v")), (F.col("id") % 2 + 1).cast("int")).alias("c"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("z")), (F.col("id") % 3 + 1).cast("int")).alias("y"),
    )
    return df.unionAll(df.limit(1))


def test_classification_run(spark, tmp_path):
    config = RunConfig(
        "classification",
        "y",
        root=str(tmp_path),
        features=[FeatureSpec("no_x", "is_missing", ["x"])],
        models=["random_forest_classifier", "linear_svc", "k_neighbors_classifier"],
        spaces={
            "random_forest_classifier": {"n_estimators": [5], "max_depth": [4]},
            "linear_svc": {"C": [1.0]},
            "k_neighbors_classifier": {"n_neighbors": [3]},
        },
        n_iter=1,
    )
    first = run_job(spark, table(spark), config)
    board = {r["model_name"]: r for r in first.leaderboard.collect()}
    assert len(board) == 3 and board["random_forest_classifier"]["accuracy"] > 0.8
    assert all(r["roc_auc"] is None and r["error"] is None for r in board.values())
    assert first.status == "empty" and first.improved
    facts = {(r["section"], r["key"]): r["value"] for r in first.summary.collect()}
    assert facts["cleaning", "rows_before"] == "121" and facts["cleaning", "rows_after"] == "120"
    assert facts["splits", "test"] == "24" and facts["features", "created"] == "no_x"
    raw = table(spark).withColumn("no_x", F.lit(0))
    for name in ("random_forest_classifier", "k_neighbors_classifier"):
        scored = load_fitted(spark, f"{first.folder}/models/{name}").predict(raw)
        assert scored.count() == 121
        assert scored.filter("predicted_label = y").count() > 90


def test_clustering_run(spark, tmp_path):
    config = RunConfig(
        "clustering",
        root=str(tmp_path),
        models=["kmeans", "dbscan"],
        spaces={"kmeans": {"n_clusters": [3], "n_init": [2]}, "dbscan": {"eps": [0.5], "min_samples": [3]}},
        n_iter=1,
    )
    found = run_job(spark, table(spark).drop("y"), config)
    rows = found.leaderboard.collect()
    assert {r["model_name"] for r in rows} == {"kmeans", "dbscan"} and all(r["silhouette"] is not None for r in rows)


def test_a_failing_trial_ranks_last(spark):
    df = table(spark).drop("row_code", "c")
    bench = prepare("classification", df, df, "y")
    found = tune(bench, ["logistic_regression", "gradient_boosting_classifier"], 1, {"logistic_regression": {"C": [-1.0]}, "gradient_boosting_classifier": {"n_estimators": [2]}})
    assert [t["model_name"] for t in found.trials] == ["gradient_boosting_classifier", "logistic_regression"]
    assert found.trials[1]["error"] and found.best_params["logistic_regression"] == {}


def test_empty_validation_ranks_last(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(30)], "x double, y double")
    bench = prepare("regression", df, df.limit(0), "y")
    found = tune(bench, ["ridge_regression"], 1).trials[0]
    assert "error" not in found and found["rank_score"] == float("-inf")


def test_silhouettes_have_names_of_their_own(spark):
    from tablewright.plans.fitting import measure
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([float(i % 2 * 9), i / 10]), i % 2) for i in range(20)], ["features", "prediction"])
    exact, squared = (measure("clustering", df, None, kind) for kind in ("exact", "squared"))
    assert exact["silhouette"] == exact["rank_score"] and exact["silhouette_squared"] is None
    assert squared["silhouette_squared"] == squared["rank_score"] and squared["silhouette"] is None
