"""Hyperparameter search, final training and hold-out evaluation."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.estimators import FULL_SPACES, LIGHT_SPACES, SEED
from .fitting import METRICS, FittedModel, Workbench, fit_and_measure, measure, prepare

MOST_TRIALS = 8


def combinations(space: Mapping[str, Sequence], n_iter: int) -> list[dict]:
    """Grid points in sorted key order; of too many, a repeatable sample."""
    names = sorted(space)
    grid = [dict(zip(names, point)) for point in itertools.product(*(space[n] for n in names))]
    return grid if len(grid) <= n_iter else random.Random(SEED).sample(grid, n_iter)


@dataclass
class Tuning:
    trials: list[dict]
    best_params: dict[str, dict]

    def frame(self, spark: SparkSession, task_type: str) -> DataFrame:
        return rows_frame(spark, task_type, self.trials)


def rows_frame(spark: SparkSession, task_type: str, rows: Sequence[Mapping]) -> DataFrame:
    """Trials or leaderboard rows as a table; one column per metric of the task."""
    names = METRICS[task_type]
    schema = "model_name string, params string, {}, rank_score double, error string, model_path string".format(
        ", ".join(f"{m} double" for m in names)
    )
    data = [
        (
            r["model_name"],
            json.dumps(r.get("params") or {}, sort_keys=True),
            *[None if r.get("metrics", {}).get(m) is None else float(r["metrics"][m]) for m in names],
            float(r["rank_score"]),
            r.get("error"),
            r.get("model_path"),
        )
        for r in rows
    ]
    return spark.createDataFrame(data, schema)


def _by_rank(rows: Sequence[dict]) -> list[dict]:
    """Best first, ties by name, as in the stored leaderboard."""
    return sorted(rows, key=lambda r: (-r["rank_score"], r["model_name"]))


def tune(
    bench: Workbench,
    models: Sequence[str],
    n_iter: int = 4,
    spaces: Mapping[str, Mapping] | None = None,
    full: bool = True,
    parallelism: int = 2,
) -> Tuning:
    """Try up to ``n_iter`` (1 to 8) settings per model; a failing trial ranks last.

    Trials share the prepared feature tables and run a few at a time, each a Spark fit.
    """
    n_iter = min(max(int(n_iter), 1), MOST_TRIALS)
    defaults = FULL_SPACES if full else LIGHT_SPACES
    jobs = []
    for name in models:
        space = (spaces or {}).get(name) or defaults.get(name, {})
        jobs += [(name, params) for params in (combinations(space, n_iter) if space else [{}])]

    @inheritable_thread_target(bench.training.data.sparkSession)
    def trial(job: tuple[str, dict]) -> dict:
        name, params = job
        try:
            found = fit_and_measure(bench, name, params).metrics
            return {"model_name": name, "params": params, "metrics": found, "rank_score": found["rank_score"]}
        except Exception as error:  # noqa: BLE001 - the trial's failure is its result
            return {"model_name": name, "params": params, "error": str(error), "rank_score": float("-inf")}

    pool = ThreadPool(max(1, min(parallelism, len(jobs))))
    try:
        trials = pool.map(trial, jobs, chunksize=1)
    finally:
        pool.close()
    best = {}
    for name in models:
        top = _by_rank([t for t in trials if t["model_name"] == name])[0]
        best[name] = top["params"] if top["rank_score"] > float("-inf") else {}
    return Tuning(_by_rank(trials), best)


def train(
    bench: Workbench, models: Sequence[str], best_params: Mapping[str, Mapping], path: str | None = None
) -> tuple[list[dict], dict[str, FittedModel]]:
    """Fit each model with its best settings, save it, and rank on the scored part."""
    rows, fitted = [], {}
    for name in models:
        model = fit_and_measure(bench, name, best_params.get(name, {}))
        saved = model.save(f"{path}/{name}") if path else None
        fitted[name] = model
        rows.append(
            {
                "model_name": name,
                "params": model.params,
                "metrics": model.metrics,
                "rank_score": model.metrics["rank_score"],
                "model_path": saved,
            }
        )
    return _by_rank(rows), fitted


def evaluate(
    task_type: str,
    leader: Mapping,
    train_val: DataFrame,
    test: DataFrame,
    target: str | None,
    roles: Mapping[str, str] | None = None,
    silhouette: str = "exact",
    quantile_method: str = "exact",
) -> FittedModel:
    """Refit the leader on train and validation together and measure it on test.

    A clustering is measured on the rows it was fitted on; where the model can place
    new rows, the metrics of test under its clusters are added as ``test_...``.
    """
    bench = prepare(task_type, train_val, test, target, roles, silhouette, quantile_method)
    model = fit_and_measure(bench, leader["model_name"], leader.get("params"))
    if task_type == "clustering" and leader["model_name"] != "dbscan":
        features = bench.prep.model.transform(test)
        placed = model.core.transform(features.select("features"))
        found = measure(task_type, placed, None, silhouette)
        model.metrics |= {f"test_{k}": v for k, v in found.items() if k != "rank_score"}
    return model


def evaluation_frame(spark: SparkSession, model: FittedModel, validation: Mapping) -> DataFrame:
    """``(part, metric, value)`` of the leader on test and on validation."""
    rows = [("test", m, model.metrics[m]) for m in model.metrics if m != "rank_score"]
    rows += [("validation", m, v) for m, v in validation.items() if m != "rank_score"]
    rows.append(("test", "rank_score", model.metrics["rank_score"]))
    data = [(part, m, None if v is None else float(v)) for part, m, v in rows]
    return spark.createDataFrame(data, "part string, metric string, value double").withColumn(
        "model_name", F.lit(model.model_name)
    )
