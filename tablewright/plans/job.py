"""The whole run: profile, clean, explore, derive, split, tune, train, evaluate, register, sum up."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import eda, profile
from ..operators.clean import clean
from ..operators.distributions import distribution_report
from ..operators.features import derive_features, feature_report
from ..operators.metrics import leaderboard
from ..operators.split import exact_split, parts, split_manifest
from ..session import shared_dir
from ..sources.artifacts import read_artifact, write_artifact
from ..sources.tables import write_splits, write_stage
from . import registry
from .config import RunConfig, choose_models
from .fitting import SILHOUETTES, FittedModel, load_fitted, prepare
from .tuning import evaluate, evaluation_frame, rows_frame, train, tune

SUMMARY = "run_id string, section string, key string, value string"
TUNING_LINES = 12  # best trials in the summary


@dataclass
class RunResult:
    run_id: str
    folder: str
    leaderboard: DataFrame
    evaluation: DataFrame
    summary: DataFrame
    status: str
    improved: bool


def _lines(df: DataFrame, run_id: str, section: str, key: str, value: str) -> DataFrame:
    return df.select(
        F.lit(run_id).alias("run_id"),
        F.lit(section).alias("section"),
        F.col(key).cast("string").alias("key"),
        F.col(value).cast("string").alias("value"),
    )


def load_best(spark: SparkSession, root: str, task_type: str, target: str | None) -> FittedModel | None:
    """The best registered model of a task and target, or None. For a clustering the target is the kind of silhouette."""
    same = F.col("task_type").eqNullSafe(task_type) & F.col("target").eqNullSafe(F.lit(target))
    best = registry.best_runs(registry.read_registry(spark, f"{root.rstrip('/')}/registry")).filter(same).first()
    return None if best is None or best["model_path"] is None else load_fitted(spark, best["model_path"])


def run_job(spark: SparkSession, df: DataFrame, config: RunConfig) -> RunResult:
    """Run all steps on one table. Stage tables and results go below ``config.root``.

    Every stage is written as Parquet and read back, so that later steps start from
    files, types stay fixed, and a lost executor costs one stage at most. ``root`` must
    be reachable from all executors; by default it is the session's checkpoint folder.
    """
    config.check(df.columns)
    target = None if config.task_type == "clustering" else config.target
    run_id = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:6]
    root = (config.root or shared_dir(spark)).rstrip("/")
    folder, book = f"{root}/runs/{run_id}", f"{root}/registry"
    models = choose_models(config.task_type, config.models)

    def keep(table: DataFrame, name: str) -> DataFrame:
        write_artifact(table, f"{folder}/{name}")
        return read_artifact(spark, f"{folder}/{name}", table.schema)

    # The input first, so that no later pass runs its source again.
    df = write_stage(df, f"{folder}/data/input")

    # Analyse and clean.
    keep(profile.column_profile(df), "analysis/profile")
    keep(profile.candidate_targets(df), "analysis/candidate_targets")
    shape = keep(profile.shape(df), "analysis/shape").first()
    cleaned = clean(df, config.clean, target)
    table = write_stage(cleaned.data, f"{folder}/data/cleaned")
    report = keep(cleaned.report, "analysis/cleaning").first()

    # Explore.
    keep(distribution_report(table), "analysis/distributions")
    findings = keep(eda.eda_report(table, target, config.task_type, config.clean.quantile_method), "analysis/eda")

    # Derive features.
    created: list[str] = []
    if config.features:
        featured, created = derive_features(table, config.features, target)
        table = write_stage(featured, f"{folder}/data/featured")
    keep(feature_report(table, created), "analysis/features")
    snapshot = keep(profile.schema_snapshot(table, target), "analysis/schema").first()

    # Split.
    stratify = target if config.task_type == "classification" and config.stratify else None
    split = exact_split(table, config.test_size, config.val_size, config.key, stratify, config.seed)
    split = write_splits(split, f"{folder}/data/splits")
    manifest = keep(split_manifest(split), "modeling/splits")

    # Tune and train; roles are fitted on the training part once.
    train_part, val_part, test_part = parts(split, "train"), parts(split, "val"), parts(split, "test")
    method = config.clean.quantile_method
    roles = profile.infer_roles(train_part, target)
    bench = prepare(config.task_type, train_part, val_part, target, roles, config.silhouette, method)
    tuning = tune(bench, models, config.n_iter, config.spaces, config.full_spaces, config.parallelism)
    trials = keep(leaderboard(tuning.frame(spark, config.task_type)), "modeling/tuning")
    ranked, _ = train(bench, models, tuning.best_params, f"{folder}/models")
    board = keep(leaderboard(rows_frame(spark, config.task_type, ranked)), "modeling/leaderboard")

    # Evaluate the leader on held-out rows.
    leader = ranked[0]
    final = evaluate(
        config.task_type, leader, parts(split, "train", "val"), test_part, target, roles, config.silhouette, method
    )
    model_path = final.save(f"{folder}/models/best_current")
    scores = keep(evaluation_frame(spark, final, leader["metrics"]), "modeling/evaluation")

    # Register. The two kinds of silhouette are not comparable, so each clustering is registered under its own.
    known_as = SILHOUETTES[config.silhouette] if config.task_type == "clustering" else target
    state, improved = registry.record_run(
        spark,
        book,
        {
            "run_id": run_id,
            "created_at": datetime.now(timezone.utc),
            "task_type": config.task_type,
            "target": known_as,
            "model_name": final.model_name,
            "rank_score": float(final.metrics["rank_score"]),
            "model_path": model_path,
        },
    )

    # Sum up.
    facts = {
        ("run", "task_text"): config.task_text,
        ("run", "dataset"): config.dataset,
        ("run", "task_type"): config.task_type,
        ("run", "target"): target,
        ("profile", "rows"): shape["rows"],
        ("profile", "columns"): shape["columns"],
        ("cleaning", "rows_before"): report["rows_before"],
        ("cleaning", "rows_after"): report["rows_after"],
        ("cleaning", "reason"): report["reason"],
        ("features", "created"): ", ".join(created),
        ("schema", "snapshot"): json.dumps(snapshot.asDict()),
        ("plan", "models"): ", ".join(models),
        ("evaluation", "model_path"): model_path,
        ("evaluation", "params"): json.dumps(final.params, sort_keys=True),
        ("registry", "status"): state,
        ("registry", "improved"): str(improved).lower(),
    }
    facts |= {("tuning", f"best_params.{m}"): json.dumps(p, sort_keys=True) for m, p in tuning.best_params.items()}
    plain = spark.createDataFrame(
        [(run_id, s, k, None if v is None else str(v)) for (s, k), v in facts.items()], SUMMARY
    )
    best = registry.best_runs(registry.read_registry(spark, book))
    best = best.filter(F.col("task_type").eqNullSafe(config.task_type) & F.col("target").eqNullSafe(F.lit(known_as)))
    named = lambda t, *cs: t.withColumn("key", F.concat_ws(".", *cs))
    top = leaderboard(trials, TUNING_LINES)
    summary = reduce(
        DataFrame.unionAll,
        [
            plain,
            _lines(named(findings, "metric", "name"), run_id, "eda", "key", "value"),
            _lines(manifest, run_id, "splits", "split", "rows"),
            _lines(named(top, "model_name", "params"), run_id, "tuning", "key", "rank_score"),
            _lines(board, run_id, "leaderboard", "model_name", "rank_score"),
            _lines(named(scores, "part", "metric"), run_id, "evaluation", "key", "value"),
            _lines(named(best, "run_id", "model_name"), run_id, "registry_best", "key", "rank_score"),
        ],
    )
    summary = keep(summary, "reports/summary")
    return RunResult(run_id, folder, board, scores, summary, state, bool(improved))
