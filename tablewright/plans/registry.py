"""The registry of runs: an append-only table, best run per task and target."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "run_id string, created_at timestamp, task_type string, target string, "
    "model_name string, rank_score double, model_path string"
)
KEY = ["task_type", "target"]


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """All runs; an absent registry is empty."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or str(error)):
            raise
        return spark.createDataFrame([], SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def append_runs(runs: DataFrame, path: str) -> None:
    """Add runs to the registry."""
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    runs.select(*[F.col(n).cast(kinds[n]).alias(n) for n in NAMES]).write.mode("append").parquet(path)


def append_run(spark: SparkSession, path: str, run: dict) -> None:
    append_runs(spark.createDataFrame([tuple(run.get(n) for n in NAMES)], SCHEMA).coalesce(1), path)


def record_run(spark: SparkSession, path: str, run: dict) -> tuple[str, bool]:
    """Add a run; returns the state of the registry before it and whether it is the best of its kind so far.

    Two runs that end at once may both find themselves better than what they read; which one is best is
    what ``best_runs`` says afterwards.
    """
    runs = read_registry(spark, path)
    row = spark.createDataFrame([tuple(run.get(n) for n in NAMES)], SCHEMA)
    found = improvements(runs, row).first()
    state = status(runs, row.select(*KEY)).first()["status"]
    append_run(spark, path, run)
    return state, bool(found["is_better"])


def best_runs(runs: DataFrame) -> DataFrame:
    """One row per task and target: highest score, then earliest, then smallest run id.

    A plain aggregate, so that scores merge before the shuffle. A missing target is a
    key of its own.
    """
    rest = [c for c in runs.columns if c not in KEY]
    order = F.struct(
        (-F.coalesce("rank_score", F.lit(float("-inf")))).alias("worst"), F.col("created_at"), F.col("run_id")
    )
    best = runs.groupBy(*KEY).agg(F.min_by(F.struct(*rest), order).alias("best"))
    return best.select(*KEY, *[F.col(f"best.{c}").alias(c) for c in rest])


def status(runs: DataFrame, current: DataFrame) -> DataFrame:
    """For each ``current(task_type, target)``: empty, loaded or incompatible, and the score to beat.

    ``loaded`` has an earlier run of the same task and target; ``incompatible`` means
    the registry holds only others.
    """
    best = best_runs(runs).select(
        F.col("task_type").alias("_task"), F.col("target").alias("_target"), F.col("rank_score").alias("to_beat"),
        F.col("model_name").alias("best_model"),
    )
    same = F.col("task_type").eqNullSafe(F.col("_task")) & F.col("target").eqNullSafe(F.col("_target"))
    matched = current.join(best, same, "left")
    found = not runs.isEmpty()
    verdict = F.when(F.lit(not found), "empty").when(F.col("_task").isNotNull(), "loaded").otherwise("incompatible")
    return matched.withColumn("status", verdict).drop("_task", "_target")


def improvements(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``to_beat`` and ``is_better``: strictly above, or the first of its kind."""
    best = best_runs(runs).select(
        F.col("task_type").alias("_task"), F.col("target").alias("_target"), F.col("rank_score").alias("to_beat")
    )
    same = F.col("task_type").eqNullSafe(F.col("_task")) & F.col("target").eqNullSafe(F.col("_target"))
    better = F.col("_task").isNull() | (F.col("rank_score") > F.coalesce("to_beat", F.lit(float("-inf"))))
    return candidates.join(best, same, "left").withColumn("is_better", better).drop("_task", "_target")
