"""Metrics of predictions as aggregations.

Each takes a table with label and prediction columns and gives one row, or one row
per ``by`` group, so that many models can be measured in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .profile import sketch_distinct

# Distinct scores per range when scores are ranked for the AUC.
SCORES_PER_RANGE = 500_000
MAX_RANGES = 2_000


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    hit = F.avg((F.col(label) == F.col(prediction)).cast("int").cast("double"))
    return df.groupBy(*by).agg(hit.alias("accuracy"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_scores(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1 and support of each class, 0 where undefined."""
    cells = confusion(df, label, prediction, by)
    zero, n = F.lit(0).cast("bigint"), F.col("n")
    as_label = F.struct(
        F.col("label").alias("class"),
        F.when(F.col("label") == F.col("prediction"), n).otherwise(zero).alias("tp"),
        n.alias("support"),
        zero.alias("predicted"),
    )
    as_prediction = F.struct(
        F.col("prediction").alias("class"), zero.alias("tp"), zero.alias("support"), n.alias("predicted")
    )
    sums = (
        cells.select(*by, F.inline(F.array(as_label, as_prediction)))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).cast("double").alias(c) for c in ("tp", "support", "predicted")])
    )
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select(
        *by,
        "class",
        part(F.col("tp"), F.col("predicted")).alias("precision"),
        part(F.col("tp"), F.col("support")).alias("recall"),
        part(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )


def precision_recall_f1(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    by: Sequence[str] = (),
    positive: object | None = None,
) -> DataFrame:
    """Of the ``positive`` class, or averaged over classes by support when None."""
    scores = class_scores(df, label, prediction, by)
    names = ("precision", "recall", "f1")
    if positive is not None:
        picked = [F.max(F.when(F.col("class") == F.lit(positive), F.col(c))) for c in names]
        return scores.groupBy(*by).agg(*[F.coalesce(p, F.lit(0.0)).alias(c) for p, c in zip(picked, names)])
    weighted = [F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")) for c in names]
    return scores.groupBy(*by).agg(*[w.alias(c) for w, c in zip(weighted, names)])


def roc_auc(
    df: DataFrame,
    label: str = "label",
    score: str = "score",
    by: Sequence[str] = (),
    positive: object = 1,
    scores_per_range: int = SCORES_PER_RANGE,
) -> DataFrame:
    """Chance that a positive outscores a negative, ties half; null with one class.

    Equal scores are merged before the shuffle. The distinct scores are then ranked
    within score ranges, and a range starts from the totals of the ranges before it, so
    no task ranks all scores.
    """
    is_positive = F.when(F.col(label) == F.lit(positive), 1).otherwise(0)
    counts = (
        df.filter(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("s"))
        .agg(F.sum(is_positive).cast("double").alias("p"), F.sum(1 - is_positive).cast("double").alias("q"))
    )
    edges = _score_edges(df, score, scores_per_range)
    in_range = (
        F.array_size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("s"))) if edges else F.lit(0)
    )
    ranged = counts.withColumn("range", in_range)
    inner = W.partitionBy(*by, "range").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    in_order = ranged.withColumn("below", F.coalesce(F.sum("q").over(inner), F.lit(0.0)))
    per_range = in_order.groupBy(*by, "range").agg(
        F.sum("p").alias("p"),
        F.sum("q").alias("q"),
        F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("wins"),
    )
    # At most MAX_RANGES rows per group from here on.
    before = W.partitionBy(*by).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    total = per_range.withColumn("wins", F.col("wins") + F.col("p") * F.coalesce(F.sum("q").over(before), F.lit(0.0)))
    pairs = F.sum("p") * F.sum("q")
    return total.groupBy(*by).agg(F.try_divide(F.sum("wins"), pairs).alias("roc_auc"))


def _score_edges(df: DataFrame, score: str, scores_per_range: int) -> list[float]:
    """Literal range bounds: where they fall affects balance only, never the result."""
    if df.count() <= scores_per_range:
        return []
    distinct = df.agg(sketch_distinct(F.col(score)).alias("d")).first()["d"] or 0
    ranges = min(distinct // scores_per_range + 1, MAX_RANGES)
    if ranges <= 1:
        return []
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = df.agg(F.percentile_approx(F.col(score).cast("double"), at, 10 * ranges).alias("e")).first()["e"]
    return sorted(set(found or []))


def regression_errors(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    error = F.col(label).cast("double") - F.col(prediction).cast("double")
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
    )


def rank_score(task_type: str) -> Column:
    """One number to rank models by, larger is better, from the metric columns.

    Classification: AUC, else F1, where 0 counts as absent, else minus infinity.
    Regression: minus RMSE, else (no rows) minus infinity. Clustering: the silhouette of either kind, else minus infinity.
    """
    worst = F.lit(float("-inf"))
    if task_type == "classification":
        return F.coalesce(F.nullif(F.col("roc_auc"), F.lit(0.0)), F.nullif(F.col("f1"), F.lit(0.0)), worst)
    if task_type == "regression":
        return F.coalesce(-F.col("rmse"), worst)
    if task_type == "clustering":
        return F.coalesce("silhouette", "silhouette_squared", worst)
    raise ValueError(f"unknown task type: {task_type}")


def leaderboard(trials: DataFrame, limit: int | None = None) -> DataFrame:
    """Trials, best first: by ``rank_score``, else ``score``, else last; ties by name."""
    worst = F.lit(float("-inf"))
    keys = [F.col(c).cast("double") for c in ("rank_score", "score") if c in trials.columns]
    ordered = trials.withColumn("_rank", F.coalesce(*keys, worst)).orderBy(F.desc("_rank"), "model_name").drop("_rank")
    return ordered if limit is None else ordered.limit(limit)
