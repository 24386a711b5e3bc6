"""Metrics of rule-made predictions, rank scores, leaderboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from .common import plain, table

# Four rules that play the models: name, score expression, threshold.
RULES = [
    ("by_quantity", "l_quantity / 50", 0.5),
    ("by_discount", "l_discount * 10", 0.5),
    ("by_tax", "l_tax * 12", 0.5),
    ("never", "0 * l_tax", 0.5),
]


def predictions(spark, d):
    """One line per row and rule: is the line open, and what does the rule say."""
    df = table(spark, d, "lineitem")
    entries = [
        F.struct(
            F.lit(name).alias("model_name"),
            F.expr(f"CAST({score} AS DOUBLE)").alias("score"),
            F.expr(f"CAST({score} > {cut} AS INT)").alias("prediction"),
        )
        for name, score, cut in RULES
    ]
    return df.select(F.expr("CAST(l_linestatus = 'O' AS INT)").alias("label"), F.inline(F.array(*entries)))


SQL_PREDICTIONS = "(" + " UNION ALL ".join(
    f"SELECT '{name}' AS model_name, CAST(l_linestatus = 'O' AS INT) AS label, {score} AS score, "
    f"CAST({score} > {cut} AS INT) AS prediction FROM lineitem"
    for name, score, cut in RULES
) + ")"


def flags(spark, d):
    """Three classes: the return flag against a rule on quantity."""
    guess = "CASE WHEN l_quantity > 33 THEN 'R' WHEN l_quantity > 16 THEN 'N' ELSE 'A' END"
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("label"), F.expr(guess).alias("prediction")
    )


SQL_FLAGS = (
    "(SELECT l_returnflag AS label, CASE WHEN l_quantity > 33 THEN 'R' WHEN l_quantity > 16 THEN 'N' ELSE 'A' END "
    "AS prediction FROM lineitem)"
)
BY = ["model_name"]


def metric_accuracy(spark, d):
    return plain(metrics.accuracy(predictions(spark, d), by=BY))


def metric_prf_binary(spark, d):
    return plain(metrics.precision_recall_f1(predictions(spark, d), by=BY, positive=1))


def metric_prf_weighted(spark, d):
    return plain(metrics.precision_recall_f1(flags(spark, d)))


def metric_auc(spark, d):
    return plain(metrics.roc_auc(predictions(spark, d), by=BY))


def metric_regression(spark, d):
    df = table(spark, d, "lineitem").selectExpr("l_extendedprice AS label", "l_quantity * 1500 AS prediction")
    return plain(metrics.regression_errors(df), 4)


def trials(spark, d):
    made = predictions(spark, d)
    scored = metrics.precision_recall_f1(made, by=BY, positive=1).join(metrics.roc_auc(made, by=BY), "model_name")
    # The discount rule stands for a model without probabilities.
    return scored.withColumn("roc_auc", F.expr("CASE WHEN model_name NOT IN ('by_discount', 'never') THEN roc_auc END"))


def rank_scores(spark, d):
    scored = trials(spark, d)
    return plain(scored.select("model_name", metrics.rank_score("classification").alias("rank_score")))


def leaderboard(spark, d):
    scored = trials(spark, d).withColumn("rank_score", metrics.rank_score("classification"))
    return plain(metrics.leaderboard(scored.select("model_name", "f1", "rank_score"), 3))


def _prf(source: str, positive: str, by: str) -> str:
    tp = f"count(*) FILTER (WHERE label = {positive} AND prediction = {positive})"
    said = f"count(*) FILTER (WHERE prediction = {positive})"
    real = f"count(*) FILTER (WHERE label = {positive})"
    return (
        f"SELECT {by}coalesce({tp} / nullif({said}, 0), 0.0) AS precision, coalesce({tp} / nullif({real}, 0), 0.0) AS recall, "
        f"coalesce(2.0 * {tp} / nullif({said} + {real}, 0), 0.0) AS f1, {real} AS support FROM {source}"
    )


SQL_PRF = f"({_prf(SQL_PREDICTIONS, '1', 'model_name, ')} GROUP BY model_name)"
SQL_AUC = (
    "(SELECT model_name, (sum(r) FILTER (WHERE label = 1) - p * (p + 1) / 2.0) / (p * q) AS roc_auc FROM (SELECT *, "
    "rank() OVER (PARTITION BY model_name ORDER BY score) + (count(*) OVER (PARTITION BY model_name, score) - 1) / 2.0 AS r, "
    "CAST(sum(label) OVER (PARTITION BY model_name) AS DOUBLE) AS p, "
    f"CAST(sum(1 - label) OVER (PARTITION BY model_name) AS DOUBLE) AS q FROM {SQL_PREDICTIONS}) GROUP BY model_name, p, q)"
)
SQL_TRIALS = (
    "(SELECT model_name, f1, coalesce(nullif(CASE WHEN model_name NOT IN ('by_discount', 'never') THEN roc_auc END, 0), "
    f"nullif(f1, 0), CAST('-inf' AS DOUBLE)) AS rank_score FROM {SQL_PRF} JOIN {SQL_AUC} USING (model_name))"
)
_CLASSES = " UNION ALL ".join(f"({_prf(SQL_FLAGS, repr(c), '')})" for c in "ANR")

QUERIES = {
    "metric_accuracy": metric_accuracy,
    "metric_prf_binary": metric_prf_binary,
    "metric_prf_weighted": metric_prf_weighted,
    "metric_auc": metric_auc,
    "metric_regression": metric_regression,
    "rank_scores": rank_scores,
    "leaderboard": leaderboard,
}

ORACLE = {
    "metric_accuracy": f"SELECT model_name, round(avg(CAST(label = prediction AS INT)), 6) AS accuracy FROM {SQL_PREDICTIONS} GROUP BY 1",
    "metric_prf_binary": f"SELECT model_name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {SQL_PRF}",
    "metric_prf_weighted": "SELECT "
    + ", ".join(f"round(sum({m} * support) / sum(support), 6) AS {m}" for m in ("precision", "recall", "f1"))
    + f" FROM ({_CLASSES})",
    "metric_auc": f"SELECT model_name, round(roc_auc, 6) AS roc_auc FROM {SQL_AUC}",
    "metric_regression": "SELECT round(sqrt(avg(pow(l_extendedprice - l_quantity * 1500, 2))), 4) AS rmse, "
    "round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae FROM lineitem",
    "rank_scores": f"SELECT model_name, round(rank_score, 6) AS rank_score FROM {SQL_TRIALS}",
    "leaderboard": "SELECT model_name, round(f1, 6) AS f1, round(rank_score, 6) AS rank_score FROM "
    f"{SQL_TRIALS} t ORDER BY t.rank_score DESC, model_name LIMIT 3",
}
