"""The run registry, with orders in the place of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import registry
from ..session import cut_lineage, scratch_path
from .common import plain, table

TURN = "1998-01-01"  # orders before it are history, later ones candidates


def runs(spark, d):
    """Orders read as runs: priority is the task, status the target (open ones have none)."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("task_type"),
        F.expr("nullif(o_orderstatus, 'O')").alias("target"),
        F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("model_name"),
        F.col("o_totalprice").alias("rank_score"),
        F.lit(None).cast("string").alias("model_path"),
    )


SQL_RUNS = (
    "(SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderdate AS created_at, o_orderpriority AS task_type, "
    "nullif(o_orderstatus, 'O') AS target, 'm' || o_custkey AS model_name, o_totalprice AS rank_score FROM orders)"
)


def registry_best(spark, d):
    return plain(registry.best_runs(runs(spark, d)).drop("model_path"))


def registry_compatible(spark, d):
    """Asked for: every kind of run there is, and the market segments, which none is about."""
    history = runs(spark, d)
    asked = history.select("task_type", "target").distinct()
    segments = table(spark, d, "customer").select(F.col("c_mktsegment").alias("task_type"), F.lit("F").alias("target"))
    return plain(registry.status(history, asked.unionAll(segments.distinct())))


def registry_append(spark, d):
    """Early orders are stored, late ones added where they are better than those, and the registry is read back."""
    path = scratch_path(spark, "registry")
    late = F.col("created_at") >= F.lit(TURN).cast("timestamp_ntz")
    registry.append_runs(runs(spark, d).filter(~late), path)
    stored = registry.read_registry(spark, path)
    found = cut_lineage(registry.improvements(stored, runs(spark, d).filter(late)), "candidates")
    registry.append_runs(found.filter("is_better"), path)
    back = registry.read_registry(spark, path).select("run_id", F.lit(True).alias("stored"))
    out = found.join(back, "run_id", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
    return plain(out.select("run_id", "task_type", "target", "rank_score", "to_beat", "is_better", "stored"))


BEST = (
    "(SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY task_type, target ORDER BY rank_score DESC, created_at, "
    "run_id) AS r FROM {source}) WHERE r = 1)"
)

QUERIES = {
    "registry_best": registry_best,
    "registry_compatible": registry_compatible,
    "registry_append": registry_append,
}

ORACLE = {
    "registry_best": "SELECT task_type, target, run_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, model_name, rank_score "
    f"FROM {BEST.format(source=SQL_RUNS)}",
    "registry_compatible": "SELECT a.task_type, a.target, b.rank_score AS to_beat, b.model_name AS best_model, "
    "CASE WHEN b.task_type IS NULL THEN 'incompatible' ELSE 'loaded' END AS status FROM (SELECT DISTINCT task_type, target FROM "
    f"{SQL_RUNS} UNION ALL SELECT DISTINCT c_mktsegment, 'F' FROM customer) a LEFT JOIN {BEST.format(source=SQL_RUNS)} b "
    "ON a.task_type = b.task_type AND a.target IS NOT DISTINCT FROM b.target",
    "registry_append": "SELECT c.run_id, c.task_type, c.target, c.rank_score, b.rank_score AS to_beat, "
    "b.task_type IS NULL OR c.rank_score > b.rank_score AS is_better, "
    "b.task_type IS NULL OR c.rank_score > b.rank_score AS stored FROM "
    f"(SELECT * FROM {SQL_RUNS} WHERE created_at >= '{TURN}') c LEFT JOIN "
    + BEST.format(source=f"(SELECT * FROM {SQL_RUNS} WHERE created_at < '{TURN}')")
    + " b ON c.task_type = b.task_type AND c.target IS NOT DISTINCT FROM b.target",
}
