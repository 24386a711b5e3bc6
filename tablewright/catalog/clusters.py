"""Neighbours, density clusters and cluster metrics on the embeddings."""

from __future__ import annotations

from ..operators import cluster_metrics, density, neighbors
from .common import plain, table

K = 5
EPS, MIN_SAMPLES = 1.15, 5


def _near(spark, d, k=K):
    df = table(spark, d, "embeddings")
    return neighbors.knn_join(df, df, k, "vec_id", "vec_id", "embedding", ["label"], exclude_self=True)


def knn_topk(spark, d):
    return plain(_near(spark, d).drop("label"))


def knn_vote(spark, d):
    return plain(neighbors.vote(_near(spark, d), "vec_id"))


def knn_mean(spark, d):
    return plain(neighbors.mean(_near(spark, d), "vec_id"))


def density_clusters(spark, d):
    return density.dbscan(table(spark, d, "embeddings"), EPS, MIN_SAMPLES, "vec_id", "embedding")


def metric_silhouette(spark, d):
    return plain(cluster_metrics.silhouette(table(spark, d, "embeddings"), "embedding", "label"))


def metric_silhouette_sq(spark, d):
    value = cluster_metrics.silhouette_squared(table(spark, d, "embeddings"), "embedding", "label")
    return plain(spark.createDataFrame([(value,)], "silhouette double"))


def metric_davies_bouldin(spark, d):
    return plain(cluster_metrics.davies_bouldin(table(spark, d, "embeddings"), "embedding", "label"))


def metric_calinski_harabasz(spark, d):
    return plain(cluster_metrics.calinski_harabasz(table(spark, d, "embeddings"), "embedding", "label"))


E = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
PAIRS = f"(SELECT a.vec_id AS i, a.label AS li, b.vec_id AS j, b.label AS lj, list_distance(a.v, b.v) AS g FROM {E} a, {E} b WHERE a.vec_id <> b.vec_id)"
NEAR = (
    "(SELECT i AS vec_id, CAST(r AS INTEGER) AS rank, j AS neighbor_id, g AS distance, lj AS label FROM (SELECT *, "
    f"row_number() OVER (PARTITION BY i ORDER BY g, j) AS r FROM {PAIRS}) WHERE r <= {K})"
)


def _silhouette(power: int) -> str:
    return (
        f"WITH sums AS (SELECT i, li, lj, sum(pow(g, {power})) AS far FROM {PAIRS} GROUP BY 1, 2, 3), "
        "sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), "
        "ab AS (SELECT i, max(CASE WHEN li = lj THEN far / (n - 1) END) AS a, min(CASE WHEN li <> lj THEN far / n END) AS b "
        "FROM sums JOIN sizes ON lj = label GROUP BY i) "
        "SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM ab"
    )


CENTRES = (
    "centres AS (SELECT label, list(m ORDER BY p) AS c, any_value(n) AS n FROM (SELECT label, p, avg(x) AS m, count(*) AS n FROM "
    f"(SELECT label, unnest(v) AS x, unnest(range(len(v))) AS p FROM {E}) GROUP BY 1, 2) GROUP BY 1)"
)

QUERIES = {
    "knn_topk": knn_topk,
    "knn_vote": knn_vote,
    "knn_mean": knn_mean,
    "density_clusters": density_clusters,
    "metric_silhouette": metric_silhouette,
    "metric_silhouette_sq": metric_silhouette_sq,
    "metric_davies_bouldin": metric_davies_bouldin,
    "metric_calinski_harabasz": metric_calinski_harabasz,
}

ORACLE = {
    "knn_topk": f"SELECT vec_id, rank, neighbor_id, round(distance, 6) AS distance FROM {NEAR}",
    "knn_vote": "SELECT vec_id, label AS prediction, round(n / CAST(k AS DOUBLE), 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY "
    "vec_id) AS k, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS r FROM (SELECT vec_id, label, count(*) AS n FROM "
    f"{NEAR} GROUP BY 1, 2)) WHERE r = 1",
    "knn_mean": f"SELECT vec_id, round(avg(label), 6) AS prediction FROM {NEAR} GROUP BY 1",
    "density_clusters": f"WITH RECURSIVE points AS (SELECT vec_id AS i FROM embeddings), near AS (SELECT i, j FROM {PAIRS} WHERE g <= {EPS} "
    "UNION ALL SELECT i, i FROM points), "
    f"core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= {MIN_SAMPLES}), "
    "links AS (SELECT i, j FROM near WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)), "
    "reach AS (SELECT i, i AS j FROM core UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i), "
    "roots AS (SELECT i, min(j) AS root FROM reach GROUP BY i), "
    "border AS (SELECT n.i, min(root) AS root FROM near n JOIN roots r ON n.j = r.i WHERE n.i NOT IN (SELECT i FROM core) GROUP BY n.i) "
    "SELECT p.i AS vec_id, coalesce(r.root, b.root, -1) AS cluster, r.root IS NOT NULL AS is_core FROM points p "
    "LEFT JOIN roots r ON p.i = r.i LEFT JOIN border b ON p.i = b.i",
    "metric_silhouette": _silhouette(1),
    "metric_silhouette_sq": _silhouette(2),
    "metric_davies_bouldin": f"WITH {CENTRES}, spread AS (SELECT e.label, any_value(c) AS c, avg(list_distance(v, c)) AS s FROM {E} e "
    "JOIN centres USING (label) GROUP BY 1) SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT a.label, "
    "max((a.s + b.s) / list_distance(a.c, b.c)) AS w FROM spread a, spread b WHERE a.label <> b.label GROUP BY 1)",
    "metric_calinski_harabasz": f"WITH {CENTRES}, whole AS (SELECT list(m ORDER BY p) AS o FROM (SELECT p, avg(x) AS m FROM (SELECT "
    f"unnest(v) AS x, unnest(range(len(v))) AS p FROM {E}) GROUP BY 1)), "
    "b AS (SELECT sum(n * pow(list_distance(c, o), 2)) AS b, count(*) AS k, sum(n) AS n FROM centres, whole), "
    f"w AS (SELECT sum(pow(list_distance(v, c), 2)) AS w FROM {E} JOIN centres USING (label)) "
    "SELECT round(CAST((b / (k - 1)) / (w / (n - k)) AS DOUBLE), 6) AS calinski_harabasz FROM b, w",
}
