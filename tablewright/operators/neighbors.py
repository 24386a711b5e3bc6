"""Exact k-nearest-neighbour join, and votes and means over neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage
from .boxes import PART_SAMPLE, SAMPLE_VALUES, box_join, build_parts, side_rows
from .cells import TILE_ROWS, TILES, as_array, as_stored, choose_pivots, vector_key


def knn_join(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    query_id: str = "id",
    point_id: str = "id",
    vector: str = "features",
    payload: Sequence[str] = (),
    exclude_self: bool = False,
    tile_rows: int = TILE_ROWS,
    pivots: int | None = None,
) -> DataFrame:
    """``(query_id, rank, neighbor_id, distance, *payload)``: the ``k`` nearest points.

    Euclidean and exact; equal distances are ordered by point id. Equal vectors are
    merged on both sides first, so that a large group of copies is searched once. A
    first round searches the part that the query falls in; the distance found bounds
    which other parts a second round has to visit (``pivots``: how many there are).
    """
    keep = k + 1 if exclude_self else k
    tagged = points.select(
        F.col(point_id).alias("pid"), as_stored(points, vector).alias("v"), *[F.col(c) for c in payload]
    ).withColumn("key", vector_key(F.col("v")))
    # No more than `keep` copies of a vector can be among anyone's nearest.
    copy = F.row_number().over(W.partitionBy("key").orderBy("pid"))
    copies = cut_lineage(tagged.withColumn("copy", copy).filter(F.col("copy") <= keep), "knn-points")
    distinct = copies.filter(F.col("copy") == 1).select(F.col("key").alias("id"), "v")
    asked = queries.select(F.col(query_id).alias("qid"), as_stored(queries, vector).alias("v")).withColumn(
        "qkey", vector_key(F.col("v"))
    )
    searched = cut_lineage(asked.select(F.col("qkey").alias("id"), "v").dropDuplicates(["id"]), "knn-queries")

    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size["n"]:
        raise ValueError("no points to search")
    most = min(max(size["n"] // TILES, tile_rows), side_rows(size["d"], tile_rows))
    wanted = pivots or -(-size["n"] // most)
    sample = choose_pivots(distinct, min(PART_SAMPLE * wanted, max(SAMPLE_VALUES // max(size["d"], 1), wanted)) if wanted > 1 else 1)
    placed, parts = build_parts(distinct, sample, wanted, most)
    own = box_join(searched, placed, parts, keep, tile_rows)
    if len(parts.rows) == 1:
        found = own
    else:
        own = cut_lineage(own, "knn-own")
        rank = F.row_number().over(W.partitionBy("qkey").orderBy("distance", "key"))
        kth = own.withColumn("r", rank).filter(F.col("r") == keep).select(F.col("qkey").alias("id"), F.col("distance").alias("kth"))
        found = own.unionAll(box_join(searched.join(kth, "id", "left"), placed, parts, keep, tile_rows, F.col("kth")))

    # Nearest vectors per searched vector, with the copies of each, then cut to `keep`.
    near = F.row_number().over(W.partitionBy("qkey").orderBy("distance", "pid"))
    ranked = (
        _cut_vectors(found, keep)
        .join(copies.drop("v", "copy"), "key")
        .withColumn("r", near)
        .filter(F.col("r") <= keep)
    )
    entry = F.struct("distance", "pid", *payload)
    lists = ranked.groupBy("qkey").agg(F.sort_array(F.collect_list(entry)).alias("near"))
    answered = asked.select("qid", "qkey").join(lists, "qkey")
    near = F.filter("near", lambda x: x["pid"] != F.col("qid")) if exclude_self else F.col("near")
    return answered.select("qid", F.posexplode(F.slice(near, 1, k)).alias("pos", "n")).select(
        F.col("qid").alias(query_id),
        (F.col("pos") + 1).alias("rank"),
        F.col("n.pid").alias("neighbor_id"),
        F.col("n.distance").alias("distance"),
        *[F.col(f"n.{c}").alias(c) for c in payload],
    )


def _cut_vectors(found: DataFrame, keep: int) -> DataFrame:
    """Per query the vectors no farther than its ``keep``-th nearest one."""
    rank = F.rank().over(W.partitionBy("qkey").orderBy("distance"))
    return found.withColumn("r", rank).filter(F.col("r") <= keep).drop("r")


def knn_join_approx(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    threshold: float,
    query_id: str = "id",
    point_id: str = "id",
    vector: str = "features",
    tables: int = 4,
    bucket_length: float = 2.0,
) -> DataFrame:
    """The approximate mode: candidates by random projections, at most ``threshold`` away."""
    to_vec = lambda df, i, name: df.select(F.col(i).alias(name), array_to_vector(as_array(df, vector)).alias("v"))
    left, right = to_vec(queries, query_id, "qid"), to_vec(points, point_id, "pid")
    lsh = BucketedRandomProjectionLSH(
        inputCol="v", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=42
    ).fit(right)
    pairs = lsh.approxSimilarityJoin(left, right, threshold, "distance").select(
        F.col("datasetA.qid").alias(query_id), F.col("datasetB.pid").alias("neighbor_id"), "distance"
    )
    rank = F.row_number().over(W.partitionBy(query_id).orderBy("distance", "neighbor_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def vote(neighbors: DataFrame, query_id: str = "id", label: str = "label") -> DataFrame:
    """Majority label of the neighbours, ties to the smallest, and its share."""
    counts = neighbors.groupBy(query_id, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(label).alias("label")))
    return counts.groupBy(query_id).agg(best.alias("b"), F.sum("n").alias("k")).select(
        query_id, F.col("b.label").alias("prediction"), (-F.col("b.neg") / F.col("k")).alias("share")
    )


def mean(neighbors: DataFrame, query_id: str = "id", label: str = "label") -> DataFrame:
    """Mean label of the neighbours."""
    return neighbors.groupBy(query_id).agg(F.avg(F.col(label).cast("double")).alias("prediction"))
