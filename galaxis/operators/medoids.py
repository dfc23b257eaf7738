"""Medoids: for each cluster the point nearest to its mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galaxis.functions import vectors
from galaxis.operators.kmeans import cluster_means


def select_medoids(points: DataFrame, labels: DataFrame, n_clusters: int, metric: str = "euclidean") -> DataFrame:
    """(cluster, id, distance) for clusters 0 to n_clusters - 1; ties go to the lower id, and an empty cluster has id -1
    at an infinite distance. Labels outside the range, noise among them, take no part."""
    inside = labels.where((F.col("label") >= 0) & (F.col("label") < n_clusters)).select("id", F.col("label").cast("int").alias("label"))
    means = cluster_means(points, inside).select("label", "mean")
    rows = points.join(inside, "id").join(means, "label")
    best = rows.groupBy("label").agg(F.min(F.struct(vectors.distance("features", "mean", metric).alias("distance"), "id")).alias("m"))
    every = points.sparkSession.range(n_clusters).select(F.col("id").cast("int").alias("label"))
    out = every.join(best, "label", "left")
    return out.select(F.col("label").alias("cluster"), F.coalesce("m.id", F.lit(-1)).alias("id"), F.coalesce("m.distance", F.lit(float("inf"))).alias("distance"))
