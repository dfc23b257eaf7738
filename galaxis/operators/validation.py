"""Cluster validation as DataFrame aggregations: silhouette, Davies-Bouldin, Calinski-Harabasz, WSS, ARI, NMI.

Silhouettes need all distances: blocks of points meet as matrices, and each pair of blocks is reduced at once to sums by
point and cluster, so no pair of points leaves a task. All other metrics are one or two aggregations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galaxis.functions import kernels, vectors
from galaxis.operators import graph
from galaxis.operators.kmeans import cluster_means

NOISE = -1


def without_noise(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("label") != NOISE)


def label_summary(labels: DataFrame) -> Row:
    """n and k without noise, and had_noise."""
    clean = F.col("label") != NOISE
    return labels.agg(F.sum(F.when(clean, 1).otherwise(0)).alias("n"), F.count_distinct(F.when(clean, F.col("label"))).alias("k"), F.coalesce(F.max(~clean), F.lit(False)).alias("had_noise")).first()


def check_lengths(points: DataFrame, labels: DataFrame) -> None:
    """Points and labels must have the same ids."""
    both = points.select("id", F.lit(1).alias("p")).join(labels.select("id", F.lit(1).alias("l")), "id", "full")
    if not both.where("p IS NULL OR l IS NULL").isEmpty():
        raise ValueError("points and labels must have the same ids")


SUMS = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("s", T.DoubleType())])


def silhouette_samples(points: DataFrame, labels: DataFrame, metric: str = "euclidean", subset: DataFrame | None = None, block_rows: int = graph.BLOCK_ROWS) -> DataFrame:
    """(id, label, silhouette) of the points outside noise, or of those among them in `subset` (id).

    A point alone in its cluster has 0, as has one at distance 0 from its own and the nearest other cluster. One cluster
    gives zeros if there was noise, and is refused otherwise; so are no clusters."""
    got = label_summary(labels)
    clean = without_noise(labels).select("id", F.col("label").cast("int").alias("label"))
    if got["k"] == 0 or got["k"] == 1 and not got["had_noise"]:
        raise ValueError("silhouettes need at least two clusters")
    asked = clean if subset is None else clean.join(subset.select("id"), "id", "left_semi")
    if got["k"] == 1:
        return asked.withColumn("silhouette", F.lit(0.0))
    sizes = clean.groupBy("label").agg(F.count("*").alias("size"))
    # A cluster's number goes along as the last feature of the right-hand blocks.
    right = graph.blocks(points.join(clean, "id").select("id", F.concat("features", F.array(F.col("label").cast("double"))).alias("features")), block_rows)
    left = graph.blocks(points.join(asked.select("id"), "id", "left_semi"), block_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x, b, y in zip(*(batch.column(c).to_pylist() for c in ("ids", "x", "ids2", "x2")), strict=True):
                (a, x), (b, y) = graph.unpack(a, x), graph.unpack(b, y)
                names, place = np.unique(y[:, -1].astype(np.int32), return_inverse=True)
                d = kernels.distances(x, y[:, :-1], metric)
                d[a[:, None] == b[None, :]] = 0  # also where a small constant keeps a cosine from it
                sums = d @ np.eye(len(names))[place]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a, len(names))), pa.array(np.tile(names, len(a))), pa.array(sums.ravel())], names=SUMS.names)

    sums = graph.block_pairs(left, right).mapInArrow(run, SUMS).groupBy("id", "label").agg(F.sum("s").alias("s"))
    means = sums.join(sizes, "label").join(asked.select("id", F.col("label").alias("own")), "id")
    same = F.col("label") == F.col("own")
    both = means.groupBy("id", "own").agg(
        F.max(F.when(same, F.col("size"))).alias("n"), F.max(F.when(same & (F.col("size") > 1), F.col("s") / (F.col("size") - 1))).alias("a"), F.min(F.when(~same, F.col("s") / F.col("size"))).alias("b")
    )
    top = F.greatest("a", "b")
    return both.select("id", F.col("own").alias("label"), F.when((F.col("n") == 1) | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("silhouette"))


def silhouette_score(points: DataFrame, labels: DataFrame, metric: str = "euclidean") -> float:
    return silhouette_samples(points, labels, metric).agg(F.avg("silhouette")).first()[0]


def silhouette_score_subset(points: DataFrame, labels: DataFrame, subset: DataFrame, metric: str = "euclidean") -> float:
    """The mean over the points of `subset` outside noise, against all points; 0 if noise is all that it holds."""
    got = silhouette_samples(points, labels, metric, subset).agg(F.avg("silhouette")).first()[0]
    return 0.0 if got is None else got


def centroids(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, size, mean) outside noise."""
    return cluster_means(points, without_noise(labels))


def dispersion(points: DataFrame, labels: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(label, mean, spread): the mean distance of a cluster's points to its centroid, 0 for one point."""
    means = centroids(points, labels)
    if metric == "cosine":
        means = means.withColumn("mean", vectors.normalized("mean"))
    rows = points.join(without_noise(labels), "id").join(means, "label")
    spread = rows.groupBy("label").agg(F.first("mean").alias("mean"), F.count("*").alias("n"), F.avg(vectors.distance("features", "mean", metric)).alias("s"))
    return spread.select("label", "mean", F.when(F.col("n") == 1, 0.0).otherwise(F.col("s")).alias("spread"))


def davies_bouldin_table(points: DataFrame, labels: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(label, worst): for each cluster the largest ratio of spreads to centroid distance. Equal centroids count as
    infinitely bad if the clusters spread, and not at all otherwise."""
    a = dispersion(points, labels, metric)
    b = a.select(F.col("label").alias("l2"), F.col("mean").alias("m2"), F.col("spread").alias("s2"))
    gap = vectors.distance("mean", "m2", metric)
    both = F.col("spread") + F.col("s2")
    ratio = F.when(gap > 0, both / gap).when(both > 0, F.lit(float("inf"))).otherwise(0.0)
    return a.join(b, F.col("label") != F.col("l2")).groupBy("label").agg(F.max(ratio).alias("worst"))


def davies_bouldin(points: DataFrame, labels: DataFrame, metric: str = "euclidean") -> float:
    """0 where noise leaves fewer than two clusters; without noise those are refused."""
    got = label_summary(labels)
    if got["k"] < 2:
        if got["had_noise"]:
            return 0.0
        raise ValueError("Davies-Bouldin needs at least two clusters")
    return davies_bouldin_table(points, labels, metric).agg(F.avg("worst")).first()[0]


def sums_of_squares(points: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (n, k, wss, bss) outside noise."""
    rows = points.join(without_noise(labels), "id")
    means = cluster_means(points, without_noise(labels))
    whole = rows.select(F.posexplode("features").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    whole = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("center"))
    within = rows.join(means.select("label", "mean"), "label").agg(F.count("*").alias("n"), F.sum(vectors.squared_euclidean("features", "mean")).alias("wss"))
    between = means.join(F.broadcast(whole)).agg(F.count("*").alias("k"), F.sum(F.col("size") * vectors.squared_euclidean("mean", "center")).alias("bss"))
    return within.join(F.broadcast(between)).select("n", "k", "wss", "bss")


def calinski_harabasz(points: DataFrame, labels: DataFrame) -> float:
    """0 where noise leaves fewer than two clusters or single points; without noise those are refused."""
    got = label_summary(labels)
    if got["k"] < 2 or got["k"] >= got["n"]:
        if got["had_noise"]:
            return 0.0
        raise ValueError("Calinski-Harabasz needs between 2 and n - 1 clusters")
    s = sums_of_squares(points, labels).first()
    return math.inf if s["wss"] == 0 else (s["bss"] / (s["k"] - 1)) / (s["wss"] / (s["n"] - s["k"]))


#: The same computation; aggregations never hold more than their groups.
davies_bouldin_efficient, calinski_harabasz_efficient = davies_bouldin, calinski_harabasz


def wss(points: DataFrame, labels: DataFrame) -> float:
    """The sum of squared distances to the means of labels, noise being a group like any other."""
    means = cluster_means(points, labels).select("label", "mean")
    return points.join(labels, "id").join(means, "label").agg(F.sum(vectors.squared_euclidean("features", "mean"))).first()[0]


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(t, p, n) with marginals: null t or p stands for all. Noise is a label like any other."""
    both = a.select("id", F.col("label").alias("t")).join(b.select("id", F.col("label").alias("p")), "id")
    return both.cube("t", "p").agg(F.count("*").alias("n"), F.grouping_id("t", "p").cast("int").alias("level"))


def _cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of what ARI and NMI are made of."""
    cube = contingency(a, b)
    n, total = F.col("n"), F.col("total")
    cube = cube.join(F.broadcast(cube.where("level = 3").select(F.col("n").alias("total"))))
    part = lambda level, value: F.coalesce(F.sum(F.when(F.col("level") == level, value)), F.lit(0.0))
    entropy = -(n / total) * F.log(n / total)
    return cube.agg(
        F.max("total").alias("n"), part(0, vectors.comb2(n)).alias("cells"), part(1, vectors.comb2(n)).alias("rows"), part(2, vectors.comb2(n)).alias("columns"),
        part(0, entropy).alias("h"), part(1, entropy).alias("ht"), part(2, entropy).alias("hp"),
    )


def _checked(a: DataFrame, b: DataFrame) -> Row:
    check_lengths(a, b)
    got = _cells(a, b).first()
    if not got["n"]:
        raise ValueError("labels are empty")
    return got


def adjusted_rand_index(a: DataFrame, b: DataFrame) -> float:
    s = _checked(a, b)
    if s["n"] <= 1:
        return 1.0
    expected = s["rows"] * s["columns"] / (s["n"] * (s["n"] - 1) / 2)
    most = (s["rows"] + s["columns"]) / 2
    if most == expected:
        return 1.0 if s["cells"] == expected else 0.0
    return (s["cells"] - expected) / (most - expected)


NORMALIZERS = {"arithmetic": lambda a, b: (a + b) / 2, "geometric": lambda a, b: math.sqrt(a * b), "min": min, "max": max}


def normalized_mutual_info(a: DataFrame, b: DataFrame, average: str = "arithmetic") -> float:
    if average not in NORMALIZERS:
        raise ValueError(f"average must be one of {sorted(NORMALIZERS)}")
    s = _checked(a, b)
    info = max(0.0, s["ht"] + s["hp"] - s["h"])
    scale = NORMALIZERS[average](max(0.0, s["ht"]), max(0.0, s["hp"]))
    if scale < 1e-15:
        return 1.0 if info < 1e-15 else 0.0
    return min(1.0, info / scale)
