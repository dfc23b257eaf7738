"""Queries that fit estimators. Iterations have no SQL, so tests hold them against stored results and other algorithms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galaxis.functions import kernels
from galaxis.operators import graph, medoids, selection, som, validation
from galaxis.operators.hierarchy import HDBSCAN, Agglomerative
from galaxis.operators.kmeans import KMeans, nearest
from galaxis.operators.pca import PCA, project_2d
from galaxis.operators.spectral import Spectral
from galaxis.plans.relational import embeddings, one, r6, truth
from galaxis.sources import datasets, frames
from galaxis.streaming import som_stream

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("size"), F.min("id").alias("first"))


def first_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir)


@query("kmeans_summary")
def kmeans_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded K-Means over the embeddings: size and mean distance by cluster, and the agreement with the labels."""
    points = embeddings(spark, sf_dir)
    model = KMeans(10, n_init=3, random_state=42).fit(points)
    labels = nearest(points, model.assigning)
    agreement = validation.adjusted_rand_index(labels.select("id", "label"), truth(spark, sf_dir))
    return labels.groupBy("label").agg(F.count("*").alias("size"), r6(F.avg("distance")).alias("mean_distance")).withColumn("ari", F.lit(round(agreement, 6)))


@query("kmeans_fit")
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KMeans(10, n_init=3, random_state=42).fit_predict(embeddings(spark, sf_dir))


@query("kmeans_cosine_fit")
def kmeans_cosine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KMeans(10, n_init=3, metric="cosine", random_state=42).fit_predict(embeddings(spark, sf_dir))


@query("kmeans_predict")
def kmeans_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of all embeddings, saved and read again, predicts every one."""
    from galaxis.operators.kmeans import KMeansModel

    points = embeddings(spark, sf_dir)
    model = KMeansModel.from_json(KMeans(5, n_init=2, random_state=1).fit(points).to_json())
    return model.predict(points)


@query("kmeans_spread_fit")
def kmeans_spread_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-Means of the line items' prices by jobs over the frame, as for tables beyond the driver's bound."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    points = frames.points(rows.withColumns({"a": F.col("l_quantity") / 50, "b": F.col("l_extendedprice") / 100_000}), "id", ["a", "b"])
    model = KMeans(4, max_iter=5, n_init=1, random_state=7).fit(points, driver_values=0)
    return sizes(model.labels(points))


for _name, _params in {"rbf": {"gamma": 3.0}, "nearest_neighbors": {"n_neighbors": 10}, "cosine": {}}.items():
    query(f"spectral_{_name}")(lambda spark, sf_dir, name=_name, params=_params: Spectral(5, name, n_init=3, random_state=42, **params).fit_predict(first_points(spark, sf_dir)))


@query("spectral_validation")
def spectral_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Spectral(4, "nearest_neighbors", n_neighbors=10, use_validation=True, validation_attempts=5, random_state=1).fit_predict(embeddings(spark, sf_dir))


@query("spectral_sweep")
def spectral_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Spectral(3, intensive_parameter_sweep=True, gamma_range=(0.5, 1.0), random_state=3).fit(datasets.toy(spark, "blobs", 120))
    return sizes(model.labels(spark))


@query("spectral_medoids")
def spectral_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = datasets.toy(spark, "moons", 200)
    return Spectral(2, "nearest_neighbors", n_neighbors=8, random_state=0).fit(points).compute_medoids(points).withColumn("distance", r6("distance"))


for _linkage in ("ward", "complete", "average", "single"):
    query(f"agglomerative_{_linkage}")(lambda spark, sf_dir, linkage=_linkage: Agglomerative(6, linkage).fit_predict(first_points(spark, sf_dir)))


@query("agglomerative_threshold")
def agglomerative_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(Agglomerative(None, "single", distance_threshold=1.12).fit_predict(embeddings(spark, sf_dir)))


@query("agglomerative_precomputed")
def agglomerative_precomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average linkage of manhattan distances that come as a long frame, or in rounds where that is too large to gather."""
    return Agglomerative(4, "average", "precomputed").fit_predict(graph.Distances(embeddings(spark, sf_dir), "manhattan"))


@query("agglomerative_merge_tree")
def agglomerative_merge_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Agglomerative(2, "complete").fit(embeddings(spark, sf_dir)).merge_tree(spark).withColumn("distance", r6("distance"))


for _name, _params in {"eom": {}, "leaf": {"cluster_selection_method": "leaf"}, "eps": {"cluster_selection_epsilon": 0.3}, "manhattan": {"metric": "manhattan"}}.items():
    query(f"hdbscan_{_name}")(lambda spark, sf_dir, params=_params: HDBSCAN(5, min_samples=3, **params).fit(datasets.toy(spark, "moons", 300)).result(spark).withColumn("probability", r6("probability")))


@query("hdbscan_embeddings")
def hdbscan_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HDBSCAN(5).fit_predict(embeddings(spark, sf_dir))


@query("hdbscan_condensed_tree")
def hdbscan_condensed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HDBSCAN(5).fit(datasets.toy(spark, "moons", 300)).condensed_tree(spark)


@query("spanning_tree", None)
def spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning forest of the neighbour graph of the embeddings."""
    points = embeddings(spark, sf_dir)
    return graph.spanning_forest(graph.nearest_neighbours(points, 10, include_self=False)).withColumn("d", r6("d"))


@query("pca_fit")
def pca_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = PCA(5).fit(embeddings(spark, sf_dir))
    return spark.createDataFrame([(k, round(float(v), 6), round(float(np.abs(c).max()), 6)) for k, (v, c) in enumerate(zip(model.explained_variance_, model.components_, strict=True))], "component int, variance double, largest double")


@query("pca_transform")
def pca_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = embeddings(spark, sf_dir)
    model = PCA(3).fit(points)
    back = model.inverse_transform(model.transform(points))
    return model.transform(points).join(back.select("id", F.size("features").alias("n")), "id").select("id", "n", r6(F.abs(F.col("features")[0])).alias("z0"))


@query("project_2d")
def project_2d_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_2d(embeddings(spark, sf_dir)).select("id", r6("x").alias("x"), r6("y").alias("y"))


def _map(spark: SparkSession, sf_dir: str) -> som.SOM:
    return som.SOM(5, 4, num_epochs=10, initialization="linear", random_state=42).fit(embeddings(spark, sf_dir))


@query("som_fit")
def som_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir).predict(embeddings(spark, sf_dir)).select("id", "label", r6("distance").alias("distance"))


@query("som_fit_cluster")
def som_fit_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(_map(spark, sf_dir).cluster(embeddings(spark, sf_dir), 4))


@query("som_batch_fit")
def som_batch_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributed trainer over all line items."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    points = frames.points(rows.withColumns({"a": F.col("l_quantity") / 50, "b": F.col("l_extendedprice") / 100_000, "c": F.col("l_discount") * 10}), "id", ["a", "b", "c"])
    return som.hit_map(som.SOM(4, 4, topology="hexagonal", num_epochs=5, random_state=1).fit_batches(points), points)


@query("som_export")
def som_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = som.export_map(_map(spark, sf_dir), "csv").splitlines()
    return spark.createDataFrame([(i, len(x.split(","))) for i, x in enumerate(lines)], "line int, fields int")


@query("mini_batch_events")
def mini_batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map trained on the events in four batches, as a stream delivers them; its hits on all events."""
    points = som_stream.event_points(spark.read.parquet(f"{sf_dir}/events.parquet")).persist()
    out = som.SOM(4, 3, random_state=5, online_mode=True)
    for k in range(4):
        out.partial_fit(points.where(F.col("id") % 4 == k))
    return som.hit_map(out, points)


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return som_stream.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("total", F.round("total", 4))


for _name, _params in {"combined": {}, "elbow": {"method": "elbow"}, "silhouette": {"method": "silhouette"}, "agglomerative": {"algorithm": "agglomerative"}, "spectral": {"algorithm": "spectral", "params": {"random_state": 1, "n_init": 2}}, "som": {"algorithm": "som", "params": {"random_state": 1, "num_epochs": 10}}}.items():

    @query(f"find_optimal_{_name}")
    def _optimal(spark: SparkSession, sf_dir: str, options=_params) -> DataFrame:
        options = {"params": {"random_state": 1, "n_init": 2}} | options if options.get("algorithm", "kmeans") == "kmeans" else options
        _, found = selection.find_optimal_clusters(datasets.toy(spark, "blobs", 150), (2, 6), **options)
        out = selection.evaluation_frame(spark, found)
        return out.select("k", *(r6(c).alias(c) for c in out.columns[1:]))


@query(
    "knee_on_wss_curve",
    "WITH c AS (SELECT k, 1000.0 / k AS y FROM range(1, 11) r(k)), s AS (SELECT k, (k - 1) / 9.0 AS x, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS y FROM c), g AS (SELECT k, y - (1 - x) AS d FROM s) SELECT k, round(d, 6)::DOUBLE AS difference, k = (SELECT arg_min(k, d) FROM g WHERE k BETWEEN 2 AND 9) AS knee FROM g",
)
def knee_on_wss_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    ks = list(range(1, 11))
    knee = kernels.find_knee(ks, [1000.0 / k for k in ks])
    return spark.createDataFrame([(k, round(d, 6), k == knee.x) for k, d in zip(ks, knee.differences, strict=True)], "k long, difference double, knee boolean")


@query("blobs_quality")
def blobs_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated blobs are found again: the agreement of K-Means with the labels they were made with."""
    rows = datasets.make_blobs(spark, 2000, 4, 5, 0.5, 11)
    labels = KMeans(5, random_state=0).fit_predict(rows.select("id", "features"))
    return one(spark, "ari", validation.adjusted_rand_index(labels, rows.select("id", "label")))


@query("medoids_of_kmeans")
def medoids_of_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = embeddings(spark, sf_dir)
    labels = KMeans(6, n_init=2, random_state=9).fit_predict(points)
    return medoids.select_medoids(points, labels, 6).withColumn("distance", r6("distance"))
