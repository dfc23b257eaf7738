import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from galaxis.functions import kernels, vectors
from galaxis.operators import graph, selection, som, validation
from galaxis.operators.hierarchy import HDBSCAN, Agglomerative
from galaxis.operators.kmeans import KMeans, KMeansModel
from galaxis.operators.medoids import select_medoids
from galaxis.operators.pca import PCA, PCAModel
from galaxis.operators.spectral import Spectral, score
from galaxis.sources import datasets, frames


@pytest.fixture(scope="module")
def x():
    return datasets.blob_arrays(90, 3, 4, 0.8, 5)[0]


@pytest.fixture(scope="module")
def points(spark, x):
    return frames.from_rows(spark, x).repartition(3).persist()


def table(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_frames(spark, x):
    cols = spark.createDataFrame([(1, 2.0, 3), (2, 4.0, 5)], "k int, a double, b int")
    assert frames.matrix(frames.points(cols, "k", ["a", "b"]))[1].tolist() == [[2.0, 3.0], [4.0, 5.0]]
    from pyspark.ml.feature import VectorAssembler

    ml = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(cols)
    assert frames.matrix(frames.points(ml, "k", "v"))[1].tolist() == [[2.0, 3.0], [4.0, 5.0]]
    bad = spark.createDataFrame([(1, [1.0, None])], "id long, features array<double>")
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, features array<double>")
    for frame in (bad, ragged):
        with pytest.raises(ValueError):
            frames.shape(frame)
    with pytest.raises(ValueError):
        frames.matrix(frames.from_rows(spark, x), most=10)
    assert [r.label for r in frames.from_labels(spark, [0.2, 1.9]).orderBy("id").collect()] == [0, 2]


def test_square_checks(spark):
    good = spark.createDataFrame([(0, 0, 0.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 0.0)], "i long, j long, d double")
    assert frames.square(good)[1].tolist() == [[0, 2], [2, 0]]
    for rows in ([(0, 1, 2.0), (1, 0, 1.0)], [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0)]):
        with pytest.raises(ValueError):
            frames.square(spark.createDataFrame(rows, "i long, j long, d double"))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_pairs_and_neighbours(points, x, metric):
    d = kernels.distances(x, x, metric)
    got = {(i, j): v for i, j, v in table(graph.pairs(points, metric), "i", "j", "d")}
    assert len(got) == 90 * 89 // 2 and all(v == pytest.approx(d[p], abs=1e-9) for p, v in got.items())
    near = {}
    for i, j, v in table(graph.nearest_neighbours(points, 4, metric=metric, block_rows=20), "i", "j", "d"):
        near.setdefault(i, []).append(v)
    assert all(sorted(v) == pytest.approx(np.sort(d[i])[:4], abs=1e-9) for i, v in near.items()) and len(near) == 90


def test_ties_go_to_the_lower_id(spark):
    p = frames.from_rows(spark, [[0.0], [1.0], [1.0], [-1.0]])
    assert table(graph.nearest_neighbours(p, 2).where("i = 0"), "j") == [(0,), (1,)]
    assert table(graph.nearest_neighbours(p, 2, include_self=False).where("i = 0"), "j") == [(1,), (2,)]


def test_knn_affinity(points, x):
    k = 5
    near = np.argsort(kernels.exact_squared(x, x), 1, kind="stable")[:, :k]
    a = np.zeros((90, 90))
    np.put_along_axis(a, near, 1, 1)
    a = (a + a.T) / 2
    got = graph.knn_affinity(points, k)
    assert {(i, j): v for i, j, v in table(got, "i", "j", "d")} == {(int(i), int(j)): a[i, j] for i, j in zip(*np.nonzero(a))}
    with pytest.raises(ValueError):
        graph.knn_affinity(points, 90)
    stats = graph.sparse_stats(got, 90).first()
    assert (stats["nnz"], stats["min"], stats["max"]) == (int((a != 0).sum()), 0.0, 1.0) and stats["mean"] == pytest.approx(a.mean())
    assert graph.default_neighbours(90) == 6


def test_laplacian_and_components(spark, points, x):
    got = graph.laplacian(graph.rbf_affinity(points, 0.3))
    a = np.exp(-0.3 * kernels.exact_squared(x, x))
    np.fill_diagonal(a, 0)
    s = 1 / np.sqrt(a.sum(1))
    want = np.eye(90) - a * s[:, None] * s[None, :]
    assert all(v == pytest.approx(want[i, j], abs=1e-9) for i, j, v in table(got, "i", "j", "d"))
    nodes = spark.range(7)
    edges = spark.createDataFrame([(5, 6), (3, 5), (1, 0)], "i long, j long")
    for most in (0, 100):
        assert table(graph.components(nodes, edges, most), "id", "component") == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 2), (6, 2)]
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "i long, j long")
    assert graph.components(spark.range(61), path).select("component").distinct().count() == 1
    weak = spark.createDataFrame([(0, 1, 0.01), (1, 2, 0.011)], "i long, j long, d double")
    assert table(graph.affinity_components(weak), "id", "component") == [(0, 0), (1, 1), (2, 1)]
    lone = graph.laplacian(spark.createDataFrame([(0, 0, 1.0)], "i long, j long, d double"))
    assert table(lone, "i", "j", "d") == [(0, 0, 1.0)]


def test_spanning_forest_equals_kernel(points, x):
    want = sorted((i, j) for i, j, _ in kernels.spanning_tree(kernels.distances(x, x)))
    assert table(graph.spanning_forest(graph.pairs(points)), "i", "j") == want
    few = points.where("id < 14")
    assert table(graph.spanning_forest(graph.pairs(few), 0), "i", "j") == sorted((i, j) for i, j, _ in kernels.spanning_tree(kernels.distances(x[:14], x[:14])))


def test_kmeans_both_ways_agree(points, x):
    for metric in ("euclidean", "cosine"):
        est = KMeans(4, n_init=2, metric=metric, random_state=3)
        a, b = est.fit(points), est.fit(points, driver_values=0)
        assert a.inertia == pytest.approx(b.inertia) and np.allclose(a.centroids, b.centroids) and a.n_iter == b.n_iter
        assert table(a.labels(points), "id", "label") == table(b.labels(points), "id", "label")
    back = KMeansModel.from_json(a.to_json())
    assert (back.predict_array(x) == a.predict_array(x)).all() and back.predict_array(np.zeros((0, 3))).shape == (0,)
    with pytest.raises(ValueError):
        KMeans(91).fit(points)
    for bad in ({"n_clusters": 0}, {"n_clusters": 2, "metric": "l7"}, {"n_clusters": 2, "tol": -1}):
        with pytest.raises(ValueError):
            KMeans(**bad)


def test_kmeans_of_equal_points(spark):
    model = KMeans(3, random_state=0).fit(frames.from_rows(spark, [[1.0, 1.0]] * 5))
    assert model.inertia == 0 and model.centroids.tolist() == [[1.0, 1.0]] * 3


def test_partition_count_changes_nothing(points):
    est = KMeans(3, n_init=1, random_state=1)
    assert np.allclose(est.fit(points.repartition(1), 0).centroids, est.fit(points.repartition(7), 0).centroids)


def test_agglomerative(points, spark, x):
    model = Agglomerative(4, "average").fit(points)
    assert model.n_leaves_ == 90 and model.children_.shape == (89, 2) and model.merge_tree(spark).count() == 89
    labels = [r.label for r in model.labels(spark).orderBy("id").collect()]
    seen = list(dict.fromkeys(labels))
    assert seen == list(range(4))
    near = graph.pairs(points, both=True).unionByName(points.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d")))
    assert (Agglomerative(4, "average", "precomputed").fit(near).labels_ == model.labels_).all()
    assert model.compute_medoids(points).count() == 4
    from galaxis.operators.hierarchy import single_linkage_components

    cut = Agglomerative(None, "single", distance_threshold=1.5).fit_array(x).labels_
    got = [v for _, v in table(single_linkage_components(points, 1.5), "id", "label")]
    assert got == cut.tolist()
    assert Agglomerative(1).fit_array(x[:1]).labels_.tolist() == [0]
    for bad in ({"n_clusters": None}, {"n_clusters": 2, "distance_threshold": 1.0}, {"linkage": "ward", "metric": "cosine"}):
        with pytest.raises(ValueError):
            Agglomerative(**bad)


def test_hdbscan_both_ways_agree(points, spark):
    est = HDBSCAN(6, min_samples=4)
    a, b = est.fit(points), est.fit(points, most=10)
    assert np.allclose(np.sort(a.tree[:, 2]), np.sort(b.tree[:, 2])) and (a.labels_ == b.labels_).mean() > 0.97
    assert set(a.exemplar_indices_) == set(a.labels_.tolist()) - {-1}
    assert a.result(spark).count() == 90 and a.condensed_tree(spark).where("parent = 90").count() > 0
    assert HDBSCAN().fit_array(np.zeros((1, 2))).labels_.tolist() == [-1]
    assert set(HDBSCAN(50).fit(points).labels_.tolist()) == {-1}


def test_spectral(points, spark, x):
    for affinity, extra in (("rbf", {"gamma": 0.5}), ("nearest_neighbors", {"n_neighbors": 8}), ("cosine", {})):
        model = Spectral(4, affinity, random_state=1, capture_debug_info=True, **extra).fit(points)
        assert model.labels(spark).count() == 90 and model.debug_info["affinity_stats"]["nnz"] > 0
    frame, array = (f(arg).labels_ for f, arg in ((Spectral(4, "nearest_neighbors", n_neighbors=8, random_state=1).fit, points), (Spectral(4, "nearest_neighbors", n_neighbors=8, random_state=1).fit_array, x)))
    assert len(set(zip(frame.tolist(), array.tolist(), strict=True))) == 4
    own = Spectral(4, lambda m: np.exp(-0.5 * kernels.exact_squared(m, m)), random_state=1).fit_array(x).labels_
    pre = Spectral(4, "precomputed", random_state=1).fit_array(np.exp(-0.5 * kernels.exact_squared(x, x))).labels_
    assert (own == pre).all()
    assert Spectral(3, use_validation=True, validation_attempts=3, random_state=0).fit_array(x).labels_.shape == (90,)
    assert Spectral(3, intensive_parameter_sweep=True, gamma_range=(0.1,), random_state=0).fit_array(x[:40]).sweep["gamma"] == 0.1
    assert Spectral(4, "nearest_neighbors", n_neighbors=8, random_state=1).fit(points).compute_medoids(points).count() == 4
    for bad in (lambda: Spectral(2, gamma=-1), lambda: Spectral(2, "cosine", gamma=1), lambda: Spectral(91).fit(points), lambda: Spectral(2, max_samples=5).fit(points), lambda: Spectral(2, "precomputed").fit_array(np.zeros((3, 3)))):
        with pytest.raises(ValueError):
            bad()


def test_validation(spark, points, x):
    labels = KMeans(4, random_state=0).fit_array(x).labels_array(x)
    frame = frames.from_labels(spark, labels)
    assert validation.silhouette_score(points, frame) == pytest.approx(score(x, labels, "silhouette"))
    assert validation.davies_bouldin(points, frame) == pytest.approx(-score(x, labels, "davies-bouldin"))
    assert validation.calinski_harabasz(points, frame) == pytest.approx(score(x, labels, "calinski-harabasz"))
    assert validation.wss(points, frame) == pytest.approx(selection.within_sum(x, labels))
    subset = points.select("id").where("id < 30")
    some = validation.silhouette_samples(points, frame, block_rows=16).where("id < 30").agg(F.avg("silhouette")).first()[0]
    assert validation.silhouette_score_subset(points, frame, subset) == pytest.approx(some)


def test_validation_edges(spark):
    p = frames.from_rows(spark, [[0.0], [1.0], [5.0], [6.0]])
    noise, mixed, single = (frames.from_labels(spark, v) for v in ([-1] * 4, [-1, 0, 0, 0], [0, 0, 0, 0]))
    with pytest.raises(ValueError):
        validation.silhouette_samples(p, noise)
    with pytest.raises(ValueError):
        validation.silhouette_samples(p, single)
    assert {r.silhouette for r in validation.silhouette_samples(p, mixed).collect()} == {0.0}
    assert validation.davies_bouldin(p, noise) == validation.calinski_harabasz(p, noise) == 0.0
    with pytest.raises(ValueError):
        validation.davies_bouldin(p, single)
    alone = frames.from_labels(spark, [0, 1, 1, 1])
    assert validation.silhouette_samples(p, alone).where("id = 0").first()["silhouette"] == 0.0
    equal = frames.from_rows(spark, [[0.0], [0.0], [1.0], [1.0]])
    pairs = frames.from_labels(spark, [0, 0, 1, 1])
    assert validation.calinski_harabasz(equal, pairs) == math.inf
    assert validation.davies_bouldin(frames.from_rows(spark, [[0.0], [2.0], [0.0], [2.0]]), pairs) == math.inf
    assert validation.wss(p, noise) == pytest.approx(26.0)
    assert validation.silhouette_score_subset(p, frames.from_labels(spark, [-1, 0, 1, 1]), p.select("id").where("id = 0")) == 0.0
    with pytest.raises(ValueError):
        validation.adjusted_rand_index(pairs, pairs.where("id < 3"))


def test_ari_and_nmi(spark):
    a, b = frames.from_labels(spark, [0, 0, 1, 1]), frames.from_labels(spark, [5, 5, 3, 3])
    c, one = frames.from_labels(spark, [0, 1, 0, 1]), frames.from_labels(spark, [2, 2, 2, 2])
    assert validation.adjusted_rand_index(a, b) == 1.0 and validation.adjusted_rand_index(a, c) == pytest.approx(-0.5)
    assert validation.adjusted_rand_index(one, one) == 1.0 and validation.adjusted_rand_index(a, one) == 0.0
    for average in ("arithmetic", "geometric", "min", "max"):
        assert validation.normalized_mutual_info(a, b, average) == pytest.approx(1.0)
        assert validation.normalized_mutual_info(a, c, average) == pytest.approx(0.0)
    assert validation.normalized_mutual_info(one, one) == 1.0 and validation.normalized_mutual_info(a, one) == 0.0


def test_medoids(spark):
    p = frames.from_rows(spark, [[0.0], [2.0], [10.0], [50.0]])
    got = table(select_medoids(p, frames.from_labels(spark, [0, 0, 2, -1]), 3), "cluster", "id", "distance")
    assert got == [(0, 0, 1.0), (1, -1, math.inf), (2, 2, 0.0)]


def test_pca(points, x):
    model = PCA(3).fit(points)
    assert np.allclose(np.cov(x.T) @ model.components_[0], model.explained_variance_[0] * model.components_[0])
    back = frames.matrix(model.inverse_transform(model.transform(points)))[1]
    assert np.allclose(back, x)
    again = PCAModel.from_json(model.to_json())
    assert np.allclose(again.components_, model.components_)
    with pytest.raises(NotImplementedError):
        PCA(2).fit_predict(points)
    with pytest.raises(ValueError):
        PCA(4).fit(points)


def test_som(points, spark, x):
    for start in ("random", "linear", "pca"):
        for kind in ("gaussian", "bubble", "mexican_hat"):
            s = som.SOM(4, 3, topology="hexagonal", neighborhood=kind, initialization=start, num_epochs=3, random_state=2).fit(points)
            assert s.weights().shape == (3, 4, 3) and len(s.errors_) <= 3
    s = som.SOM(4, 3, num_epochs=20, random_state=2).fit(points)
    assert s.quantization_error() < 6 and 0 <= s.topographic_error(points) <= 1
    assert som.hit_map(s, points).agg(F.sum("hits")).first()[0] == 90
    assert som.density_map(s, points, 0).agg(F.sum("density")).first()[0] == 90
    assert s.cluster(points, 3).select("label").distinct().count() <= 3
    assert (som.neighbour_distances(s) == s.u_matrix()).all()
    again = som.SOM.from_json(s.to_json())
    assert table(again.predict(points), "id", "label") == table(s.predict(points), "id", "label")
    other = som.SOM(4, 3)
    other.load_state(s.save_state())
    assert (other.weights() == s.weights()).all() and som.export_map(s, "csv").count("\n") == 13
    before = s.weights().copy()
    assert not (s.fit_array(x).weights() == before).all()  # it goes on from its weights
    fixed = som.SOM(2, 2, initial_weights=np.zeros((2, 2, 3)))
    with pytest.raises(ValueError):
        fixed.weights()
    with pytest.raises(ValueError):
        som.SOM(2, 2, initial_weights=np.zeros((3, 2, 3)))
    act = som.activation_map(s, s.weights()[1, 1])
    assert act[1, 1] == 1.0 and act.min() == 0.0


def test_batch_som_by_partitions(points, x):
    a = som.SOM(3, 3, num_epochs=4, random_state=1).fit_batches(points)
    b = som.SOM(3, 3, num_epochs=4, random_state=1).fit_batches(points.repartition(1))
    assert np.allclose(a.weights(), b.weights()) and np.allclose(a.errors_, b.errors_)


def test_online_som(points, x):
    s = som.SOM(3, 3, random_state=1)
    with pytest.raises(ValueError):
        s.partial_fit(points)
    s.process_stream(points)
    assert s.total_samples_learned == 90 and s.streaming_stats()["latest_quantization_error"] == 0.0
    with pytest.raises(ValueError):
        s.partial_fit_array(np.zeros((2, 5)))
    with pytest.raises(ValueError):
        s.process_stream(points, auto_train=False)
    with pytest.raises(ValueError):
        s.quantization_error()
    kept = som.SOM(3, 3, random_state=1, keep_streaming_schedule=True)
    kept.process_stream(points)
    assert kept.streaming_stats()["current_learning_rate"] == pytest.approx(0.5 * math.exp(-0.09 / 100))


def test_find_optimal_clusters(x):
    k, found = selection.find_optimal_clusters(x, (2, 7), params={"random_state": 0})
    assert k == 4 and [e.combined_score for e in found] == sorted((e.combined_score for e in found), reverse=True)
    assert selection.find_optimal_clusters(x, (2, 7), method="silhouette", algorithm="agglomerative")[0] == 4
    assert selection.find_optimal_clusters(x, (2, 7), method="elbow", params={"random_state": 0})[0] in (3, 4)
    assert selection.find_optimal_clusters(x, (2, 5), scoring=lambda e: -e.k)[0] == 2
    assert selection.find_optimal_clusters(x, (2, 5), algorithm="som", params={"random_state": 0, "num_epochs": 5})[0] >= 2
    fixed = selection.find_optimal_clusters(x, (2, 4), params={"n_clusters": 3, "random_state": 0})[1]
    assert {len(np.unique(e.labels)) for e in fixed} == {3}
    for bad in ({"algorithm": "dbscan"}, {"method": "gap"}, {"algorithm": "agglomerative", "params": {"distance_threshold": 1.0}}, {"k_range": (5, 3)}):
        with pytest.raises(ValueError):
            selection.find_optimal_clusters(x, **bad)
    flat = [selection.Evaluation(2, None, 0.0, math.inf, math.inf), selection.Evaluation(3, None, 0.0, 1.0, 5.0)]
    selection.combine(flat)
    assert flat[0].combined_score == pytest.approx((0.5 + 1.0 + 0.0) / 3) and flat[1].combined_score == pytest.approx((0.5 + 0.5 + 0.5) / 3)


def test_datasets(spark):
    a, labels = datasets.blob_arrays(10, 2, 3, random_state=1)
    assert a.shape == (10, 2) and np.bincount(labels).tolist() == [4, 3, 3]
    rows = datasets.make_blobs(spark, 1000, 3, 4, 0.1, 2)
    assert rows.groupBy("label").count().count() == 4 and frames.shape(rows.select("id", "features")) == (1000, 3)
    x, y = datasets.demo_blobs(20, 3, 4)
    assert x.shape == (20, 3) and y.tolist()[:5] == [0, 1, 2, 3, 0] and (datasets.demo_blobs(20, 3, 4)[0] == x).all()
    for name in datasets.TOYS:
        t = datasets.toy_array(name)
        assert t.shape == (300, 2) and np.allclose(t.mean(0), 0) and np.allclose(t.std(0), 1)
    s = frames.matrix(datasets.standardize(frames.from_rows(spark, [[1.0, 5.0], [3.0, 5.0]])))[1]
    assert s.tolist() == [[-1.0, 0.0], [1.0, 0.0]]


def test_vector_expressions(spark):
    f = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = f.select(vectors.euclidean("a", "b").alias("e"), vectors.manhattan("a", "b").alias("m"), vectors.cosine("a", "b").alias("c"), vectors.cosine_plain("a", "b").alias("p"), vectors.normalized("a").alias("n"), vectors.normalized("b").alias("z"), vectors.inverse(F.lit(0.0)).alias("i")).first()
    assert (r.e, r.m, r.c, r.p, r.n, r.z, r.i) == (5.0, 7.0, 1.0, 0.0, [0.6, 0.8], [0.0, 0.0], math.inf)
    with pytest.raises(ValueError):
        vectors.distance("a", "b", "l7")
