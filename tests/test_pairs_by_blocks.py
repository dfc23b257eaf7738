"""Work on all pairs by blocks: each query as over joined pairs, and estimators beyond one matrix as within one."""

import numpy as np
import pytest

from galaxis.functions import kernels
from galaxis.operators import graph, hierarchy, spectral
from galaxis.operators.hierarchy import HDBSCAN, Agglomerative
from galaxis.plans import registry
from galaxis.sources import frames


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Embeddings with equal rows and with a pair close together far from 0."""
    x = np.random.default_rng(3).normal(0.1, 0.3, (90, 6)).round(2)
    x[7], x[8], x[9] = x[3], x[3], x[9] + 100
    x[10] = x[9] + 1e-5
    path = tmp_path_factory.mktemp("tables")
    rows = [(k * 3 % 101, r.tolist(), k % 4) for k, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture
def small(monkeypatch):
    """Blocks of 16 points, and no joined pairs."""
    monkeypatch.setattr(graph.tiles, "__defaults__", (False, 16))
    for f, at in ((graph.summed_pairs, -1), (graph.nearest_neighbours, -1), (graph.pair_forest, -2)):
        values = list(f.__defaults__)
        values[at] = 16
        monkeypatch.setattr(f, "__defaults__", tuple(values))

    def refused(*_, **__):
        raise AssertionError("pairs are joined")

    monkeypatch.setattr(graph, "pairs", refused)


def as_duckdb(spark, path, name):
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    frame = registry.QUERIES[name](spark, path)
    columns = sorted(frame.columns)
    got = sorted(map(tuple, frame.select(*columns).collect()))
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall())
    assert len(got) == len(want) > 0
    np.testing.assert_allclose(np.array(got, float), np.array(want, float), rtol=0, atol=2e-6)


def test_pairwise_euclidean(spark, tables, small):
    as_duckdb(spark, tables, "pairwise_euclidean")


def test_pairwise_cosine(spark, tables, small):
    as_duckdb(spark, tables, "pairwise_cosine")


def test_pairwise_manhattan(spark, tables, small):
    as_duckdb(spark, tables, "pairwise_manhattan")


def test_rbf_affinity_degree(spark, tables, small):
    as_duckdb(spark, tables, "rbf_affinity_degree")


def test_cosine_affinity_degree(spark, tables, small):
    as_duckdb(spark, tables, "cosine_affinity_degree")


def test_normalized_laplacian(spark, tables, small):
    as_duckdb(spark, tables, "normalized_laplacian")


def test_mutual_reachability(spark, tables, small):
    as_duckdb(spark, tables, "mutual_reachability")


def test_connected_components(spark, tables, small):
    as_duckdb(spark, tables, "connected_components")


def test_component_indicators(spark, tables, small):
    as_duckdb(spark, tables, "component_indicators")


def test_single_linkage_threshold(spark, tables, small):
    as_duckdb(spark, tables, "single_linkage_threshold")


def test_hdbscan_by_blocks(spark, tables, small):
    points = frames.points(spark.read.parquet(f"{tables}/embeddings.parquet"), "vec_id", "embedding")
    a, b = HDBSCAN(4).fit(points, most=1000), HDBSCAN(4).fit(points, most=10)
    np.testing.assert_allclose(a.tree[:, 2], b.tree[:, 2], rtol=1e-12)  # equal weights have several trees


def test_forest_kernels():
    x = np.random.default_rng(0).normal(size=(40, 3))
    d = kernels.distances(x[:25], x[25:])
    i, j = np.indices(d.shape).reshape(2, -1)
    kept = kernels.forest(40, i, j + 25, d.ravel())
    assert {(i[k], j[k]) for k in kept} == set(zip(*kernels.cross_tree(d), strict=True)) and len(kept) == 39
    np.testing.assert_allclose(kernels.refined_squared(x + 1e4, x + 1e4), kernels.exact_squared(x + 1e4, x + 1e4), rtol=1e-9)


def test_agglomerative_single_beyond_one_matrix(spark, tables, small, monkeypatch):
    points = frames.points(spark.read.parquet(f"{tables}/embeddings.parquet"), "vec_id", "embedding")
    want = Agglomerative(6, "single").fit(points)
    monkeypatch.setattr(hierarchy, "MOST_POINTS", 10)  # 90 points were refused beyond it
    monkeypatch.setattr(Agglomerative.fit, "__defaults__", (10,))
    got = Agglomerative(6, "single").fit(points)
    assert (got.labels_ == want.labels_).all() and (got.ids == want.ids).all()
    np.testing.assert_allclose(got.distances_, want.distances_, rtol=1e-9, atol=1e-12)


def test_agglomerative_threshold_beyond_one_matrix(spark, tables, small, monkeypatch):
    points = frames.points(spark.read.parquet(f"{tables}/embeddings.parquet"), "vec_id", "embedding")
    want = Agglomerative(None, "single", distance_threshold=0.5).fit(points)
    monkeypatch.setattr(hierarchy, "MOST_POINTS", 10)  # 90 points were refused beyond it
    monkeypatch.setattr(Agglomerative.fit, "__defaults__", (10,))
    got = Agglomerative(None, "single", distance_threshold=0.5).fit(points)
    assert (got.labels_ == want.labels_).all() and (got.ids == want.ids).all()
    np.testing.assert_allclose(got.distances_, want.distances_, rtol=1e-9, atol=1e-12)


def test_agglomerative_ward_beyond_one_matrix(spark, tables, small, monkeypatch):
    points = frames.points(spark.read.parquet(f"{tables}/embeddings.parquet"), "vec_id", "embedding")
    want = Agglomerative(6, "ward").fit(points)
    monkeypatch.setattr(hierarchy, "MOST_POINTS", 10)  # 90 points were refused beyond it
    monkeypatch.setattr(Agglomerative.fit, "__defaults__", (10,))
    got = Agglomerative(6, "ward").fit(points)
    assert (got.labels_ == want.labels_).all() and (got.ids == want.ids).all()
    np.testing.assert_allclose(got.distances_, want.distances_, rtol=1e-9, atol=1e-12)


def test_agglomerative_complete_beyond_one_matrix(spark, tables, small, monkeypatch):
    points = frames.points(spark.read.parquet(f"{tables}/embeddings.parquet"), "vec_id", "embedding")
    want = Agglomerative(6, "complete").fit(points)
    monkeypatch.setattr(hierarchy, "MOST_POINTS", 10)  # 90 points were refused beyond it
    monkeypatch.setattr(Agglomerative.fit, "__defaults__", (10,))
    got = Agglomerative(6, "complete").fit(points)
    assert (got.labels_ == want.labels_).all() and (got.ids == want.ids).all()
    np.testing.assert_allclose(got.distances_, want.distances_, rtol=1e-9, atol=1e-12)


def test_agglomerative_average_beyond_one_matrix(spark, tables, small, monkeypatch):
    points = frames.points(spark.read.parquet(f"{tables}/embeddings.parquet"), "vec_id", "embedding")
    want = Agglomerative(6, "average").fit(points)
    monkeypatch.setattr(hierarchy, "MOST_POINTS", 10)  # 90 points were refused beyond it
    monkeypatch.setattr(Agglomerative.fit, "__defaults__", (10,))
    got = Agglomerative(6, "average").fit(points)
    assert (got.labels_ == want.labels_).all() and (got.ids == want.ids).all()
    np.testing.assert_allclose(got.distances_, want.distances_, rtol=1e-9, atol=1e-12)


def test_agglomerative_merge_tree_beyond_one_matrix(spark, tables, small, monkeypatch):
    points = frames.points(spark.read.parquet(f"{tables}/embeddings.parquet"), "vec_id", "embedding")
    want = Agglomerative(2, "complete").fit(points).merge_tree(spark).collect()
    monkeypatch.setattr(hierarchy, "MOST_POINTS", 10)
    monkeypatch.setattr(Agglomerative.fit, "__defaults__", (10,))
    got = Agglomerative(2, "complete").fit(points).merge_tree(spark).collect()
    assert len(got) == 89
    rest = [r.distance > 0 for r in want]  # equal points have several orders
    assert [r[1:3] + (round(r[3], 9), r[4]) for r, k in zip(got, rest, strict=True) if k] == [r[1:3] + (round(r[3], 9), r[4]) for r, k in zip(want, rest, strict=True) if k]


def test_agglomerative_precomputed_beyond_one_matrix(spark, tables, monkeypatch):
    want = registry.QUERIES["agglomerative_precomputed"](spark, tables).collect()
    monkeypatch.setattr(hierarchy, "MOST_POINTS", 10)
    monkeypatch.setattr(frames.square, "__defaults__", (1e-8, True, 100))
    monkeypatch.setattr(Agglomerative.fit, "__defaults__", (10,))
    assert registry.QUERIES["agglomerative_precomputed"](spark, tables).collect() == want


def spread_as_matrix(spark, tables, **params):
    from galaxis.operators.spectral import Spectral

    x = np.random.default_rng(5).normal(0, 0.15, (120, 5)) + np.repeat(np.eye(4, 5) + 0.2, 30, 0)
    points = frames.from_rows(spark, x)
    want = Spectral(4, n_init=3, random_state=1, capture_debug_info=True, **params).fit(points)
    got = Spectral(4, n_init=3, random_state=1, capture_debug_info=True, **params).fit(points, most=10)
    assert (got.labels_ == want.labels_).all()
    np.testing.assert_allclose(got.embedding_, want.embedding_, atol=1e-6)
    a, b = (m.debug_info["affinity_stats"] for m in (got, want))
    assert a["nnz"] == b["nnz"] and abs(a["mean"] - b["mean"]) < 1e-9 and abs(a["min"] - b["min"]) < 1e-6
    assert Spectral(2, **params).max_samples is None  # 10,000 before, which refused more


def test_spectral_rbf_beyond_one_matrix(spark, tables, small):
    spread_as_matrix(spark, tables, affinity="rbf", gamma=1.0)


def test_spectral_cosine_beyond_one_matrix(spark, tables, small):
    spread_as_matrix(spark, tables, affinity="cosine")


@pytest.mark.parametrize("rows", [16, 23, 200])
def test_knn_affinity_stats_pairs_of_blocks_meet_once(spark, tables, rows):
    points = frames.points(spark.read.parquet(f"{tables}/embeddings.parquet"), "vec_id", "embedding")
    met = [(r.b, r.b2) for r in graph.tiles(points, block_rows=rows).select("b", "b2").collect()]
    half = [tuple(sorted(r)) for r in graph.tiles(points, True, rows).select("b", "b2").collect()]
    assert len(met) == len(set(met)) and len(half) == len(set(half)) and set(half) == {tuple(sorted(m)) for m in met}


@pytest.mark.parametrize("name", ["knn_affinity_stats", "knn_graph"])
def test_knn_by_blocks(spark, tables, small, name):
    as_duckdb(spark, tables, name)


def test_spectral_validation_multiplies_each_vector_once():
    n, calls = 3000, []
    i = np.arange(n)
    near = [(i + s) % n for s in (1, -1, 37, -37, 411, -411)]

    def matvec(v):
        calls.append(1)
        return v - sum(v[j] for j in near) / 6

    values, vectors = kernels.smallest_eigenpairs((n, matvec), 3)
    assert len(calls) < 176  # 636 when images were computed twice and pairs sought anew
    assert np.linalg.norm(np.stack([matvec(v) for v in vectors.T], 1) - vectors * values, axis=0).max() < 1e-5


def counted(spark, near):
    """near, and an accumulator of the pairs that it was asked for."""
    count = spark.sparkContext.accumulator(0)

    def asked(x, y):
        count.add(len(x) * len(y))
        return near(x, y)

    return asked, count


@pytest.mark.parametrize(("scale", "below"), [(0.02, 0.15), (1.0, 0.5), (1.0, 1e-9), (1.0, 100.0)])
def test_agglomerative_threshold_components_in_rounds(spark, scale, below):
    rng = np.random.default_rng(2)
    x = rng.normal(0, scale, (300, 3)) + np.repeat(np.arange(3), [200, 90, 10])[:, None]
    x[7] = x[3]
    d = np.sqrt(kernels.exact_squared(x, x))
    want = graph.label_components(300, *np.nonzero(d < below))
    near, count = counted(spark, graph.below_mask("euclidean", below))
    ids, label = graph.near_labels(frames.from_rows(spark, x), near, first=16)
    assert (ids == np.arange(300)).all() and (label == want).all()
    if scale < 1:  # all pairs were compared before
        assert count.value < 300 * 299 / 2


def test_agglomerative_threshold_needs_no_tree(spark, tables, small, monkeypatch):
    points = frames.points(spark.read.parquet(f"{tables}/embeddings.parquet"), "vec_id", "embedding")
    want = Agglomerative(None, "single", distance_threshold=0.5).fit(points).labels(spark).collect()
    monkeypatch.setattr(Agglomerative.fit, "__defaults__", (10,))
    monkeypatch.setattr(Agglomerative.fit_predict, "__defaults__", (10,))
    monkeypatch.setattr(graph.near_labels, "__defaults__", (8,))
    monkeypatch.setattr(graph, "pair_forest", None)
    assert Agglomerative(None, "single", distance_threshold=0.5).fit_predict(points).collect() == want


def test_below_mask_is_exact_at_the_bound():
    x = np.random.default_rng(1).normal(size=(60, 5)).round(1) + 1e3
    d = kernels.distances(x, x)
    for below in (0.0, *np.unique(d)[[0, 1, 5, 400, 900]]):
        assert (graph.below_mask("euclidean", below)(x, x) == (d < below)).all()


@pytest.mark.parametrize("name", ["component_indicators", "connected_components"])
def test_component_indicators_in_rounds(spark, tables, monkeypatch, name):
    monkeypatch.setattr(graph.near_labels, "__defaults__", (8,))
    monkeypatch.setattr(graph, "pair_forest", None)
    as_duckdb(spark, tables, name)


@pytest.mark.parametrize("low", [1.0, 1e-1, 1e-5])
def test_spectral_cosine_multiplies_by_factors(spark, low):
    from galaxis.operators import spectral

    x = np.random.default_rng(4).normal(size=(50, 4)) * np.geomspace(low, 2, 50)[:, None]
    x[9] = 0
    a, found = 1 - kernels.distances(x, x, "cosine"), spectral.cosine_factors(x)
    if low == 1e-5:
        assert found is None  # the series would be too long
        return
    left, right, own = found
    np.testing.assert_allclose(left @ right.T, a, rtol=0, atol=1e-14)
    np.testing.assert_allclose(own, np.diag(a), rtol=0, atol=1e-14)
    np.fill_diagonal(a, 0)
    v = np.random.default_rng(5).normal(size=(50, 3))
    affinity = spectral.SpreadAffinity(frames.from_rows(spark, x), x, graph.cosine_value, found)
    assert affinity.sent is None
    np.testing.assert_allclose(affinity.product(v), a @ v, rtol=0, atol=1e-13)


@pytest.mark.parametrize("upper", [True, False])
def test_pairwise_cosine_by_pieces(spark, upper):
    x = np.random.default_rng(8).normal(size=(400, 3))
    large = spark.sparkContext.accumulator(0)

    def value(x, y):
        large.add(len(x) * len(y) > 1 << 17)  # a pair of blocks came at once before
        return 1 - x @ y.T

    got = {r.i: r for r in graph.summed_pairs(frames.from_rows(spark, x), value, upper).collect()}
    assert len(got) == 400 - upper and large.value == 0
    d = 1 - x @ x.T
    for i, r in got.items():
        some = np.arange(400) > i if upper else np.arange(400) != i
        assert r.n == some.sum()
        np.testing.assert_allclose((r.low, r.total, r.high), (d[i, some].min(), d[i, some].sum(), d[i, some].max()), rtol=1e-9)


def test_pairwise_manhattan_by_larger_values():
    rng = np.random.default_rng(6)
    for scale in (1.0, 1e3, 1e12):
        x = rng.normal(0, 1, (60, 7)) + scale
        x[5], x[6] = x[4], x[4] + 1e-7
        want = np.abs(x[:, None] - x[None, :]).sum(2)
        got = kernels.refined_manhattan(x, x)
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-10)
        assert got[4, 5] == 0 == got[7, 7]
    assert np.isnan(kernels.refined_manhattan(np.array([[np.nan]]), np.array([[1.0]]))).all()


def list_merged(x, kind, metric, t):
    """Merges by lists, and how many clusters were searched."""
    asked = []

    def clusters(home):
        order = np.argsort(home, kind="stable")
        names, starts = np.unique(home[order], return_index=True)
        return x[order], names, starts

    def listed(some, home):
        y, names, starts = clusters(home)
        asked.append(len(some))
        near, d, bound = kernels.ClusterSearch(y, starts, kind, metric).nearest(np.searchsorted(names, some), t)
        return np.where(near >= 0, names[near], -1), d, bound

    def exact(a, b, home):
        y, names, starts = clusters(home)
        return kernels.pair_linkage(y, starts, np.append(starts[1:], len(y)), np.searchsorted(names, a), np.searchsorted(names, b), kind, metric)

    found, _ = kernels.list_merges(np.ones(len(x), int), kind, listed, exact, 1, t)
    return kernels.ordered_merges(found, len(x)), sum(asked)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
@pytest.mark.parametrize("kind", ["complete", "average"])
def test_merges_by_lists_of_nearest_clusters(kind, metric):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((4, 12))
    far = np.concatenate([centers[k % 4] + rng.standard_normal(12) * 0.4 for k in range(500)]).reshape(-1, 12)
    near = far[:40].repeat(4, 0) + rng.standard_normal((160, 12)) * 1e-7  # below single precision
    for x in (far, near, far * 1e-3 + 100):
        if metric == "cosine" and x[0, 0] > 50:
            continue
        want = kernels.neighbour_chain(kernels.distances(x, x, metric, plain_cosine=True), kind)
        got, asked = list_merged(x, kind, metric, 16)
        assert np.allclose([m[2] for m in got], [m[2] for m in want], rtol=1e-9, atol=1e-12)
        assert [m[3] for m in got] == [m[3] for m in want] or x is near
        assert (kernels.cut(got, len(x), 5) == kernels.cut(want, len(x), 5)).all()
        assert asked < 3 * len(x)
    x = rng.integers(0, 3, (300, 3)).astype(float)  # equal distances have several trees
    got, _ = list_merged(x, kind, metric, 3)
    assert len(got) == 299 and got[-1][3] == 300


@pytest.mark.parametrize("kind", ["complete", "average"])
def test_large_clusters_are_searched_in_pieces(kind, monkeypatch):
    monkeypatch.setattr(kernels, "SEARCHED", 16)
    x, starts = np.random.default_rng(2).standard_normal((150, 5)), np.array([0, 40, 41, 60, 100, 103, 149])
    search = kernels.ClusterSearch(x, starts, kind, "euclidean")
    want = kernels.linkage_rows(x, starts, np.arange(7), kind, "euclidean")
    for k, row in search.rows(0, 7):
        assert np.allclose(row, want[k, k:])
    np.fill_diagonal(want, np.inf)
    near, d, bound = search.nearest(np.arange(7), 2)
    assert (near == np.argsort(want, 1)[:, :2]).all() and np.allclose(d, np.sort(want, 1)[:, :2])
    assert (bound <= np.sort(want, 1)[:, 2]).all()


def test_spectral_rbf_multiplies_by_tiles(spark):
    x = np.random.default_rng(3).standard_normal((1500, 4))
    quick = spectral.rbf_quick(0.5)

    def value(a, b):
        assert len(a) <= 512 and len(b) <= 1024
        return quick(a, b)

    affinity = spectral.SpreadAffinity(frames.from_rows(spark, x), x, value)
    a, v = quick(x, x), np.random.default_rng(4).standard_normal((1500, 3))
    np.fill_diagonal(a, 0)
    np.testing.assert_allclose(affinity.product(v), a @ v, rtol=0, atol=1e-10)
    affinity.close()
