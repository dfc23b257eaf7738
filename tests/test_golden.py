"""Stored results of public implementations: folders of JSON files named by GALAXIS_GOLDEN, if it is set."""

import json
import os
from pathlib import Path

import numpy as np
import pytest

from galaxis.functions import kernels
from galaxis.operators.hierarchy import HDBSCAN, Agglomerative
from galaxis.operators.kmeans import KMeans
from galaxis.operators.pca import PCA
from galaxis.operators.spectral import Spectral
from galaxis.sources import frames

ROOT = os.environ.get("GALAXIS_GOLDEN")
pytestmark = pytest.mark.skipif(not ROOT, reason="GALAXIS_GOLDEN is not set")


def cases(kind):
    return [pytest.param(json.loads(p.read_text()), id=p.stem) for p in sorted(Path(ROOT or "/nonexistent").glob(f"{kind}.json"))] or [pytest.param(None, marks=pytest.mark.skip)]


def same(a, b):
    """Equal up to a renaming of labels, noise staying noise."""
    pairs = set(zip(np.asarray(a).tolist(), np.asarray(b).tolist(), strict=True))
    return len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}) and all((x == -1) == (y == -1) for x, y in pairs)


def agreement(a, b):
    """Share of points under the best greedy renaming."""
    a, b = np.asarray(a), np.asarray(b)
    counts = sorted(((np.sum((a == x) & (b == y)), x, y) for x in set(a.tolist()) for y in set(b.tolist()) if (x == -1) == (y == -1)), reverse=True)
    used_a, used_b, total = set(), set(), 0
    for n, x, y in counts:
        if x not in used_a and y not in used_b:
            used_a.add(x)
            used_b.add(y)
            total += n
    return total / len(a)


def ari(a, b):
    t = np.array([[np.sum((np.asarray(a) == x) & (np.asarray(b) == y)) for y in set(b)] for x in set(a)])
    c = lambda n: (n * (n - 1) / 2).sum()
    i, x, y, m = c(t), c(t.sum(1)), c(t.sum(0)), len(a) * (len(a) - 1) / 2
    return (i - x * y / m) / ((x + y) / 2 - x * y / m)


@pytest.mark.parametrize("g", cases("agglomerative/[!m]*"))
def test_agglomerative(g):
    p = g["params"]
    assert same(Agglomerative(p["n_clusters"], p["linkage"], p["metric"]).fit_array(np.array(g["X"])).labels_, g["labels"])


@pytest.mark.parametrize("g", cases("kmeans/*"))
def test_kmeans(g):
    p = g["params"]
    model = KMeans(p["n_clusters"], metric=p.get("metric") or "euclidean", random_state=p["random_state"]).fit_array(np.array(g["X"]))
    assert same(model.labels_array(np.array(g["X"])), g["labels"])
    assert same(model.predict_array(np.array(g["x_test"])), g["predict_labels"])
    if model.params.metric == "euclidean":
        assert model.inertia == pytest.approx(g["inertia_"], rel=1e-3)


@pytest.mark.parametrize("g", cases("spectral/[!e]*"))
def test_spectral(g):
    p = g["params"]
    extra = {k: p[k] for k in ("gamma", "n_neighbors") if p.get(k) is not None}
    got = Spectral(p["n_clusters"], p["affinity"], random_state=p["random_state"], **extra).fit_array(np.array(g["X"])).labels_
    assert ari(got.tolist(), g["labels"]) >= (0.75 if (p["affinity"], p["n_clusters"], p.get("gamma")) == ("rbf", 3, 0.1) else 0.95)


@pytest.mark.parametrize("g", cases("spectral/embedding_*"))
def test_spectral_embedding(g):
    p = g["params"]
    got = Spectral(p["n_clusters"], p["affinity"], gamma=p["gamma"], random_state=p["random_state"]).fit_with_intermediate_steps(np.array(g["X"]))
    want = np.array(g["embedding"])
    # Equal eigenvalues leave the axes open, but not what they span.
    fit = got["embedding"] @ np.linalg.lstsq(got["embedding"], want, rcond=None)[0]
    assert np.abs(fit - want).max() < 1e-2
    assert np.abs(got["eigenvalues"] - np.array(g["eigenvalues"])[: len(got["eigenvalues"])]).max() < 1e-2


@pytest.mark.parametrize("g", cases("hdbscan/*"))
def test_hdbscan(g):
    p = g["params"]
    got = HDBSCAN(p["min_cluster_size"], p.get("min_samples"), p["metric"], p["cluster_selection_method"], p["cluster_selection_epsilon"]).fit_array(np.array(g["X"]))
    if g["tie_free"]:
        assert same(got.labels_, g["labels"])
        assert np.abs(got.probabilities_ - np.array(g["probabilities"])).max() < 1.5e-4
    else:
        assert agreement(got.labels_, g["labels"]) >= 0.94
        assert np.abs(got.probabilities_ - np.array(g["probabilities"])).mean() <= 0.18


@pytest.mark.parametrize("g", cases("hdbscan/*"))
def test_tail_on_a_stored_hierarchy(g):
    p = g["params"]
    tree = np.array(g["single_linkage_tree"])
    c = kernels.condense(tree, p["min_cluster_size"])
    chosen = kernels.select_clusters(c, p["cluster_selection_method"], p["cluster_selection_epsilon"])
    labels, prob, _ = kernels.label_points(c, chosen) if chosen and chosen != [c.n] else (np.full(c.n, -1), np.zeros(c.n), {})
    assert same(labels, g["labels"])
    assert np.abs(prob - np.array(g["probabilities"])).max() < 1e-6


@pytest.mark.parametrize("g", cases("density/mst_*"))
def test_spanning_tree(g):
    x = np.array(g["X"])
    edges = kernels.spanning_tree(kernels.distances(x, x))
    assert sum(e[2] for e in edges) == pytest.approx(g["total_weight"], abs=1e-9)
    assert sorted(round(e[2], 9) for e in edges) == sorted(round(e[2], 9) for e in g["edges"])


@pytest.mark.parametrize("g", cases("density/mreach_*"))
def test_mutual_reachability(g, spark):
    from galaxis.operators import graph

    points = frames.from_rows(spark, g["X"])
    got = graph.mutual_reachability(graph.pairs(points, both=True), graph.core_distances(points, g["k"]))
    out = frames.square(got, zero_diagonal=False)[1]
    assert np.abs(out - np.array(g["mutual_reachability"])).max() < 1e-9


@pytest.mark.parametrize("g", cases("pairwise/cosine"))
def test_cosine(g):
    x = np.array(g["X"])
    assert np.abs(kernels.distances(x, x, "cosine") - np.array(g["cosine_distances"])).max() < 1e-4


@pytest.mark.parametrize("g", cases("pca/*"))
def test_pca(g, spark):
    points = frames.from_rows(spark, g["X"])
    model = PCA(g["n_components"]).fit(points)
    assert np.abs(model.mean_ - np.array(g["mean_"])).max() < 1e-5
    assert np.abs(model.explained_variance_ - np.array(g["explained_variance_"])).max() < 1e-5
    got = frames.matrix(model.transform(points))[1]
    for k, c in enumerate(g["components_"]):
        sign = np.sign(model.components_[k] @ np.array(c))
        assert np.abs(model.components_[k] * sign - np.array(c)).max() < 1e-5
        assert np.abs(got[:, k] * sign - np.array(g["transform"])[:, k]).max() < 1e-5


@pytest.mark.parametrize("g", cases("agglomerative/medoids_*"))
def test_medoids(g, spark):
    from galaxis.operators.medoids import select_medoids

    p = g["params"]
    got = select_medoids(frames.from_rows(spark, g["X"]), frames.from_labels(spark, g["labels"]), p["n_clusters"], p["metric"]).orderBy("cluster").collect()
    assert [r.id for r in got] == g["medoid_indices"]
