import math

import numpy as np
import pytest

from galaxis.functions import kernels
from galaxis.functions.random import SeededStream
from galaxis.operators import som


def test_seeded_streams():
    """The locked sequences of the generator."""
    s = SeededStream(42)
    assert [s.uint32() for _ in range(8)] == [698305938, 3044292490, 3355001886, 4224722126, 3517469812, 864223061, 3864415249, 1160180227]
    s = SeededStream(123)
    assert [s.rand() for _ in range(3)] == [0.7838830193183882, 0.8498562332710481, 0.9340864610145109]
    s = SeededStream(7)
    assert [s.rand_int(1000) for _ in range(8)] == [689, 198, 161, 436, 698, 307, 10, 694]
    assert SeededStream(-1).uint32() == SeededStream(2**32 - 1).uint32()
    for bad in (0, -5, 1.5, 2**32 + 3):
        with pytest.raises(ValueError):
            SeededStream(1).rand_int(bad)
    assert sorted(SeededStream(3).permutation(50).tolist()) == list(range(50))


def test_distances_and_zero_vectors():
    x = np.array([[0.0, 0.0], [3.0, 4.0], [0.0, 5.0]])
    assert kernels.distances(x, x)[0].tolist() == [0, 5, 5]
    assert kernels.distances(x, x, "manhattan")[1].tolist() == [7, 0, 4]
    assert kernels.distances(x, x, "cosine")[0].tolist() == [1, 1, 1]
    assert kernels.distances(x, x, "cosine", plain_cosine=True)[0].tolist() == [0, 0, 0]


def test_spanning_tree_refuses_a_broken_graph():
    d = np.array([[0, 1, np.inf], [1, 0, np.inf], [np.inf, np.inf, 0]])
    with pytest.raises(ValueError):
        kernels.spanning_tree(d)


@pytest.mark.parametrize("kind", ["single", "complete", "average", "ward"])
def test_neighbour_chain_equals_plain_merging(kind):
    rng = np.random.RandomState(4)
    for n in (2, 5, 17):
        x = rng.standard_normal((n, 3))
        got = kernels.neighbour_chain(kernels.distances(x, x), kind)
        groups, d = {i: [i] for i in range(n)}, kernels.distances(x, x)
        size, dist = {i: 1 for i in range(n)}, {(i, j): d[i, j] for i in range(n) for j in range(i)}
        want = []
        for k in range(n - 1):
            (a, b), w = min(dist.items(), key=lambda e: e[1])
            want.append(w)
            new = n + k
            for c in groups:
                if c not in (a, b):
                    ac, bc = dist[max(a, c), min(a, c)], dist[max(b, c), min(b, c)]
                    dist[new, c] = float(kernels.linkage_update(kind, np.array(ac), np.array(bc), w, size[a], size[b], np.array(size[c])))
            size[new] = size[a] + size[b]
            groups[new] = groups.pop(a) + groups.pop(b)
            dist = {p: v for p, v in dist.items() if a not in p and b not in p}
        assert np.allclose([m[2] for m in got], want)
        assert got[-1][3] == n
        assert kernels.cut(got, n, 1).tolist() == [0] * n and kernels.cut(got, n, n).tolist() == list(range(n))


def test_threshold_is_strict():
    x = np.array([[0.0], [1.0], [3.0]])
    merges = kernels.neighbour_chain(kernels.distances(x, x), "single")
    assert kernels.cut(merges, 3, threshold=1.0).tolist() == [0, 1, 2]
    assert kernels.cut(merges, 3, threshold=1.5).tolist() == [0, 0, 1]


def test_condensed_tree_of_coincident_points():
    x = np.array([[0.0]] * 5 + [[10.0]] * 5 + [[50.0]])
    tree = kernels.single_linkage(kernels.spanning_tree(kernels.distances(x, x)), len(x))
    c = kernels.condense(tree, 3)
    labels, prob, exemplar = kernels.label_points(c, kernels.select_clusters(c))
    assert labels.tolist() == [0] * 5 + [1] * 5 + [-1] or labels.tolist() == [1] * 5 + [0] * 5 + [-1]
    assert prob.tolist() == [1.0] * 10 + [0.0] and sorted(exemplar.values()) == [0, 5]


def test_eigenpairs():
    rng = np.random.RandomState(0)
    m = rng.standard_normal((120, 120))
    m = m @ m.T
    want = np.linalg.eigvalsh(m)
    values, vectors = kernels.lanczos(m.__matmul__, 120, 4)
    assert np.allclose(values, want[:4], atol=1e-5)
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-8)
    top, axes = kernels.power_iteration(m, 2)
    assert np.allclose(top, want[::-1][:2], rtol=1e-3) and abs(axes[0] @ axes[1]) < 1e-2
    assert (kernels.fix_signs(np.array([[-2.0, 1.0], [1.0, -3.0]])) == np.array([[2.0, -1.0], [-1.0, 3.0]])).all()


def test_null_space_is_whole():
    lap = np.zeros((6, 6))
    for part in (slice(0, 3), slice(3, 6)):
        lap[part, part] = np.eye(3) - np.ones((3, 3)) / 3
    values, _ = kernels.smallest_eigenpairs(lap, 2)
    assert len(values) == 4 and np.allclose(values[:2], 0)


def test_knee():
    knee = kernels.find_knee(list(range(1, 11)), [1000 / k for k in range(1, 11)])
    assert knee.x == 3 and knee.index == 2
    assert kernels.find_knee([1, 2], [1, 2]).x is None
    assert kernels.find_knee([1, 2, 3], [5, 5, 5]).differences == [0.0] * 3
    assert kernels.find_knee([1, 2, 3, 4], [4, 3, 2, 1]).x is None


def test_grid_geometry():
    assert som.neighbours(0, 0, 3, 3) == [(0, 1), (1, 0), (1, 1)]
    for h, w in ((3, 4), (5, 5)):
        d = som.grid_distances(h, w, "hexagonal")
        for i in range(h * w):
            near = {a * w + b for a, b in som.neighbours(*divmod(i, w), h, w, "hexagonal")}
            assert near == {j for j in range(h * w) if math.isclose(d[i, j], 1)}
    assert som.decay_scheduler(0.5, "linear", 11)(10, 11) == pytest.approx(0.005)
    assert som.exponential_decay(1.0, 0.1, 0, 1) == 1.0
    with pytest.raises(ValueError):
        som.check_radius(0, 3, 3)
    assert not som.check_radius(4, 3, 3)


def test_sequential_trainer_pulls_the_best_neuron():
    initial = np.array([[[0.0], [1.0]], [[2.0], [3.0]]])
    got = som.train_sequential(np.array([[3.4]]), initial, neighborhood="bubble", learning_rate=0.5, sigma=0.5, iterations=1)
    assert got["weights"][1, 1, 0] == pytest.approx(3.2) and got["weights"][0, 0, 0] == 0.0
    assert got["labels"].tolist() == [3] and got["bmus"].tolist() == [[1, 1]]
    assert got["u_matrix"].max() == 1.0
    for topology in ("rectangular", "hexagonal"):
        for kind in ("gaussian", "mexican_hat"):
            out = som.train_sequential(np.random.RandomState(1).random_sample((30, 2)), np.random.RandomState(2).random_sample((3, 4, 2)), topology, kind, iterations=90)
            assert 0 <= out["topographic_error"] <= 1 and out["quantization_error"] < 0.6
