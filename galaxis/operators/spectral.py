"""Spectral clustering: affinity, components, normalised Laplacian, eigenvectors, K-Means.

Dense affinities of up to LOCAL_POINTS points are matrices on the driver. Larger rbf and cosine ones are never stored:
tasks multiply blocks of them with the vectors of a block Lanczos, or for cosine the driver multiplies by two matrices as
narrow as the points; components are found in rounds by tasks. The neighbour affinity is a frame of edges built
by blocks; its components are found by joins, and only its edges (k for each point at most, twice) come to the driver,
where Lanczos multiplies by them without a matrix.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from galaxis.functions import kernels
from galaxis.operators import graph, medoids
from galaxis.operators.kmeans import KMeans
from galaxis.sources import frames

AFFINITIES = ("rbf", "nearest_neighbors", "cosine", "precomputed")
METRICS = ("calinski-harabasz", "davies-bouldin", "silhouette")
#: Gammas of a sweep where none are given.
GAMMAS = (0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)
MOST_EDGES = 50_000_000
#: Points whose affinity is a matrix of the driver, and those of arrays, functions and sweeps, which need one.
LOCAL_POINTS, MOST_SAMPLES = 3000, 10_000
PRODUCT = T.StructType([T.StructField("low", T.LongType()), T.StructField("rows", T.BinaryType())])


def score(x: np.ndarray, labels: np.ndarray, metric: str) -> float:
    """A validation metric of an embedding on the driver, for which more is better."""
    names, place = np.unique(labels, return_inverse=True)
    n, k = len(x), len(names)
    if k < 2:
        return -math.inf
    sizes = np.bincount(place)
    means = np.stack([x[place == c].mean(0) for c in range(k)])
    if metric == "calinski-harabasz":
        within = ((x - means[place]) ** 2).sum()
        between = (sizes * ((means - x.mean(0)) ** 2).sum(1)).sum()
        return math.inf if within == 0 else (between / (k - 1)) / (within / max(1, n - k))
    if metric == "davies-bouldin":
        spread = np.array([np.sqrt(((x[place == c] - means[c]) ** 2).sum(1)).mean() if sizes[c] > 1 else 0.0 for c in range(k)])
        gap = kernels.distances(means, means)
        both = spread[:, None] + spread[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(gap > 0, both / gap, np.where(both > 0, np.inf, 0.0))
        np.fill_diagonal(ratio, -np.inf)
        return -float(ratio.max(1).mean())
    if metric == "silhouette":
        sums = kernels.distances(x, x) @ np.eye(k)[place]
        own = sizes[place]
        a = sums[np.arange(n), place] / np.maximum(1, own - 1)
        other = sums / sizes
        other[np.arange(n), place] = np.inf
        b = other.min(1)
        top = np.maximum(a, b)
        return float(np.where((own == 1) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1, top)).mean())
    raise ValueError(f"unknown metric {metric!r}")


class Affinity:
    """A symmetric affinity on the driver: a matrix, or edges (row, col, value)."""

    def __init__(self, matrix: np.ndarray | None = None, n: int = 0, edges: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.dense, self.n = matrix, len(matrix) if matrix is not None else n
        if matrix is None:
            order = np.lexsort((edges[1], edges[0]))
            self.row, self.col, self.value = (e[order] for e in edges)

    def total(self) -> float:
        return float(self.dense.sum() if self.dense is not None else self.value.sum())

    def components(self) -> np.ndarray:
        """Numbers of components over edges that connect, by their least node."""
        if self.dense is not None:
            i, j = np.nonzero(self.dense > graph.CONNECTS)
        else:
            some = self.value > graph.CONNECTS
            i, j = self.row[some], self.col[some]
        return graph.label_components(self.n, i, j)

    def laplacian(self) -> tuple[np.ndarray | tuple[int, Callable], np.ndarray]:
        """The normalised Laplacian as a matrix or an operator, and the inverse roots of degrees."""
        if self.dense is not None:
            a = self.dense.copy()
            np.fill_diagonal(a, 0)
            s = self._scale(a.sum(1))
            out = -a * s[:, None] * s[None, :]
            np.fill_diagonal(out, 1)
            return out, s
        off = self.row != self.col
        row, col, value = self.row[off], self.col[off], self.value[off]
        s = self._scale(np.bincount(row, value, self.n))
        weight = value * s[row] * s[col]
        return (self.n, lambda v: v - np.bincount(row, weight * v[col], self.n)), s

    @staticmethod
    def _scale(degree: np.ndarray) -> np.ndarray:
        return np.where(degree > 0, 1 / np.sqrt(np.where(degree > 0, degree, 1)), 1.0)

    def stats(self) -> dict:
        value = self.dense.ravel() if self.dense is not None else self.value
        nnz = int((value != 0).sum())
        zero = [0.0] if nnz < self.n * self.n else []
        return {"shape": (self.n, self.n), "nnz": nnz, "min": float(min([value.min(), *zero])), "max": float(max([value.max(), *zero])), "mean": float(value.sum() / self.n**2)}


class SpreadAffinity:
    """An affinity of all pairs of points, computed by tasks whenever it is used; 1 on the diagonal. value: a function of
    two matrices of rows. factors: those of a product that is the affinity, as by `cosine_factors`, if there are any."""

    def __init__(self, points: DataFrame, x: np.ndarray, value: Callable, factors: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.points, self.value, self.n, self.spark, self.factors = points, value, len(x), points.sparkSession, factors
        self.sent = self.spark.sparkContext.broadcast(x) if factors is None else None
        self.degree = self.product(np.ones((self.n, 1)))[:, 0]

    def product(self, v: np.ndarray, tile: tuple[int, int] = (512, 1024)) -> np.ndarray:
        """The affinity without its diagonal times a matrix, by tiles that stay in a core's cache."""
        if self.factors is not None:
            left, right, own = self.factors
            return left @ (right.T @ v) - own[:, None] * v
        n, value, sent = self.n, self.value, self.sent
        tasks = min(n, 4 * self.spark.sparkContext.defaultParallelism)
        vectors = self.spark.sparkContext.broadcast(v)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, v = sent.value, vectors.value
            for batch in batches:
                for task in batch.column("id").to_pylist():
                    low, high = task * n // tasks, (task + 1) * n // tasks
                    out = np.zeros((high - low, v.shape[1]))
                    for at in range(low, high, tile[0]):
                        end = min(high, at + tile[0])
                        for left in range(0, n, tile[1]):
                            right = min(n, left + tile[1])
                            a = value(x[at:end], x[left:right])
                            own = np.arange(max(at, left), min(end, right))
                            a[own - at, own - left] = 0
                            out[at - low : end - low] += a @ v[left:right]
                    yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([out.tobytes()], pa.binary())], names=PRODUCT.names)

        got = self.spark.range(0, tasks, 1, tasks).mapInArrow(run, PRODUCT).toArrow().sort_by("low")
        vectors.destroy()
        return np.concatenate([np.frombuffer(b.as_buffer()) for b in got.column("rows")]).reshape(v.shape)

    def total(self) -> float:
        return float(self.degree.sum()) + self.n

    def components(self) -> np.ndarray:
        value = self.value
        return graph.near_labels(self.points, lambda x, y: value(x, y) > graph.CONNECTS)[1]

    def laplacian(self) -> tuple[kernels.BlockOperator, np.ndarray]:
        s = Affinity._scale(self.degree)
        sizes = {} if self.factors is None else {"block": 16, "most": 128}  # products are cheap, vectors take memory
        return kernels.BlockOperator(self.n, lambda v: v - s[:, None] * self.product(s[:, None] * v), **sizes), s

    def close(self) -> None:
        if self.sent is not None:
            self.sent.destroy()

    def stats(self) -> dict:
        value = self.value
        got = graph.summed_pairs(self.points, value).agg({"low": "min", "high": "max"}).first()
        nnz = graph.summed_pairs(self.points, lambda x, y: (value(x, y) != 0).astype(float)).agg({"total": "sum"}).first()[0]
        return {"shape": (self.n, self.n), "nnz": int(nnz) + self.n, "min": min(got["min(low)"], 1.0), "max": max(got["max(high)"], 1.0), "mean": self.total() / self.n**2}


def rbf_quick(gamma: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def value(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = kernels.refined_squared(x, y)
        d *= -gamma
        return np.exp(d, out=d)

    return value


def cosine_factors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Two matrices whose product (left by right transposed) is the cosine affinity of all rows, and its diagonal: with
    unit rows u of lengths r it is u u' / (1 + eps / (r r')), a series in eps / (r r'). None where that converges slowly."""
    r = np.sqrt((x * x).sum(1))
    some = r > 0
    if not np.isfinite(r).all():
        return None
    u = x / np.where(some, r, 1)[:, None]
    root = np.where(some, math.sqrt(kernels.COSINE_EPS) / np.where(some, r, 1), 0)
    most, terms = float(root.max(initial=0)) ** 2, 1
    while most**terms > 1e-15:
        terms += 1
        if terms > 4:
            return None
    left = np.hstack([u * (root**k)[:, None] for k in range(terms)])
    return left, left * np.repeat([(-1.0) ** k for k in range(terms)], x.shape[1]), r * r / (r * r + kernels.COSINE_EPS)


@dataclass(frozen=True)
class Spectral:
    """affinity: one of AFFINITIES, or a function from a matrix of points to a matrix of affinities."""

    n_clusters: int
    affinity: str | Callable = "rbf"
    gamma: float | None = None
    n_neighbors: int | None = None
    n_init: int = 10
    random_state: int | None = None
    use_validation: bool = False
    validation_attempts: int = 20
    validation_metric: str = "calinski-harabasz"
    intensive_parameter_sweep: bool = False
    gamma_range: tuple[float, ...] | None = None
    capture_debug_info: bool = False
    max_samples: int | None = None

    def __post_init__(self) -> None:
        if int(self.n_clusters) != self.n_clusters or self.n_clusters < 1:
            raise ValueError("n_clusters must be a positive integer")
        if not callable(self.affinity) and self.affinity not in AFFINITIES:
            raise ValueError(f"affinity must be one of {AFFINITIES} or a function")
        if self.gamma is not None and (self.affinity != "rbf" or self.gamma <= 0):
            raise ValueError("gamma must be positive and goes with the rbf affinity only")
        if self.n_neighbors is not None and (self.affinity != "nearest_neighbors" or int(self.n_neighbors) != self.n_neighbors or self.n_neighbors < 1):
            raise ValueError("n_neighbors must be a positive integer and goes with the nearest_neighbors affinity only")
        if self.validation_metric not in METRICS or self.validation_attempts < 1 or self.n_init < 1:
            raise ValueError("unknown validation metric, or attempts that are not positive")

    def dense_affinity(self, x: np.ndarray) -> np.ndarray:
        if callable(self.affinity) or self.affinity == "precomputed":
            a = np.asarray(self.affinity(x) if callable(self.affinity) else x, float)
            if a.ndim != 2 or a.shape != (len(x), len(x)):
                raise ValueError("an affinity must be square, a row for each sample")
            if np.abs(a - a.T).max(initial=0) > 1e-6 or a.min(initial=0) < -1e-6:
                raise ValueError("an affinity must be symmetric and not negative")
            return a
        if self.affinity == "cosine":
            a = 1 - kernels.distances(x, x, "cosine")
        elif self.affinity == "rbf":
            a = np.exp(-(self.gamma if self.gamma is not None else 1 / x.shape[1]) * kernels.exact_squared(x, x))
        else:
            k = self.n_neighbors or graph.default_neighbours(len(x))
            if k >= len(x):
                raise ValueError("n_neighbors must be below the number of samples")
            near = np.argsort(kernels.exact_squared(x, x), 1, kind="stable")[:, :k]
            a = np.zeros((len(x), len(x)))
            np.put_along_axis(a, near, 1.0, 1)
            return (a + a.T) / 2
        np.fill_diagonal(a, 1)
        return a

    def embed(self, affinity: Affinity | SpreadAffinity, info: dict | None = None) -> np.ndarray:
        """Component indicators where there are components enough, and else the scaled eigenvectors."""
        label = affinity.components()
        count = int(label.max()) + 1
        if count > 1 and count >= self.n_clusters:
            out = np.zeros((affinity.n, count))
            out[np.arange(affinity.n), label] = 1 / np.sqrt(np.bincount(label))[label]
            spectrum, factors = np.zeros(count), np.ones(count)
        else:
            operator, s = affinity.laplacian()
            values, vectors = kernels.smallest_eigenpairs(operator, max(self.n_clusters, count))
            out = vectors[:, : self.n_clusters] * s[:, None]
            factors = values[: self.n_clusters]
            spectrum = kernels.smallest_eigenpairs(operator, min(10, affinity.n))[0][:10] if info is not None else values
        if info is not None:
            info |= {"affinity_stats": affinity.stats(), "laplacian_spectrum": spectrum.tolist()}
            info["embedding_stats"] = {"shape": out.shape, "unique_values_per_dim": [len(np.unique(np.round(c, 10))) for c in out.T], "scaling_factors": factors.tolist()}
        return out

    def _kmeans(self, x: np.ndarray, **changes) -> tuple[np.ndarray, float]:
        model = KMeans(self.n_clusters, **{"n_init": self.n_init, "random_state": self.random_state} | changes).fit_array(x)
        return model.labels_array(x), model.inertia

    def _attempts(self, x: np.ndarray, count: int, metrics: tuple[str, ...]) -> tuple[float, np.ndarray, str]:
        """The best of several single K-Means runs by a metric, the first of equal ones."""
        best = None
        for a in range(count):
            seed = None if self.random_state is None else self.random_state + a
            labels, _ = self._kmeans(x, n_init=1, random_state=seed)
            for metric in metrics:
                got = score(x, labels, metric)
                if best is None or got > best[0]:
                    best = (got, labels, metric)
        return best

    def _sweep(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """The best labels over gammas: distances once, an embedding for each gamma."""
        d2, best = kernels.exact_squared(x, x), None
        for gamma in self.gamma_range or GAMMAS:
            a = np.exp(-gamma * d2)
            np.fill_diagonal(a, 1)
            try:
                u = self.embed(Affinity(a))
            except (ValueError, np.linalg.LinAlgError):
                continue
            labels, _ = self._kmeans(u, n_init=10)
            if len(np.unique(labels)) < 2:
                continue
            got = float(np.mean([score(u, labels, m) for m in METRICS]))
            if not math.isnan(got) and (best is None or got > best[0]):
                best = (got, labels, {"gamma": gamma, "metric": "mean", "attempts": 1})
            for attempts in (10, 20, 30):
                for metric in METRICS:
                    value, labels, _ = self._attempts(u, attempts, (metric,))
                    if best is None or value > best[0]:
                        best = (value, labels, {"gamma": gamma, "metric": metric, "attempts": attempts})
        if best is None:
            raise ValueError("no gamma of the sweep gave a clustering")
        return best[1], best[2] | {"score": best[0]}

    def _fit(self, affinity: Affinity | SpreadAffinity, ids: np.ndarray, x: np.ndarray | None) -> SpectralModel:
        if self.n_clusters > affinity.n:
            raise ValueError("n_clusters cannot exceed the number of samples")
        if affinity.total() == 0:
            raise ValueError("the affinity has only zeros")
        info: dict | None = {} if self.capture_debug_info else None
        if self.intensive_parameter_sweep and self.affinity == "rbf":
            if info is not None:
                self.embed(affinity, info)
            labels, config = self._sweep(x)
            return SpectralModel(self, ids, labels, None, info, config)
        u = self.embed(affinity, info)
        if self.use_validation and self.n_clusters >= 3:
            _, labels, _ = self._attempts(u, self.validation_attempts, (self.validation_metric,))
        else:
            labels, inertia = self._kmeans(u)
            if info is not None:
                info["clustering_metrics"] = {"inertia": inertia, "iterations": 0}
        return SpectralModel(self, ids, labels, u, info)

    def fit_array(self, x: np.ndarray, ids: np.ndarray | None = None) -> SpectralModel:
        x = np.asarray(x, float)
        self._check_size(len(x), self.max_samples or MOST_SAMPLES)
        return self._fit(Affinity(self.dense_affinity(x)), np.arange(len(x)) if ids is None else ids, x)

    def _check_size(self, n: int, most: int | None) -> None:
        if most is not None and n > most and self.affinity != "nearest_neighbors":
            raise ValueError(f"{n} samples exceed max_samples = {most}; the affinity is a dense matrix")

    def fit(self, points: DataFrame, most: int | None = None) -> SpectralModel:
        if self.affinity == "nearest_neighbors":
            n, _ = frames.shape(points)
            if self.n_clusters > n:
                raise ValueError("n_clusters cannot exceed the number of samples")
            k = self.n_neighbors or graph.default_neighbours(n)
            if 2 * n * k > MOST_EDGES:
                raise ValueError(f"{n} samples with {k} neighbours are more than {MOST_EDGES} edges")
            edges = graph.knn_affinity(points, k).toArrow()
            ids = np.sort(points.select("id").toArrow().column("id").to_numpy())
            i, j = (np.searchsorted(ids, edges.column(c).to_numpy()) for c in "ij")
            return self._fit(Affinity(n=n, edges=(i, j, edges.column("d").to_numpy())), ids, None)
        if self.affinity == "precomputed":
            ids, x = frames.square(points, 1e-6, zero_diagonal=False)
        else:
            n, _ = frames.shape(points)
            self._check_size(n, self.max_samples)
            ids, x = frames.matrix(points)
            if n > (LOCAL_POINTS if most is None else most) and self.affinity in ("rbf", "cosine") and not (self.intensive_parameter_sweep and self.affinity == "rbf"):
                if self.n_clusters > n:
                    raise ValueError("n_clusters cannot exceed the number of samples")
                value = graph.cosine_value if self.affinity == "cosine" else rbf_quick(self.gamma if self.gamma is not None else 1 / x.shape[1])
                affinity = SpreadAffinity(points, x, value, cosine_factors(x) if self.affinity == "cosine" else None)
                try:
                    return self._fit(affinity, ids, None)
                finally:
                    affinity.close()
        return self.fit_array(x, ids)

    def fit_predict(self, points: DataFrame) -> DataFrame:
        return self.fit(points).labels(points.sparkSession)

    def fit_with_intermediate_steps(self, x: np.ndarray) -> dict:
        """All steps on the eigenvector path, as arrays."""
        a = self.dense_affinity(np.asarray(x, float))
        lap, s = Affinity(a).laplacian()
        values, vectors = kernels.smallest_eigenpairs(lap, self.n_clusters)
        values, vectors = values[: self.n_clusters], vectors[:, : self.n_clusters]
        u = vectors * s[:, None]
        return {"affinity": a, "laplacian": lap, "inverse_sqrt_degrees": s, "sqrt_degrees": 1 / s, "eigenvalues": values, "eigenvectors": vectors, "embedding": u, "labels": self._kmeans(u)[0]}

    def with_gamma(self, gamma: float) -> Spectral:
        return replace(self, gamma=gamma)


@dataclass(frozen=True)
class SpectralModel:
    params: Spectral
    ids: np.ndarray
    labels_: np.ndarray
    embedding_: np.ndarray | None
    debug_info: dict | None = None
    sweep: dict = field(default_factory=dict)

    def labels(self, spark: SparkSession) -> DataFrame:
        return frames.labelled(spark, self.ids, label=self.labels_.astype(np.int32))

    def compute_medoids(self, points: DataFrame) -> DataFrame:
        return medoids.select_medoids(points, self.labels(points.sparkSession), self.params.n_clusters)
