"""K-Means, Euclidean and spherical, with greedy k-means++ seeding.

Points that fit the driver's bound are solved there in NumPy. Beyond it, each step is one job over the cached point
frame: an Arrow pass per partition returns sums, counts and the few farthest points, so what reaches the driver is of
the size of the model times the number of partitions. Both ways share one algorithm and draw the same seeds.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from galaxis.functions import kernels
from galaxis.functions.random import SeededStream
from galaxis.sources import frames

#: The most values that are solved on the driver.
DRIVER_VALUES = 1 << 23


def _reach(x: np.ndarray, centers: np.ndarray, metric: str) -> np.ndarray:
    """What is summed up as inertia for each point and center: squared distances, by Euclid or by cosine."""
    return kernels.squared_distances(x, centers) if metric == "euclidean" else kernels.distances(x, centers, "cosine") ** 2


class _Local:
    """Points in memory, in the order of their ids."""

    def __init__(self, x: np.ndarray, metric: str):
        self.x, self.n, self.metric = x, len(x), metric

    def rows(self, at: list[int]) -> np.ndarray:
        return self.x[at]

    def start(self) -> None:
        self.near = np.full(self.n, np.inf)

    def add(self, center: np.ndarray) -> None:
        self.near = np.minimum(self.near, self._to(center[None])[:, 0])

    def _to(self, centers: np.ndarray) -> np.ndarray:
        return kernels.exact_squared(self.x, centers) if self.metric == "euclidean" else _reach(self.x, centers, self.metric)

    def total(self) -> float:
        return float(self.near.sum())

    def draw(self, targets: list[float]) -> list[int]:
        return np.minimum(np.searchsorted(np.cumsum(self.near), targets), self.n - 1).tolist()

    def potentials(self, centers: np.ndarray) -> np.ndarray:
        return np.minimum(self.near[:, None], self._to(centers)).sum(0)

    def step(self, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
        """Sums and counts by nearest center, the inertia, and the len(centers) farthest points, farthest first."""
        d = _reach(self.x, centers, self.metric)
        label = d.argmin(1)
        best = d[np.arange(self.n), label]
        sums = np.zeros_like(centers)
        np.add.at(sums, label, self.x)
        counts = np.bincount(label, minlength=len(centers))
        return sums, counts, float(best.sum()), self.x[np.argsort(-best, kind="stable")[: len(centers)]] if (counts == 0).any() else self.x[:0]


class _Spread:
    """The same over a cached point frame, whose partitions hold ranges of ids in order."""

    def __init__(self, points: DataFrame, n: int, metric: str):
        parts = max(1, points.rdd.getNumPartitions())
        schema = T.StructType([*frames.POINTS])
        spherical = metric == "cosine"

        def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = frames.block(b)
                x = kernels.normalize_rows(x) if spherical and len(x) else x
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(x), pa.list_(pa.float64()))], names=schema.names)

        self.frame = points.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(prepare, schema).persist(StorageLevel.MEMORY_AND_DISK)
        self.n, self.metric, self.centers = n, metric, np.zeros((0, 0))

    def _pass(self, work, fields: str) -> list:
        """work(partition, ids, rows) -> list of rows of a few values or arrays, collected."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            held = [(b.column("id").to_numpy(), frames.block(b)) for b in batches if b.num_rows]
            if held:
                ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                rows = work(TaskContext.get().partitionId(), ids, x)
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], arrow)

        schema = T._parse_datatype_string(fields)
        arrow = to_arrow_schema(schema)
        return self.frame.mapInArrow(run, schema).collect()

    def start(self) -> None:
        self.centers = None

    def _near(self):
        centers, metric = self.centers, self.metric

        def near(x: np.ndarray) -> np.ndarray:
            if centers is None:
                return np.full(len(x), np.inf)
            return (kernels.exact_squared(x, centers) if metric == "euclidean" else _reach(x, centers, metric)).min(1)

        return near

    def add(self, center: np.ndarray) -> None:
        self.centers = center[None] if self.centers is None else np.vstack((self.centers, center))
        near = self._near()
        got = sorted(self._pass(lambda p, ids, x: [(p, len(ids), float(near(x).sum()))], "p int, n long, s double"))
        self.parts = [r["p"] for r in got]
        self.sizes, self.sums = np.array([r["n"] for r in got]), np.array([r["s"] for r in got])

    def total(self) -> float:
        return float(self.sums.sum())

    def draw(self, targets: list[float]) -> list[int]:
        ends = np.cumsum(self.sums)
        where = np.minimum(np.searchsorted(ends, targets), len(ends) - 1)
        asked: dict[int, list[tuple[int, float]]] = {}
        for k, (w, t) in enumerate(zip(where.tolist(), targets, strict=True)):
            asked.setdefault(self.parts[w], []).append((k, t - (ends[w - 1] if w else 0.0)))
        near = self._near()

        def work(p: int, ids: np.ndarray, x: np.ndarray) -> list:
            if p not in asked:
                return []
            cum = np.cumsum(near(x))
            return [(k, p, int(min(np.searchsorted(cum, t), len(ids) - 1))) for k, t in asked[p]]

        before = dict(zip(self.parts, np.concatenate(([0], np.cumsum(self.sizes)[:-1])).tolist(), strict=True))
        found = {r["k"]: before[r["p"]] + r["at"] for r in self._pass(work, "k int, p int, at long")}
        return [found[k] for k in range(len(targets))]

    def rows(self, at: list[int]) -> np.ndarray:
        if not hasattr(self, "sizes"):
            got = sorted(self._pass(lambda p, ids, x: [(p, len(ids))], "p int, n long"))
            self.parts, self.sizes = [r["p"] for r in got], np.array([r["n"] for r in got])
        starts = dict(zip(self.parts, np.concatenate(([0], np.cumsum(self.sizes)[:-1])).tolist(), strict=True))

        def work(p: int, ids: np.ndarray, x: np.ndarray) -> list:
            a = starts[p]
            return [(k, x[i - a].tolist()) for k, i in enumerate(at) if a <= i < a + len(ids)]

        found = {r["k"]: r["x"] for r in self._pass(work, "k int, x array<double>")}
        return np.array([found[k] for k in range(len(at))])

    def potentials(self, centers: np.ndarray) -> np.ndarray:
        near, metric = self._near(), self.metric

        def work(p: int, ids: np.ndarray, x: np.ndarray) -> list:
            d = kernels.exact_squared(x, centers) if metric == "euclidean" else _reach(x, centers, metric)
            return [(np.minimum(near(x)[:, None], d).sum(0).tolist(),)]

        return np.sum([r["s"] for r in self._pass(work, "s array<double>")], 0)

    def step(self, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
        metric, k = self.metric, len(centers)

        def work(p: int, ids: np.ndarray, x: np.ndarray) -> list:
            sums, counts, inertia, far = _Local(x, metric).step(centers)
            if not len(far):  # the whole may have an empty cluster only if each part has
                return [(sums.ravel().tolist(), counts.tolist(), inertia, [], [], [])]
            best = _reach(x, centers, metric).min(1)
            top = np.argsort(-best, kind="stable")[:k]
            return [(sums.ravel().tolist(), counts.tolist(), inertia, best[top].tolist(), ids[top].tolist(), x[top].ravel().tolist())]

        got = self._pass(work, "s array<double>, n array<long>, i double, far array<double>, ids array<long>, rows array<double>")
        sums = np.sum([r["s"] for r in got], 0).reshape(centers.shape)
        counts = np.sum([r["n"] for r in got], 0)
        far = sorted((-d, i, row) for r in got for d, i, row in zip(r["far"], r["ids"], np.reshape(r["rows"], (-1, centers.shape[1])).tolist(), strict=True))
        return sums, counts, math.fsum(r["i"] for r in got), np.array([row for _, _, row in far[:k]]).reshape(-1, centers.shape[1])


def seed_centers(data: _Local | _Spread, k: int, stream: SeededStream) -> list[int]:
    """Greedy k-means++: of 2 + floor(ln k) draws by squared distance the one that leaves the least is taken."""
    chosen = [stream.rand_int(data.n)]
    data.start()
    data.add(data.rows(chosen)[0])
    trials = 2 + math.floor(math.log(k))
    while len(chosen) < k:
        total = data.total()
        if total == 0:
            best = next(i for i in range(data.n) if i not in chosen)
        else:
            drawn = data.draw([stream.rand() * total for _ in range(trials)])
            left = data.potentials(data.rows(drawn))
            best = drawn[int(np.argmin(left))]
        chosen.append(best)
        data.add(data.rows([best])[0])
    return chosen


@dataclass(frozen=True)
class KMeans:
    """metric: euclidean or cosine. random_state makes runs repeatable; run r of n_init uses random_state + r."""

    n_clusters: int
    max_iter: int = 300
    tol: float = 1e-4
    n_init: int = 10
    metric: str = "euclidean"
    random_state: int | None = None

    def __post_init__(self) -> None:
        if int(self.n_clusters) != self.n_clusters or self.n_clusters < 1:
            raise ValueError("n_clusters must be a positive integer")
        if self.max_iter < 1 or self.n_init < 1 or self.tol < 0:
            raise ValueError("max_iter and n_init must be positive, tol not negative")
        if self.metric not in ("euclidean", "cosine"):
            raise ValueError("metric must be 'euclidean' or 'cosine'")

    def _lloyd(self, data: _Local | _Spread, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
        """Centers of the last assignment, the centers after it, its inertia, and the number of steps."""
        before = np.inf
        for number in range(1, self.max_iter + 1):
            sums, counts, inertia, far = data.step(centers)
            empty = np.flatnonzero(counts == 0)
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
            new[empty[: len(far)]] = far[: len(empty)]
            shift = float(np.abs(centers - new).max())
            last, centers = centers, new
            with np.errstate(invalid="ignore"):
                change = np.abs(np.float64(before) - inertia) / (before or 1)
            before = inertia
            if change <= self.tol or shift <= self.tol:
                break
        return last, centers, before, number

    def _best(self, data: _Local | _Spread) -> tuple[np.ndarray, np.ndarray, float, int]:
        best = None
        for run in range(self.n_init):
            stream = SeededStream(None if self.random_state is None else self.random_state + run)
            got = self._lloyd(data, data.rows(seed_centers(data, self.n_clusters, stream)))
            if best is None or got[2] < best[2] * (1 - 1e-9):  # not by rounding alone
                best = got
        return best

    def fit_array(self, x: np.ndarray) -> KMeansModel:
        """Of an array on the driver."""
        if self.n_clusters > len(x):
            raise ValueError("n_clusters cannot exceed the number of samples")
        x = kernels.normalize_rows(x) if self.metric == "cosine" else x
        return KMeansModel(self, *self._best(_Local(x, self.metric)))

    def fit(self, points: DataFrame, driver_values: int = DRIVER_VALUES) -> KMeansModel:
        n, d = frames.shape(points)
        if self.n_clusters > n:
            raise ValueError("n_clusters cannot exceed the number of samples")
        if n * d <= driver_values:
            return self.fit_array(frames.matrix(points)[1])
        data = _Spread(points, n, self.metric)
        try:
            return KMeansModel(self, *self._best(data))
        finally:
            data.frame.unpersist()

    def fit_predict(self, points: DataFrame) -> DataFrame:
        return self.fit(points).labels(points)


def nearest(points: DataFrame, centers: np.ndarray, metric: str = "euclidean", label: str = "label") -> DataFrame:
    """(id, label, distance) of each point's nearest center, the first of equal ones. Centers are a model's."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField(label, T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = frames.block(b)
            if not len(x):
                continue
            d = _reach(kernels.normalize_rows(x) if metric == "cosine" else x, centers, metric)
            at = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(at.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(x)), at]))], names=schema.names)

    return points.select("id", "features").mapInArrow(run, schema)


@dataclass(frozen=True)
class KMeansModel:
    """assigning: the centers of the last assignment, which labels() and inertia are of; centroids: after it."""

    params: KMeans
    assigning: np.ndarray
    centroids: np.ndarray
    inertia: float
    n_iter: int = 0

    def labels(self, points: DataFrame) -> DataFrame:
        """(id, label) of the training points, as the last assignment had them."""
        return nearest(points, self.assigning, self.params.metric).select("id", "label")

    def labels_array(self, x: np.ndarray) -> np.ndarray:
        return _reach(kernels.normalize_rows(x) if self.params.metric == "cosine" else x, self.assigning, self.params.metric).argmin(1)

    def predict(self, points: DataFrame) -> DataFrame:
        return nearest(points, self.centroids, self.params.metric).select("id", "label")

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        return _reach(kernels.normalize_rows(x) if self.params.metric == "cosine" else x, self.centroids, self.params.metric).argmin(1) if len(x) else np.zeros(0, int)

    def centroid_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(self.centroids)], "cluster int, centroid array<double>")

    def to_json(self) -> str:
        return json.dumps({"params": asdict(self.params), "centroids_": self.centroids.tolist(), "inertia_": self.inertia})

    @staticmethod
    def from_json(text: str) -> KMeansModel:
        """A model that predicts without a fit."""
        got = json.loads(text)
        c = np.array(got["centroids_"], float)
        return KMeansModel(KMeans(**got["params"]), c, c, got["inertia_"])


def cluster_means(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, size, mean) by partial sums of each dimension in the JVM."""
    rows = points.join(labels, "id").select("label", F.posexplode("features").alias("pos", "x"))
    sums = rows.groupBy("label", "pos").agg(F.avg("x").alias("x"), F.count("*").alias("size"))
    return sums.groupBy("label").agg(F.first("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))
