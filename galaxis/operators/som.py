"""Self-organizing maps.

A codebook is model-sized and lives on the driver as an array (height, width, features). Mini-batch training depends on
the order of batches, so fit() gathers points up to a bound; fit_batches() trains on any number of points by one weighted
aggregation per epoch. Predictions and map tables are Arrow passes and aggregations over frames.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galaxis.functions import kernels
from galaxis.functions.random import SeededStream
from galaxis.operators.hierarchy import Agglomerative
from galaxis.operators.pca import _summed
from galaxis.sources import frames

TOPOLOGIES, NEIGHBORHOODS, STARTS = ("rectangular", "hexagonal"), ("gaussian", "bubble", "mexican_hat"), ("random", "linear", "pca")
Decay = Callable[[int, int], float]


# --- grid -----------------------------------------------------------------------------------------------------------


def grid_to_index(row: int, col: int, width: int) -> int:
    return row * width + col


def index_to_grid(index: int, width: int) -> tuple[int, int]:
    return divmod(index, width)


def coordinates(height: int, width: int, topology: str = "rectangular") -> np.ndarray:
    """(x, y) of each neuron; odd rows of a hexagonal map are half a column to the right, rows sqrt(3)/2 apart."""
    row, col = np.divmod(np.arange(height * width), width)
    if topology == "hexagonal":
        return np.stack((col + (row % 2) * 0.5, row * math.sqrt(3) / 2), 1)
    return np.stack((col, row), 1).astype(float)


def grid_distances(height: int, width: int, topology: str = "rectangular") -> np.ndarray:
    xy = coordinates(height, width, topology)
    return kernels.distances(xy, xy)


def neighbours(row: int, col: int, height: int, width: int, topology: str = "rectangular") -> list[tuple[int, int]]:
    """The eight cells around a cell, or the six of a hexagonal map, as far as they exist."""
    if topology == "rectangular":
        steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    else:
        side = 0 if row % 2 else -1
        steps = [(-1, side), (-1, side + 1), (0, -1), (0, 1), (1, side), (1, side + 1)]
    return [(row + a, col + b) for a, b in steps if 0 <= row + a < height and 0 <= col + b < width]


def influence(kind: str, d: np.ndarray, radius: float) -> np.ndarray:
    if kind == "gaussian":
        return np.exp(-(d**2) / (2 * radius**2))
    if kind == "bubble":
        return (d <= radius).astype(float)
    if kind == "mexican_hat":
        r = d**2 / radius**2
        return 2 * (1 - r) * np.exp(-r / 2)
    raise ValueError(f"unknown neighborhood {kind!r}")


def check_radius(radius: float, height: int, width: int) -> bool:
    """False, for a warning, if it exceeds the map."""
    if not radius > 0:
        raise ValueError("the radius must be positive")
    return radius <= max(height, width)


# --- decay ----------------------------------------------------------------------------------------------------------


def linear_decay(start: float, final: float, epoch: int, total: int) -> float:
    return start if total <= 1 else start + (final - start) * epoch / (total - 1)


def exponential_decay(start: float, final: float, epoch: int, total: int, rate: float = 5.0) -> float:
    return start if total <= 1 else final + (start - final) * math.exp(-rate * epoch / total)


def inverse_time_decay(start: float, final: float, epoch: int, total: int, rate: float = 1.0) -> float:
    return start if total <= 1 else final + (start - final) / (1 + rate * epoch / total)


DECAYS = {"linear": linear_decay, "exponential": exponential_decay, "inverse": inverse_time_decay}


def decay_scheduler(start: float | Decay, kind: str = "exponential", total: int = 100, final: float | None = None) -> Decay:
    """A schedule from start towards `final`, a hundredth of start by default; a function stays as it is."""
    if callable(start):
        return start
    if kind not in DECAYS:
        raise ValueError(f"unknown decay {kind!r}")
    end = start * 0.01 if final is None else final
    return lambda epoch, n: DECAYS[kind](start, end, epoch, total)


# --- training -------------------------------------------------------------------------------------------------------


def start_weights(x: np.ndarray, height: int, width: int, how: str, seed: int | None) -> np.ndarray:
    """random: uniform in the range of each feature; linear: along the two leading components by their deviation; pca:
    over the range of both. Too few points or features make it random."""
    n, d = x.shape
    if how == "random" or n < 2 or how == "linear" and d < 2:
        return x.min(0) + np.random.RandomState(seed).random_sample((height, width, d)) * np.ptp(x, axis=0)
    mean = x.mean(0)
    _, axes = kernels.power_iteration(np.cov(x.T).reshape(d, d), min(2, d))
    z = (x - mean) @ axes.T
    if how == "linear":
        low, high = -z.std(0, ddof=1), z.std(0, ddof=1)
    else:
        low, high = z.min(0), z.max(0)
    a = np.linspace(0, 1, height) if height > 1 else np.array([0.5])
    b = np.linspace(0, 1, width) if width > 1 else np.array([0.5])
    out = mean + (low[0] + (high[0] - low[0]) * a)[:, None, None] * axes[0]
    return out + (low[1] + (high[1] - low[1]) * b)[None, :, None] * axes[1] if d > 1 else np.repeat(out, width, 1)


def best_neurons(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest neuron of each row, the first of equal ones."""
    return kernels.squared_distances(x, weights.reshape(-1, weights.shape[-1])).argmin(1)


@dataclass
class SOM:
    """learning_rate and radius: a start for exponential decay, or a function of (epoch, epochs)."""

    grid_width: int
    grid_height: int
    topology: str = "rectangular"
    neighborhood: str = "gaussian"
    num_epochs: int = 100
    learning_rate: float | Decay = 0.5
    radius: float | Decay | None = None
    initialization: str = "random"
    random_state: int | None = None
    tol: float = 1e-4
    mini_batch_size: int = 32
    online_mode: bool = False
    initial_weights: np.ndarray | None = field(default=None, repr=False)
    #: True: streaming keeps the slow schedule of enable_streaming_mode(); False: the first batch sets the usual one.
    keep_streaming_schedule: bool = False

    weights_: np.ndarray | None = field(default=None, init=False, repr=False)
    errors_: list[float] = field(default_factory=list, init=False, repr=False)
    total_samples_learned: int = field(default=0, init=False)
    current_epoch: int = field(default=0, init=False)
    last_batch_size: int = field(default=0, init=False)
    streaming_: bool = field(default=False, init=False, repr=False)

    def __post_init__(self) -> None:
        if min(self.grid_width, self.grid_height) < 1 or self.num_epochs < 1 or self.mini_batch_size < 1:
            raise ValueError("grid sides, epochs and batch size must be positive")
        if self.topology not in TOPOLOGIES or self.neighborhood not in NEIGHBORHOODS or self.initialization not in STARTS:
            raise ValueError("unknown topology, neighborhood or initialization")
        if not callable(self.learning_rate) and not 0 < self.learning_rate <= 1:
            raise ValueError("learning_rate must be in (0, 1]")
        if self.radius is not None and not callable(self.radius) and not self.radius > 0:
            raise ValueError("radius must be positive")
        if self.initial_weights is not None:
            self.initial_weights = np.asarray(self.initial_weights, float)
            if self.initial_weights.ndim != 3 or self.initial_weights.shape[:2] != (self.grid_height, self.grid_width):
                raise ValueError("initial_weights must have the grid's shape")

    # schedules

    def _schedules(self) -> tuple[Decay, Decay]:
        if self.streaming_:
            start = 0.5 if callable(self.learning_rate) else self.learning_rate
            wide = max(self.grid_width, self.grid_height) / 2
            done = lambda: self.total_samples_learned / 1000
            return lambda e, n: start * math.exp(-done() / 100), lambda e, n: max(1.0, wide * math.exp(-done() / 50))
        rate = self.learning_rate if callable(self.learning_rate) else decay_scheduler(self.learning_rate, "exponential", self.num_epochs)
        if callable(self.radius):
            return rate, self.radius
        if self.radius is not None:
            return rate, decay_scheduler(self.radius, "exponential", self.num_epochs)
        return rate, decay_scheduler(max(self.grid_width, self.grid_height) / 2, "exponential", self.num_epochs, 1.0)

    def _start(self, x: np.ndarray) -> None:
        if self.initial_weights is not None:
            if self.initial_weights.shape[2] != x.shape[1]:
                raise ValueError("initial_weights must have the data's features")
            self.weights_ = self.initial_weights.copy()
        else:
            self.weights_ = start_weights(x, self.grid_height, self.grid_width, self.initialization, self.random_state)

    def _epoch(self, x: np.ndarray, rate: float, radius: float) -> float:
        """One pass of mini-batches, each a normalised weighted step; returns the mean distance to the best neurons."""
        grid = grid_distances(self.grid_height, self.grid_width, self.topology)
        w, total = self.weights_.reshape(-1, x.shape[1]), 0.0
        for at in range(0, len(x), self.mini_batch_size):
            part = x[at : at + self.mini_batch_size]
            best = best_neurons(part, w)
            h = influence(self.neighborhood, grid[best], radius)
            mass = h.sum(0)
            step = h.T @ part - mass[:, None] * w
            w = w + rate * step / np.where(np.abs(mass) > 1e-8, mass, 1e-8)[:, None]
            total += float(np.sqrt(((part - w[best]) ** 2).sum(1)).sum())
        self.weights_ = w.reshape(self.weights_.shape)
        return total / len(x)

    def fit_array(self, x: np.ndarray) -> SOM:
        """Starts from the weights that are there. Stops where the error changes by less than tol."""
        x = np.asarray(x, float)
        if self.weights_ is None:
            self._start(x)
        rate, radius = self._schedules()
        stream, before, self.errors_ = SeededStream(self.random_state), math.inf, []
        for epoch in range(self.num_epochs):
            self.current_epoch = epoch
            r = radius(epoch, self.num_epochs)
            check_radius(r, self.grid_height, self.grid_width)
            error = self._epoch(x[stream.permutation(len(x))], rate(epoch, self.num_epochs), r)
            self.errors_.append(error)
            if abs(before - error) < self.tol:
                break
            before = error
            if self.online_mode:
                self.total_samples_learned += len(x)
        return self

    def fit(self, points: DataFrame) -> SOM:
        return self.fit_array(frames.matrix(points)[1])

    def fit_batches(self, points: DataFrame) -> SOM:
        """Another algorithm, for any number of points: an epoch is one weighted step of all points, and starts at
        random_state's weights in the range of the features."""
        n, d = frames.shape(points)
        if self.weights_ is None and self.initial_weights is None:
            ends = points.select(F.posexplode("features").alias("p", "x")).groupBy("p").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("p").collect()
            self.weights_ = start_weights(np.array([[r["a"] for r in ends], [r["b"] for r in ends]]), self.grid_height, self.grid_width, "random", self.random_state)
        elif self.weights_ is None:
            self.weights_ = self.initial_weights.copy()
        rate, radius = self._schedules()
        grid, before, self.errors_ = grid_distances(self.grid_height, self.grid_width, self.topology), math.inf, []
        points = points.select("id", "features").persist()
        for epoch in range(self.num_epochs):
            w, r, kind = self.weights_.reshape(-1, d), radius(epoch, self.num_epochs), self.neighborhood

            def work(x: np.ndarray, w=w, r=r, kind=kind) -> np.ndarray:
                best = best_neurons(x, w)
                h = influence(kind, grid[best], r)
                error = np.sqrt(((x - w[best]) ** 2).sum(1)).sum()
                return np.concatenate(((h.T @ x).ravel(), h.sum(0), [error]))

            total = _summed(points, work)[1]
            k = len(w)
            mass = total[k * d : -1]
            w = w + rate(epoch, self.num_epochs) * (total[: k * d].reshape(k, d) - mass[:, None] * w) / np.where(np.abs(mass) > 1e-8, mass, 1e-8)[:, None]
            self.weights_, self.current_epoch = w.reshape(self.weights_.shape), epoch
            self.errors_.append(float(total[-1] / n))
            if abs(before - self.errors_[-1]) < self.tol:
                break
            before = self.errors_[-1]
        points.unpersist()
        return self

    # streaming

    def partial_fit_array(self, x: np.ndarray) -> SOM:
        if not self.online_mode:
            raise ValueError("partial_fit needs online_mode")
        x = np.asarray(x, float)
        self.last_batch_size = len(x)
        if not len(x):
            return self
        if self.weights_ is None:
            self._start(x)
            self.streaming_ = self.streaming_ and self.keep_streaming_schedule
        elif self.weights_.shape[2] != x.shape[1]:
            raise ValueError(f"expected {self.weights_.shape[2]} features, got {x.shape[1]}")
        epoch = self.total_samples_learned // len(x)
        rate, radius = self._schedules()
        self._epoch(x, rate(epoch, self.num_epochs), radius(epoch, self.num_epochs))
        self.total_samples_learned += len(x)
        return self

    def partial_fit(self, points: DataFrame) -> SOM:
        return self.partial_fit_array(frames.matrix(points)[1])

    def enable_streaming_mode(self, batch_size: int | None = None) -> None:
        self.online_mode, self.mini_batch_size, self.streaming_ = True, batch_size or 32, True

    def process_stream(self, points: DataFrame, auto_train: bool = True) -> SOM:
        if not self.online_mode:
            self.enable_streaming_mode()
        if not auto_train:
            raise ValueError("process_stream without training isn't supported")
        return self.partial_fit(points)

    def streaming_stats(self) -> dict:
        epoch = self.total_samples_learned // (self.last_batch_size or self.mini_batch_size)
        rate, radius = self._schedules()
        return {
            "total_samples": self.total_samples_learned, "virtual_epoch": epoch, "current_learning_rate": rate(epoch, self.num_epochs), "current_radius": radius(epoch, self.num_epochs),
            "latest_quantization_error": self.errors_[-1] if self.errors_ else 0.0,
        }

    # results

    def weights(self) -> np.ndarray:
        if self.weights_ is None:
            raise ValueError("the SOM must be fitted first")
        return self.weights_

    def codebook(self, spark: SparkSession) -> DataFrame:
        """(neuron, row, col, w)."""
        w = self.weights()
        return spark.createDataFrame([(i, *divmod(i, self.grid_width), v.tolist()) for i, v in enumerate(w.reshape(-1, w.shape[2]))], "neuron int, row int, col int, w array<double>")

    def predict(self, points: DataFrame) -> DataFrame:
        """(id, label, second, distance): the nearest neuron, the next one, and the distance to the nearest."""
        w = self.weights().reshape(-1, self.weights().shape[2])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = frames.block(b)
                if len(x):
                    d = kernels.squared_distances(x, w)
                    first = d.argmin(1)
                    near = np.sqrt(((x - w[first]) ** 2).sum(1))
                    d[np.arange(len(x)), first] += 1e30
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(first.astype(np.int32)), pa.array(d.argmin(1).astype(np.int32)), pa.array(near)], names=["id", "label", "second", "distance"])

        return points.select("id", "features").mapInArrow(run, "id long, label int, second int, distance double")

    def fit_predict(self, points: DataFrame) -> DataFrame:
        return self.fit(points).predict(points).select("id", "label")

    def quantization_error(self) -> float:
        if not self.errors_:
            raise ValueError("the SOM must be fitted first")
        return self.errors_[-1]

    def topographic_error(self, points: DataFrame) -> float:
        """The share of points whose two nearest neurons aren't neighbours."""
        rows = [(i, a * self.grid_width + b) for i in range(self.grid_width * self.grid_height) for a, b in neighbours(*divmod(i, self.grid_width), self.grid_height, self.grid_width, self.topology)]
        near = points.sparkSession.createDataFrame(rows or [(-1, -1)], "label int, second int").withColumn("near", F.lit(1))
        return self.predict(points).join(F.broadcast(near), ["label", "second"], "left").agg(F.avg(F.when(F.col("near").isNull(), 1.0).otherwise(0.0))).first()[0]

    def cluster(self, points: DataFrame, n_clusters: int, linkage: str = "ward", metric: str = "euclidean") -> DataFrame:
        """(id, label): neurons are clustered hierarchically, and points have their neuron's label."""
        w = self.weights().reshape(-1, self.weights().shape[2])
        labels = Agglomerative(n_clusters, linkage, metric).fit_array(w).labels_
        lookup = points.sparkSession.createDataFrame([(i, int(k)) for i, k in enumerate(labels)], "neuron int, label int")
        return self.predict(points).select("id", F.col("label").alias("neuron")).join(F.broadcast(lookup), "neuron").select("id", "label")

    def u_matrix(self) -> np.ndarray:
        """The mean distance of each neuron to its neighbours, 0 without any."""
        w = self.weights()
        out = np.zeros(w.shape[:2])
        for i in range(self.grid_height):
            for j in range(self.grid_width):
                near = neighbours(i, j, self.grid_height, self.grid_width, self.topology)
                out[i, j] = np.mean([np.linalg.norm(w[i, j] - w[a, b]) for a, b in near]) if near else 0.0
        return out

    # persistence

    def _params(self) -> dict:
        own = {k: v for k, v in asdict(replace(self, initial_weights=None)).items() if k not in ("initial_weights", "weights_", "errors_", "total_samples_learned", "current_epoch", "last_batch_size", "streaming_")}
        return {k: v for k, v in own.items() if not callable(v)}

    def save_state(self) -> dict:
        return {"weights": self.weights().tolist(), "total_samples": self.total_samples_learned, "current_epoch": self.current_epoch, "grid_width": self.grid_width, "grid_height": self.grid_height, "params": self._params()}

    def load_state(self, state: dict) -> None:
        """Weights and counters; the parameters stay."""
        self.weights_ = np.array(state["weights"], float)
        self.total_samples_learned, self.current_epoch = state["total_samples"], state["current_epoch"]

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights().tolist(), "metadata": {"params": self._params(), "total_samples_learned": self.total_samples_learned, "current_epoch": self.current_epoch, "quantization_errors": self.errors_}})

    @staticmethod
    def from_json(text: str) -> SOM:
        got = json.loads(text)
        meta = got["metadata"]
        out = SOM(**meta["params"])
        out.weights_ = np.array(got["weights"], float)
        out.total_samples_learned, out.current_epoch, out.errors_ = meta["total_samples_learned"], meta["current_epoch"], meta["quantization_errors"]
        return out


# --- map tables -----------------------------------------------------------------------------------------------------


def cells(som: SOM, spark: SparkSession) -> DataFrame:
    n = som.grid_height * som.grid_width
    return spark.range(n).select(F.col("id").cast("int").alias("neuron"), F.floor(F.col("id") / som.grid_width).cast("int").alias("row"), (F.col("id") % som.grid_width).cast("int").alias("col"))


def hit_map(som: SOM, points: DataFrame) -> DataFrame:
    """(row, col, hits), 0 where no point is."""
    hits = som.predict(points).groupBy(F.col("label").alias("neuron")).agg(F.count("*").alias("hits"))
    return cells(som, points.sparkSession).join(hits, "neuron", "left").select("row", "col", F.coalesce("hits", F.lit(0)).alias("hits"))


def quality_map(som: SOM, points: DataFrame) -> DataFrame:
    """(row, col, error): the mean distance of a neuron's points, 0 without any."""
    errors = som.predict(points).groupBy(F.col("label").alias("neuron")).agg(F.avg("distance").alias("error"))
    return cells(som, points.sparkSession).join(errors, "neuron", "left").select("row", "col", F.coalesce("error", F.lit(0.0)).alias("error"))


def component_planes(som: SOM, spark: SparkSession) -> DataFrame:
    """(feature, row, col, value)."""
    return som.codebook(spark).select(F.posexplode("w").alias("feature", "value"), "row", "col").select("feature", "row", "col", "value")


def activation_map(som: SOM, sample: np.ndarray) -> np.ndarray:
    """1 at a neuron equal to the sample, 0 at the farthest."""
    d = np.sqrt(((som.weights() - np.asarray(sample, float)) ** 2).sum(2))
    with np.errstate(invalid="ignore"):
        return (d.max() - d) / d.max()


def trajectory(som: SOM, sequence: DataFrame) -> DataFrame:
    """(id, row, col) of the nearest neurons of an ordered sequence."""
    return som.predict(sequence).select("id", F.floor(F.col("label") / som.grid_width).cast("int").alias("row"), (F.col("label") % som.grid_width).cast("int").alias("col"))


def neighbour_distances(som: SOM) -> np.ndarray:
    return som.u_matrix()


def density_map(som: SOM, points: DataFrame, sigma: float = 1.0) -> DataFrame:
    """(row, col, density): hits spread by a normalised Gaussian kernel of three sigmas; the hits for sigma <= 0."""
    hits = hit_map(som, points)
    if sigma <= 0:
        return hits.select("row", "col", F.col("hits").cast("double").alias("density"))
    reach = math.ceil(3 * sigma)
    span = np.arange(-reach, reach + 1)
    kernel = np.exp(-(span[:, None] ** 2 + span[None, :] ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    rows = [(int(a), int(b), float(kernel[a + reach, b + reach])) for a in span for b in span]
    moves = points.sparkSession.createDataFrame(rows, "dr int, dc int, k double")
    spread = hits.where("hits > 0").join(F.broadcast(moves)).groupBy((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col")).agg(F.sum(F.col("hits") * F.col("k")).alias("density"))
    return cells(som, points.sparkSession).drop("neuron").join(spread, ["row", "col"], "left").select("row", "col", F.coalesce("density", F.lit(0.0)).alias("density"))


def export_map(som: SOM, form: str = "json") -> str:
    """The map for drawing, as JSON, or as CSV with row, col, u_value and the features."""
    w, u = som.weights(), som.u_matrix()
    if form == "json":
        return json.dumps({"grid_height": som.grid_height, "grid_width": som.grid_width, "weights": w.tolist(), "u_matrix": u.tolist(), "params": som._params()}, indent=2)
    if form != "csv":
        raise ValueError("form must be json or csv")
    head = ",".join(["row", "col", "u_value", *(f"feature_{k}" for k in range(w.shape[2]))])
    body = [",".join(map(repr, [i, j, float(u[i, j]), *w[i, j].tolist()])) for i in range(som.grid_height) for j in range(som.grid_width)]
    return "\n".join([head, *body]) + "\n"


# --- sequential trainer ---------------------------------------------------------------------------------------------


def _shifted(width: int, height: int, topology: str) -> np.ndarray:
    """(width, height, 2): rows counted from the last are half a column to the left on a hexagonal map."""
    x, y = np.meshgrid(np.arange(width, dtype=float), np.arange(height, dtype=float), indexing="ij")
    if topology == "hexagonal":
        x[:, ::-1][:, ::2] -= 0.5
        y *= 3 / (2 * math.sqrt(3))
    return np.stack((x, y), 2)


def train_sequential(data: np.ndarray, initial: np.ndarray, topology: str = "rectangular", neighborhood: str = "gaussian", learning_rate: float = 0.5, sigma: float = 1.0, iterations: int = 100) -> dict:
    """One sample a step, taken in turn, with rate and width falling as 1 / (1 + t / half). Weights are (height, width,
    features). Returns weights, bmus (row, col), labels, errors and the summed distance map over its maximum."""
    data, w = np.asarray(data, float), np.asarray(initial, float).transpose(1, 0, 2).copy()
    width, height, d = w.shape
    xy = _shifted(width, height, topology)
    near = lambda s: np.unravel_index(int(((w - s) ** 2).sum(2).argmin()), (width, height))
    for t in range(iterations):
        s = data[t % len(data)]
        cx, cy = near(s)
        fall = 1 + t / (iterations / 2)
        width_now = sigma / fall
        if neighborhood == "bubble":
            a, b = np.arange(width), np.arange(height)
            g = np.outer((a > cx - width_now) & (a < cx + width_now), (b > cy - width_now) & (b < cy + width_now)).astype(float)
        else:
            p = ((xy - xy[cx, cy]) ** 2).sum(2)
            g = np.exp(-p / (2 * width_now**2))
            if neighborhood == "mexican_hat":
                g = g * (1 - p / width_now**2)
        w += (learning_rate / fall) * g[:, :, None] * (s - w)
    flat = w.reshape(-1, d)
    d2 = kernels.exact_squared(data, flat)
    first, second = (np.argsort(d2, 1, kind="stable")[:, k] for k in (0, 1)) if len(flat) > 1 else (np.zeros(len(data), int),) * 2
    gap = xy.reshape(-1, 2)[first] - xy.reshape(-1, 2)[second]
    apart = np.sqrt((gap**2).sum(1))
    wrong = ~np.isclose(1, apart) if topology == "hexagonal" else apart > 1.42
    total = np.zeros((width, height))
    for a in range(width):
        for b in range(height):
            if topology == "hexagonal":
                side = -1 if b % 2 == 0 else 1  # the diagonal pair of an even row lies to the left
                steps = [(0, 1), (0, -1), (-1, 0), (1, 0), (side, 1), (side, -1)]
            else:
                steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
            total[a, b] = sum(np.linalg.norm(w[a, b] - w[a + i, b + j]) for i, j in steps if 0 <= a + i < width and 0 <= b + j < height)
    u = total / total.max() if total.max() > 0 else total
    col, row = np.divmod(first, height)
    return {
        "weights": w.transpose(1, 0, 2), "bmus": np.stack((row, col), 1), "labels": row * width + col,
        "quantization_error": float(np.sqrt(d2[np.arange(len(data)), first]).mean()), "topographic_error": float(wrong.mean()), "u_matrix": u.T,
    }
