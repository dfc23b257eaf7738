"""Generated points: blobs, and the toy shapes that clusterings are shown on."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galaxis.sources import frames


def blob_arrays(n_samples: int, n_features: int = 2, centers: int | np.ndarray = 3, cluster_std: float = 1.0, random_state: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows by cluster and their labels. Centers are given, or uniform in (-10, 10); a remainder goes to the first ones."""
    rng = np.random.RandomState(random_state)
    middle = rng.uniform(-10, 10, (centers, n_features)) if isinstance(centers, int) else np.asarray(centers, float)
    k = len(middle)
    sizes = [n_samples // k + (i < n_samples % k) for i in range(k)]
    parts = []
    for i, size in enumerate(sizes):
        own = np.random.RandomState(None if random_state is None else random_state + i + 1)
        parts.append(middle[i] + cluster_std * own.standard_normal((size, middle.shape[1])))
    return np.concatenate(parts), np.repeat(np.arange(k), sizes)


def make_blobs(spark: SparkSession, n_samples: int, n_features: int = 2, centers: int | np.ndarray = 3, cluster_std: float = 1.0, random_state: int = 0) -> DataFrame:
    """(id, features, label) of any number of points, made where they are: row i is in cluster i mod k."""
    middle = np.random.RandomState(random_state).uniform(-10, 10, (centers, n_features)) if isinstance(centers, int) else np.asarray(centers, float)
    rows = spark.range(n_samples).withColumn("label", (F.col("id") % len(middle)).cast("int"))
    places = F.array(*(F.array(*map(F.lit, m.tolist())) for m in middle))
    own = F.element_at(places, F.col("label") + 1)
    return rows.select("id", F.array(*(own[j] + cluster_std * F.randn(random_state + 1 + j) for j in range(middle.shape[1]))).alias("features"), "label")


class _Mulberry:
    """A 32-bit generator of uniform numbers in [0, 1), and normal ones in pairs by Box and Muller."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def rand(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & 0xFFFFFFFF
        t = self.state
        t = (t ^ t >> 15) * (t | 1) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return (t ^ t >> 14) / 2**32

    def normal(self) -> float:
        u = 0.0
        while u == 0.0:
            u = self.rand()
        return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * self.rand())


def demo_blobs(n_samples: int, n_features: int, centers: int, cluster_std: float = 1.0, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Centers in (-10, 10); row i is in cluster i mod centers."""
    rng = _Mulberry(seed)
    middle = [[(rng.rand() - 0.5) * 20 for _ in range(n_features)] for _ in range(centers)]
    labels = np.arange(n_samples) % centers
    return np.array([[middle[c][j] + cluster_std * rng.normal() for j in range(n_features)] for c in labels]).reshape(n_samples, n_features), labels


def standardized(x: np.ndarray) -> np.ndarray:
    """Columns at mean 0 and deviation 1 over n; a constant column is only centred."""
    s = x.std(0)
    return (x - x.mean(0)) / np.where(s == 0, 1, s)


TOYS = ("moons", "circles", "blobs", "aniso", "none")


def toy_array(name: str, n: int = 300, noise: float = 0.05, seed: int = 42) -> np.ndarray:
    rng = np.random.RandomState(seed)
    half = n // 2
    if name == "moons":
        a, b = np.linspace(0, math.pi, n - half), np.linspace(0, math.pi, half)
        x = np.concatenate((np.stack((np.cos(a), np.sin(a)), 1), np.stack((1 - np.cos(b), 0.5 - np.sin(b)), 1)))
        x = x + noise * rng.standard_normal(x.shape)
    elif name == "circles":
        a, b = np.linspace(0, 2 * math.pi, n - half, endpoint=False), np.linspace(0, 2 * math.pi, half, endpoint=False)
        x = np.concatenate((np.stack((np.cos(a), np.sin(a)), 1), 0.5 * np.stack((np.cos(b), np.sin(b)), 1)))
        x = x + noise * rng.standard_normal(x.shape)
    elif name in ("blobs", "aniso"):
        x = blob_arrays(n, 2, 3, 1.0, seed)[0]
        x = x @ np.array([[0.6, -0.6], [-0.4, 0.8]]) if name == "aniso" else x
    elif name == "none":
        x = rng.random_sample((n, 2))
    else:
        raise ValueError(f"name must be one of {TOYS}")
    return standardized(x)


def toy(spark: SparkSession, name: str, n: int = 300, seed: int = 42) -> DataFrame:
    return frames.from_rows(spark, toy_array(name, n, seed=seed))


def standardize(points: DataFrame) -> DataFrame:
    """A point frame with each dimension at mean 0 and deviation 1 over n; a constant one is only centred."""
    stats = points.select(F.posexplode("features").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))), lambda r: F.struct(r["m"].alias("m"), F.when(r["s"] == 0, 1.0).otherwise(r["s"]).alias("s"))).alias("stats"))
    return points.join(F.broadcast(stats)).select("id", F.zip_with("features", "stats", lambda x, r: (x - r["m"]) / r["s"]).alias("features"))
