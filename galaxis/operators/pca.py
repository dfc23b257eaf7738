"""Principal components from a covariance that is summed up by partitions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galaxis.functions import kernels
from galaxis.sources import frames

PARTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.DoubleType()))])


def _summed(points: DataFrame, work) -> tuple[int, np.ndarray]:
    """Sums over all points of work(rows), an array of the size of a model, partial by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for b in batches:
            x = frames.block(b)
            if len(x):
                n, total = n + len(x), total + work(x).ravel()
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [total.tolist()]})

    got = points.select("id", "features").mapInArrow(run, PARTS).collect()
    return sum(r["n"] for r in got), np.sum([r["s"] for r in got], 0) if got else np.zeros(0)


def mean_and_covariance(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, the mean, and the sample covariance (over 1 for a single point), centred in a second pass."""
    n, d = frames.shape(points)
    if n == 0:
        raise ValueError("there are no points")
    mean = _summed(points, lambda x: x.sum(0))[1] / n
    products = _summed(points, lambda x: (x - mean).T @ (x - mean))[1].reshape(d, d)
    return n, mean, products / max(1, n - 1)


@dataclass(frozen=True)
class PCA:
    n_components: int

    def __post_init__(self) -> None:
        if int(self.n_components) != self.n_components or self.n_components < 1:
            raise ValueError("n_components must be a positive integer")

    def fit(self, points: DataFrame) -> PCAModel:
        _, mean, cov = mean_and_covariance(points)
        if self.n_components > len(mean):
            raise ValueError("n_components cannot exceed the number of features")
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")[: self.n_components]
        return PCAModel(self.n_components, kernels.fix_signs(vectors[:, order]).T, np.maximum(0, values[order]), mean)

    def fit_transform(self, points: DataFrame) -> DataFrame:
        return self.fit(points).transform(points)

    def fit_predict(self, points: DataFrame) -> DataFrame:
        raise NotImplementedError("PCA has no labels; use fit_transform")


def project(vector: str, rows: np.ndarray, offset: np.ndarray) -> Column:
    """rows @ (vector - offset) as an expression, for models of a few components."""
    centred = F.zip_with(F.col(vector), F.array(*map(F.lit, offset.tolist())), lambda x, m: x - m)
    parts = [F.aggregate(F.zip_with(centred, F.array(*map(F.lit, r.tolist())), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) for r in rows]
    return F.array(*parts)


@dataclass(frozen=True)
class PCAModel:
    n_components: int
    components_: np.ndarray
    explained_variance_: np.ndarray
    mean_: np.ndarray

    def transform(self, points: DataFrame) -> DataFrame:
        return _mapped(points, lambda x: (x - self.mean_) @ self.components_.T)

    def inverse_transform(self, points: DataFrame) -> DataFrame:
        return _mapped(points, lambda x: x @ self.components_ + self.mean_)

    def to_json(self) -> str:
        return json.dumps({"n_components": self.n_components, "components_": self.components_.tolist(), "explained_variance_": self.explained_variance_.tolist(), "mean_": self.mean_.tolist()})

    @staticmethod
    def from_json(text: str) -> PCAModel:
        got = json.loads(text)
        return PCAModel(got["n_components"], *(np.array(got[k], float) for k in ("components_", "explained_variance_", "mean_")))


def _mapped(points: DataFrame, work) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = frames.block(b)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(work(x)) if len(x) else [], pa.list_(pa.float64()))], names=["id", "features"])

    return points.select("id", "features").mapInArrow(run, frames.POINTS)


def project_2d(points: DataFrame) -> DataFrame:
    """(id, x, y): the two leading components, over n instead of n - 1 (which changes no direction), signs fixed."""
    d = frames.shape(points)[1]
    out = PCA(min(2, d)).fit_transform(points)
    return out.select("id", F.col("features")[0].alias("x"), (F.col("features")[1] if d > 1 else F.lit(0.0)).alias("y"))
