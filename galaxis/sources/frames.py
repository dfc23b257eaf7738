"""Frames of points, labels and distances, and the way from and to NumPy.

A point frame is (id BIGINT, features ARRAY<DOUBLE>); ids give the order that ties are broken by. Distances and
affinities are long frames (i, j, d).
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The most values that are gathered on the driver or held in one task: 512 MB as doubles.
MOST_VALUES = 1 << 26

POINTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", T.ArrayType(T.DoubleType()))])


def checkpoints(spark: SparkSession) -> None:
    """See that checkpoint() has a folder: the one in spark.checkpoint.dir, or one of this machine for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="galaxis-"))


def points(frame: DataFrame, id_column: str, features: str | Sequence[str]) -> DataFrame:
    """A point frame from an array column, an ML vector column or several numeric columns."""
    if isinstance(features, str):
        kind = frame.schema[features].dataType
        if isinstance(kind, T.ArrayType):
            vector = F.col(features).cast("array<double>")
        else:
            from pyspark.ml.functions import vector_to_array

            vector = vector_to_array(features)
    else:
        vector = F.array(*(F.col(c).cast("double") for c in features))
    return frame.select(F.col(id_column).cast("long").alias("id"), vector.alias("features"))


def from_rows(spark: SparkSession, rows: Sequence[Sequence[float]] | np.ndarray) -> DataFrame:
    """A point frame whose ids are the places of the rows."""
    x = np.asarray(rows, float)
    if x.ndim != 2:
        raise ValueError("rows must have equal lengths")
    table = pa.table({"id": pa.array(np.arange(len(x))), "features": pa.array(list(x), pa.list_(pa.float64()))})
    return spark.createDataFrame(table)


def from_labels(spark: SparkSession, labels: Sequence[float]) -> DataFrame:
    """(id, label); labels that are not whole are rounded."""
    return spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(labels))), "label": pa.array(np.rint(np.asarray(labels, float)).astype(np.int32))}))


def shape(frame: DataFrame) -> tuple[int, int]:
    """Rows and dimensions, after checks: ids are there and distinct, vectors have equal lengths and finite values."""
    size = F.size("features")
    bad = F.col("id").isNull() | F.col("features").isNull() | F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    got = frame.agg(F.count("*").alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), F.sum(F.when(bad, 1).otherwise(0)).alias("bad")).first()
    if got["bad"]:
        raise ValueError(f"{got['bad']} points have no id, or values that are null or not finite")
    if got["n"] and got["low"] != got["high"]:
        raise ValueError("all points must have the same number of features")
    return got["n"], got["high"] or 0


def matrix(frame: DataFrame, most: int = MOST_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """ids and rows in the order of ids, on the driver; refused beyond `most` values."""
    n, d = shape(frame)
    if n * max(d, 1) > most:
        raise ValueError(f"{n} points of {d} features are too many to gather; the limit is {most} values")
    table = frame.select("id", "features").orderBy("id").toArrow()
    ids = table.column("id").to_numpy()
    if len(np.unique(ids)) != len(ids):
        raise ValueError("ids must be distinct")
    flat = table.column("features").combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False) if n else np.zeros(0)
    return ids, np.array(values, float).reshape(n, d)


def block(batch: pa.RecordBatch, column: str = "features") -> np.ndarray:
    """The rows of an Arrow batch of points as a matrix."""
    lists = batch.column(column)
    if not len(lists):
        return np.zeros((0, 0))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def square(frame: DataFrame, tolerance: float = 1e-8, zero_diagonal: bool = True, most: int = MOST_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """A precomputed matrix, from (i, j, d) or from points whose features are its rows; checked to be square and
    symmetric, with a zero diagonal where one is asked for."""
    if "features" in frame.columns:
        ids, out = matrix(frame, most)
        if out.shape[0] != out.shape[1]:
            raise ValueError("a precomputed matrix must be square")
    else:
        count = frame.count()
        if count > most:
            raise ValueError(f"{count} entries are too many to gather; the limit is {most}")
        table = frame.select("i", "j", "d").toArrow()
        i, j, d = (table.column(c).to_numpy() for c in ("i", "j", "d"))
        ids = np.unique(np.concatenate((i, j)))
        out = np.zeros((len(ids), len(ids)))
        out[np.searchsorted(ids, i), np.searchsorted(ids, j)] = d
    if not np.allclose(out, out.T, rtol=0, atol=tolerance):
        raise ValueError("a precomputed matrix must be symmetric")
    if zero_diagonal and np.abs(np.diag(out)).max(initial=0) > tolerance:
        raise ValueError("a distance matrix must have a zero diagonal")
    return ids, out


def labelled(spark: SparkSession, ids: np.ndarray, **columns: np.ndarray) -> DataFrame:
    """(id, columns...) of driver-side results."""
    return spark.createDataFrame(pa.table({"id": pa.array(ids)} | {k: pa.array(v) for k, v in columns.items()}))
