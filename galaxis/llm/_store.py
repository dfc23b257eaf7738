"""The folder that the driver and all executors share, tables and files in it, and Arrow text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine for a local master only."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not (base := getattr(shared_root, "own", None)):
            base = shared_root.own = f"file://{tempfile.mkdtemp(prefix='galaxis-')}"
            sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/galaxis/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder and read again, which cuts its lineage; and the table's place."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    jvm = spark._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_file(folder: str, name: str, parts: Iterable[bytes]) -> int:
    """Write a file of the shared folder from a task, under a name of its own until it is whole: a task that runs
    twice or dies midway leaves no half file. Returns its bytes."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    own, size = f"{base}/.{name}.{uuid.uuid4().hex}", 0
    with store.open_output_stream(own, compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    store.move(own, f"{base}/{name}")
    return size


def open_file(folder: str, name: str):
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    return store.open_input_file(f"{base}/{name}")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, data


def pieces(offsets: np.ndarray, most: int) -> Iterable[tuple[int, int]]:
    """Ranges of rows of about `most` bytes of text; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def unused(frame: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes to be none of frame's columns in any spelling."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def names_of(frame: DataFrame) -> list[str]:
    """The columns of a frame, quoted, so that names with dots are found."""
    return [f"`{c.replace('`', '``')}`" for c in frame.columns]


def mapped(frame: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """frame.mapInArrow for columns of any name, also with dots; run sees them by position."""
    return frame.toDF(*(f"_{i}" for i in range(len(frame.columns)))).mapInArrow(run, schema)


def slim() -> None:
    """Give memory that a worker has freed back to the system, as workers are used again by other stages."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


@lru_cache(1)
def _libc():
    import ctypes

    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if libc.malloc_trim else None
    except (OSError, AttributeError):  # another C library
        return None


def slices(column: pa.Array, most: int) -> Iterable[tuple[int, int]]:
    """Ranges of rows of a text column of about `most` bytes."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return pieces(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), most)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
