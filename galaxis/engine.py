"""The session that estimators run on, and all estimators in one place."""

from __future__ import annotations

from pyspark.sql import SparkSession

from galaxis.operators.hierarchy import HDBSCAN, Agglomerative
from galaxis.operators.kmeans import KMeans
from galaxis.operators.pca import PCA
from galaxis.operators.som import SOM
from galaxis.operators.spectral import Spectral

ESTIMATORS = {"kmeans": KMeans, "spectral": Spectral, "agglomerative": Agglomerative, "hdbscan": HDBSCAN, "som": SOM, "pca": PCA}
_held: dict = {}


def init(spark: SparkSession | None = None, **config: str) -> SparkSession:
    """The session to use, made with `config` where none is given or active. A second call with the same configuration
    gives the same session; with another one it is refused."""
    if "spark" in _held:
        if config and config != _held["config"]:
            raise ValueError("the engine has been started with another configuration; reset() it first")
        return _held["spark"]
    session = spark or SparkSession.getActiveSession()
    if session is None:
        builder = SparkSession.builder
        for key, value in config.items():
            builder = builder.config(key.replace("__", "."), value)
        session = builder.getOrCreate()
    _held.update(spark=session, config=config)
    return session


def is_initialized() -> bool:
    return "spark" in _held


def reset() -> None:
    """Forget the session; it isn't stopped."""
    _held.clear()


def platform() -> dict[str, str | int | bool]:
    """What the session runs on."""
    sc = init().sparkContext
    return {"master": sc.master, "version": sc.version, "parallelism": sc.defaultParallelism, "local": sc.master.startswith("local")}
