"""Incremental SOM training from Structured Streaming.

A model is a folder of versions, one small JSON table for each micro-batch. foreachBatch reads the version before its
own, trains on the batch and writes its own, so a batch that is run again gives the same version: the sink is
idempotent, and a query that starts again goes on where its checkpoint stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from galaxis.operators.som import SOM
from galaxis.sources import frames


def _path(folder: str, version: int) -> str:
    return f"{folder.rstrip('/')}/version={version}"


def save_version(spark: SparkSession, folder: str, version: int, som: SOM) -> None:
    spark.createDataFrame([(som.to_json() if som.weights_ is not None else "",)], "model string").coalesce(1).write.mode("overwrite").parquet(_path(folder, version))


def load_version(spark: SparkSession, folder: str, version: int) -> SOM | None:
    """None where no model has been trained yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(_path(folder, version))
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    text = spark.read.parquet(_path(folder, version)).first()["model"]
    return SOM.from_json(text) if text else None


def train_batch(template: Callable[[], SOM], folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for point frames (id, features). A batch is gathered, so its size must be bounded by the
    source's options (maxFilesPerTrigger, maxOffsetsPerTrigger)."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        som = load_version(spark, folder, number - 1) or template()
        if not som.online_mode:
            som.enable_streaming_mode()
        _, x = frames.matrix(batch)
        save_version(spark, folder, number, som.partial_fit_array(x))

    return step


def start(points: DataFrame, template: Callable[[], SOM], folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Train on a stream of points. template makes an untrained SOM."""
    writer = points.writeStream.foreachBatch(train_batch(template, folder)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stats_frame(spark: SparkSession, som: SOM) -> DataFrame:
    s = som.streaming_stats()
    return spark.createDataFrame([tuple(s.values())], "total_samples long, virtual_epoch long, current_learning_rate double, current_radius double, latest_quantization_error double")


def event_points(events: DataFrame, scale: float = 100.0) -> DataFrame:
    """Points of an event table: the value over a scale, and the hour of the day."""
    return events.select(F.col("event_id").alias("id"), F.array(F.col("value").cast("double") / scale, F.hour("ts").cast("double") / 24).alias("features")).where("features[0] IS NOT NULL AND features[1] IS NOT NULL")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling windows; on a stream, state older than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
