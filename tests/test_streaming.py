import numpy as np

from galaxis.operators.som import SOM
from galaxis.sources import frames
from galaxis.streaming import som_stream


def template():
    return SOM(3, 2, random_state=4)


def test_stream_equals_the_same_batches(spark, tmp_path):
    rng = np.random.RandomState(0)
    parts = [rng.standard_normal((40, 2)) for _ in range(3)]
    for k, x in enumerate(parts):
        frames.from_rows(spark, x).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(frames.POINTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    model = str(tmp_path / "model")
    query = som_stream.start(stream, template, model, str(tmp_path / "check"), available_now=True)
    assert query.awaitTermination(120)
    got = som_stream.load_version(spark, model, 2)
    assert got.total_samples_learned == 120 and som_stream.load_version(spark, model, 7) is None
    assert som_stream.stats_frame(spark, got).first()["total_samples"] == 120


def test_a_batch_that_runs_again_gives_the_same_version(spark, tmp_path):
    step = som_stream.train_batch(template, str(tmp_path / "m"))
    a, b = (frames.from_rows(spark, np.random.RandomState(s).standard_normal((30, 2))) for s in (1, 2))
    step(a, 0)
    step(b, 1)
    once = som_stream.load_version(spark, str(tmp_path / "m"), 1).weights()
    step(b, 1)
    assert (som_stream.load_version(spark, str(tmp_path / "m"), 1).weights() == once).all()
    step(a.limit(0), 2)
    assert (som_stream.load_version(spark, str(tmp_path / "m"), 2).weights() == once).all()


def test_windows_with_watermark(spark):
    rows = [(1, "2024-01-01 00:10:00", "a", 2.0), (2, "2024-01-01 00:50:00", "a", 3.0), (3, "2024-01-01 01:00:00", "b", None)]
    events = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").selectExpr("event_id", "timestamp(t) AS ts", "event_type", "value")
    got = sorted((r.event_type, r.n, r.total) for r in som_stream.windowed_counts(events).collect())
    assert got == [("a", 2, 5.0), ("b", 1, None)]
    assert som_stream.event_points(events).count() == 2
