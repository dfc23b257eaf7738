import math
import random

import pytest

tk = pytest.importorskip("galaxis.llm.topk_search")


def brute(rows, k):
    """rows: (id, integers)."""
    queries = {}
    for i, v in rows:
        if i % 5 == 0:
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, a in queries.items():
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tk, "CHUNK", 37)
    rng = random.Random(6)
    vectors = [(i, [rng.choice([0.0, 0.0, 0.5, -0.25, 1.0]) for _ in range(rng.choice([0, 3, 6]))], 1) for i in range(150)]
    vectors += [(7, [1.0] * 6, 1), (10, [0.5, 0.5], 1), (999, None, 1), (1000, [None, 1.0], 1), (1005, [float("nan")], 1), (1010, [float("inf")], 1), (None, [1.0], 1)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, v int").repartition(3)
    got = tk.sound(frame, "vec_id", "embedding", 256)
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert sorted(map(tuple, tk.top_k(got.where("vec_id % 5 = 0"), got, 5).collect())) == brute(rows, 5)


def test_few_rows_and_none(spark):
    frame = tk.sound(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding", 256)
    got = sorted(map(tuple, tk.top_k(frame.where("vec_id = 0"), frame, 5).collect()))
    assert got == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    assert tk.top_k(frame.limit(0), frame.limit(0), 5).count() == 0
    assert tk.top_k(frame.where("vec_id = 9"), frame, 5).count() == 0


def exact(vectors, queries, k):
    """All scores as Python integers."""
    out = []
    for q, v in queries:
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in vectors if i != q)
        out += [(q, rank + 1, i, -score) for rank, (score, i) in enumerate(found[:k])]
    return sorted(out)


def test_large_components_keep_their_ranks(spark):
    rows = [(0, [1.0]), (1, [1e6]), (2, [2e6]), (3, [3e6]), (4, [-3e6]), (50, [1e-3])]
    frame = tk.sound(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 256)
    got = tk.top_k(frame.where("vec_id = 0"), frame, 3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, 196_608_000_000), (2, 131_072_000_000), (1, 65_536_000_000)]


def test_products_beyond_64_bits(spark):
    big = 2.0**45
    rows = [(0, [big, -big, 1.0]), (1, [big, big, 3.0]), (2, [big, big, 2.0]), (3, [1.0, 0.0, 0.0]), (4, [])]
    frame = tk.sound(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 256)
    whole = [(i, [int(256 * x) for x in v]) for i, v in rows]
    got = tk.top_k(frame.where("vec_id = 0"), frame, 4).collect()
    assert sorted(map(tuple, got)) == exact(whole, whole[:1], 4)
    over = tk.sound(spark.createDataFrame([(0, [2.0**50]), (1, [2.0**50])], "vec_id long, embedding array<double>"), "vec_id", "embedding", 256)
    with pytest.raises(Exception, match="doesn't fit"):
        tk.top_k(over, over, 1).collect()
    huge = tk.sound(spark.createDataFrame([(0, [2.0**60]), (1, [1.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding", 256)
    with pytest.raises(Exception, match="doesn't fit"):
        tk.top_k(huge, huge, 1).collect()


def test_many_chunks_and_lengths(spark):
    import random

    rng = random.Random(9)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, 1.0]) for _ in range(rng.randrange(9))]) for i in range(400)]
    frame = tk.sound(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 256)
    whole = [(i, [int(256 * x) for x in v]) for i, v in rows]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = tk.top_k(frame.where("vec_id % 50 = 0"), frame, 5, (11, 64)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert sorted(map(tuple, got)) == exact(whole, [x for x in whole if x[0] % 50 == 0], 5)
