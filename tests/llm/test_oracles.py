"""Every opN_ query that SQL can express, over the smallest tables and over odd rows, against its SQL."""

import os

import pytest

registry = pytest.importorskip("galaxis.llm.registry")
duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"
TABLES = {"op1_preference": "conversations", "op5_warc": "pages", "op6_topk_search": "embeddings"}
ODD = {
    "documents": (
        "doc_id long, text string, lang string, source string, n_chars long, kept string, node int, epoch double",
        [(1, None, "en", "src0", 0, "k", 1, 0.5), (2, "", None, None, 0, "k", 2, 0.5), (3, " \t\n\x0b", "de", "src7", 4, None, None, None), (4, "one", "xx", "blog", 3, "k", 4, 1.5)]
        + [(10 + i, "the same long line stands in all of these\n" + "w " * (i % 5 * 40) + "é ß 日本 😀 é #$%", "fr", "src1", 1, "k", i, 2.0) for i in range(12)]
        + [(100 + i, " ".join(f"t{(j * 7 + (j == 3) * i) % 90}" for j in range(120)), "en", "src0", 1, "k", i, 2.0) for i in range(10)]
        + [(200, "long words and lines " * 300, "es", "src3", 1, "k", 0, 0.0), (201, "x" * 400_000 + " y", "es", "src3", 1, "k", 0, 0.0)],
    ),
    "pages": (
        "page_id long, url string, html string, digest string, first_id int",
        [(1, None, None, "d", 1), (2, "u", "", "d", 1), (3, "http://a.b/c", "é" * 600, "d", 1), (4, "x", "é" * 600, None, None), (5, "x", "z" * 999, "d", 1), (6, "x", "z" * 999, "d", 1), (7, "y\r\nq", "z" * 2_000_000, "d", 1)],
    ),
    "embeddings": (
        "vec_id long, embedding array<float>, v int, score long",
        [(i, [float((i * 37 + j * 11) % 9 - 4) / 8 for j in range(8)], 1, 2) for i in range(120)]
        + [(200, None, 1, 2), (250, [None, 1.0] + [0.0] * 6, 1, 2), (300, [float("nan")] + [0.0] * 7, 1, 2), (350, [float("inf")] + [0.0] * 7, 1, 2), (400, [1e6] * 8, 1, 2), (401, [-1e6] * 8, 1, 2), (402, [2e6] * 8, 1, 2)],
    ),
    "conversations": (
        "conv_id long, turn long, role string, text string, prompt string, n int",
        [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c} é", "p", 1) for c in range(8) for t in range(c)] + [(20, 0, None, None, None, None), (21, 0, "user", None, "p", 1), (21, 1, "assistant", "", "p", 1)],
    ),
}


def held(spark, name, folder):
    got = registry.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for file in os.listdir(folder):
        table = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{file}{'/*.parquet' if os.path.isdir(f'{folder}/{file}') else ''}')")
    want = con.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = [tuple(str(x) for x in r) for r in got.select(*names).collect()]
    assert sorted(rows) == sorted(tuple(str(x) for x in r) for r in want.fetchall())
    return len(rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert held(spark, name, DIR) > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_odd_rows_and_extra_columns(spark, name, tmp_path):
    table = TABLES.get(name, "documents")
    schema, rows = ODD[table]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/a/{table}.parquet")
    assert held(spark, name, f"{tmp_path}/a") > 0
    spark.createDataFrame(rows, schema).limit(0).write.parquet(f"{tmp_path}/b/{table}.parquet")
    assert registry.QUERIES[name](spark, f"{tmp_path}/b").count() == 0
