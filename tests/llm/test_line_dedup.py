import random
from collections import defaultdict

import pytest

ld = pytest.importorskip("galaxis.llm.line_dedup")
WHITE = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=20, min_docs=3):
    """Sorted (id, number of lines, kept text)."""
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(WHITE))
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(ld.NO_ID if i is None else i)
    out = []
    for i, text in rows:
        found = (text or "").split("\n")
        own = ld.NO_ID if i is None else i
        kept = [x for x in found if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == own]
        out.append((own, len(found), "\n".join(kept)))
    return sorted(out)


def ours(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = ld.apply_bitmaps(docs, ld.keep_bitmaps(docs)).collect()
    return sorted((ld.NO_ID if r.doc_id is None else r.doc_id, r.text or "") for r in got)


def fixture(seed, n=120):
    rng = random.Random(seed)
    pool = ["A line of quite some length", "  a LINE of quite some length\t", "ÉTÉ été été été été été", "été", "x" * 19, "y" * 20, "\x0b" + "z" * 25, "hot line in nearly every document"]
    pool += [f"rare line number {i} of them all" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(8)))) for i in range(n)]
    return rows + [(None, pool[0]), (None, pool[-1]), (7, rows[7][1]), (7, "hot line in nearly every document\nnew"), (500, None), (501, ""), (502, "q\n" * 5000 + pool[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = fixture(seed)
    assert ours(spark, rows) == sorted((i, t) for i, _, t in brute(rows))


def test_key_over_many_partitions_and_batches(spark):
    """Ranges cut a hot key into several partitions; Arrow batches cut it again."""
    rows = [(i, "the same hot line everywhere\nown line of document %05d" % i) for i in range(900)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert ours(spark, rows) == sorted((i, t) for i, _, t in brute(rows))
        assert ours(spark, fixture(3)) == sorted((i, t) for i, _, t in brute(fixture(3)))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_bitmaps_stage_and_empty_table(spark):
    rows = [(i, "short\nthis line stands in all four documents", "en", 3) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, h1 int")
    got = {r.doc: r for r in ld.keep_bitmaps(docs).collect()}
    assert sorted(got) == [0, 1, 2] and ld.unpack(got[0].keep, got[0].n_lines).tolist() == [True, False]
    out = ld.drop_lines(spark, docs, "")
    assert out.columns == docs.columns and out.where("text = 'short'").count() == 3
    assert ld.drop_lines(spark, docs.limit(0), "").count() == 0


def test_stage_keeps_columns_of_any_name(spark):
    line = "this line stands in all four documents"
    rows = [(i, f"short\n{line}", n, 2 + i, "d", 9, "x", b"k", 1.5) for i, n in enumerate([len(line) + 6, 7, None, len(line) + 6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, __n int, __doc string, doc int, __keep string, keep binary, N double")
    got = ld.drop_lines(spark, docs.withColumnRenamed("doc", "mark.doc"), "")
    assert got.columns == ["doc_id", "text", "n_chars", "__n", "__doc", "mark.doc", "__keep", "keep", "N"]
    want = [(i, "short" if i < 3 else r[1], 5 if i == 0 else r[2], *r[3:]) for i, r in enumerate(rows)]
    assert sorted(map(tuple, got.collect())) == want
    few = docs.select("doc_id", "text", ld.F.lit("many").alias("n_chars"))
    assert {r.n_chars for r in ld.drop_lines(spark, few, "").collect()} == {"many"}
