import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

mixing = pytest.importorskip("galaxis.llm.mixing")


def fill(budget, children):
    """Share a budget: names to (weight, cap); the level rises until the budget is spent or all are full."""
    got, open_ = {}, dict(children)
    left = budget
    while open_:
        level = Fraction(left, sum(w for w, _ in open_.values()))
        full = {k for k, (w, c) in open_.items() if c <= level * w}
        if not full:
            got.update({k: int(level * w) for k, (w, _) in open_.items()})
            break
        for k in full:
            got[k] = open_[k][1]
            left -= open_.pop(k)[1]
    return got


def brute(rows, mix):
    leaves, docs = defaultdict(int), defaultdict(list)
    for i, text, lang, source in rows:
        found = re.fullmatch("src([0-9]{1,6})", source or "")
        k = int(found[1]) // mix.per_domain if found else 99
        leaf = (mix.domains[k] if k < len(mix.domains) else "other", lang, source)
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        leaves[leaf] += n
        docs[leaf].append((i, n))
    cap = lambda *start: sum(s for leaf, s in leaves.items() if leaf[: len(start)] == start) * mix.max_epochs
    total = sum(leaves.values()) * mix.share[0] // mix.share[1]
    out = []
    for d, b in fill(total, {x: (mix.domain_weights.get(x, 1), cap(x)) for x in {k[0] for k in leaves}}).items():
        for lang, b2 in fill(b, {x: (mix.lang_weights.get(x, 1), cap(d, x)) for x in {k[1] for k in leaves if k[0] == d}}).items():
            for s, b3 in fill(b2, {x: (mix.source_weights.get(x, 1), cap(d, lang, x)) for x in {k[2] for k in leaves if k[:2] == (d, lang)}}).items():
                leaf = (d, lang, s)
                whole = min(b3 // leaves[leaf], mix.max_epochs) if leaves[leaf] else 0
                rest = b3 - whole * leaves[leaf]
                key = lambda i: hashlib.md5(f"{mix.seed}|{whole + 1}|{'null' if i is None else i}".encode()).hexdigest()  # noqa: B023, E731
                for i, _ in docs[leaf]:
                    upto = sum(n for j, n in docs[leaf] if key(j) <= key(i))
                    out += [(i, *leaf, e + 1) for e in range(whole + (rest > 0 and upto <= rest))]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,share,epochs", [(1, (1, 2), 3), (2, (9, 10), 1), (3, (3, 2), 2), (4, (5, 1), 2)])
def test_equals_brute_force(spark, seed, share, epochs):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 3, 10, 200]), rng.choice(["en", "en", "de", None, "xx"]), rng.choice(["src0", "src0", "src0", "src7", "src19", "src77", None, "blog"])) for i in range(300)]
    rows += [(5, "w w", "en", "src0"), (None, "w " * 9, "en", "src0"), (900, None, "fr", "src3")]
    mix = mixing.Mix(share=share, max_epochs=epochs, source_weights={"src0": 3})
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("m_lang", mixing.F.lit(1))
    got = mixing.mixed(docs, mix).select("doc_id", "m_domain", "lang", "source", "epoch").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, mix)


def test_stage_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", "src1", 5) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix_stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == 45
    assert mixing.mix_stage(spark, docs.limit(0), "").count() == 0


def test_columns_of_any_name_and_many_equal_ids(spark):
    rows = [(i if i % 3 else None, "a b c", "en", "src1", i, "x", 1.5, None, 7) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int, m_full string, m_last double, doc string, n int")
    docs = docs.withColumnRenamed("n", "m.n").withColumn("m_domain", mixing.F.lit("own"))
    out = mixing.mix_stage(spark, docs, "")
    assert out.schema.names == docs.schema.names
    got = sorted(map(tuple, out.collect()), key=repr)
    want = {r[0] for r in mixing_ids(rows)}
    assert got == sorted(((*r, "own") for r in rows if r[0] in want), key=repr)
    assert mixing.mixed(docs, mixing.PIPELINE).columns == [c for c in docs.columns if c not in ("epoch", "m_domain")] + ["m_domain", "m_lang", "m_source", "epoch"]


def mixing_ids(rows):
    return brute([(i, t, lang, s) for i, t, lang, s, *_ in rows], mixing.PIPELINE)


def test_more_digits_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 0.0001)
    rows = [(i, "w " * (i % 7), "en", "src1") for i in range(200)]
    mix = mixing.Mix(share=(1, 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixed(docs, mix).select("doc_id", "m_domain", "lang", "source", "epoch").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, mix)
