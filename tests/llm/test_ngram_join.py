import random
import re

import numpy as np
import pytest

nj = pytest.importorskip("galaxis.llm.ngram_join")


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute(rows, words, percent):
    """Sorted (id, size, component); ids may repeat."""
    sets = [shingle_set(t, words) for _, t in rows]
    ids = [nj.NO_ID if i is None else i for i, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((ids[k], len(sets[k]), least[find(k)]) for k in range(len(rows)))


def texts(seed, n=220):
    """Texts of all lengths with copies that lose, change or gain a few words, around and beyond the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice([1, 2, 3])))
    out = [None, "", "  \n\t", "one", "ONE", "one two", "one two three", "one two three four", "One Two three FOUR\x0b"]
    bases = [[word() for _ in range(rng.choice([4, 6, 9, 12, 20, 40, 100, 300]))] for _ in range(25)]
    common = [word() for _ in range(60)]
    while len(out) < n:
        base = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            at = rng.randrange(len(base))
            base[at : at + rng.choice([0, 1])] = rng.choice([[], [word()]])
            base = base or ["x"]
        if rng.random() < 0.3:
            base += common
        out.append(rng.choice([" ", "\n", "  "]).join(base))
    return out


@pytest.mark.parametrize("seed,words,percent", [(1, 4, 85), (2, 5, 80), (3, 4, 85), (4, 2, 70)])
def test_components_equal_brute_force(spark, seed, words, percent):
    rows = list(enumerate(texts(seed)))
    rows += [(None, rows[20][1]), (None, "only here and nowhere else at all"), (3, rows[30][1]), (20, rows[20][1])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int").repartition(3)
    got = nj.linked_components(docs, nj.Likeness(words, percent)).select("id", "n", "component").collect()
    assert sorted(map(tuple, got)) == brute(rows, words, percent)


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_linked_sets_share_a_key(words, percent):
    """Every pair that is similar enough shares a key in some scheme, at all sizes, also at the very threshold."""
    rng = np.random.default_rng(5)
    like = nj.Likeness(words, percent)
    top = nj.Likeness.edges(like, 3000)
    edges, found = nj.schemes(like, {b: 10_000 for b in range(len(top))})
    for size in [7, 8, 9, 10, 11, 12, 14, 17, 20, 24, 30, 45, 70, 100, 150, 400, 1500]:
        for _ in range(60 if size < 200 else 8):
            a = rng.integers(0, 2**64, size, dtype=np.uint64)
            gain = int(rng.integers(0, size // 3 + 1))
            lose = int(rng.integers(0, size // 3 + 1))
            b = np.unique(np.concatenate((a[lose:], rng.integers(0, 2**64, gain, dtype=np.uint64))))
            a = np.unique(a)
            common = len(np.intersect1d(a, b))
            if 100 * common < percent * (len(a) + len(b) - common) or len(a) == len(b) == common:
                continue
            own = []
            for s in (a, b):
                band = int(np.searchsorted(np.array(edges), len(s)))
                own.append({int(k) for x in (band, band - 1) if x in found for k in nj.keys(s, x, found[x])})
            assert own[0] & own[1], (size, len(a), len(b), common)


def test_schemes_have_enough_segments():
    for percent in (70, 80, 85, 95):
        like = nj.Likeness(4, percent)
        edges, found = nj.schemes(like, {b: 1000 for b in range(20)})
        for band, s in found.items():
            high = edges[band]
            assert s.segments + s.deletions - s.slack == like.differ(high, high * 100 // percent) + 1 and s.deletions <= s.segments
            assert band + 1 == len(edges) or edges[band + 1] >= high * 100 // percent


def test_many_near_copies_and_stage(spark):
    rng = random.Random(11)
    base = ["w%d" % rng.randrange(10**6) for _ in range(120)]
    rows = []
    for i in range(400):
        own = list(base)
        for _ in range(3):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own), "en", 5))
    rows += [(1000 + i, "a text of its own number %d and nothing else beside it" % i, "en", 5) for i in range(20)] + [(2000, None, "en", 5), (2001, "", "en", 5), (5000, rows[0][1], "en", 5), (0, rows[0][1], "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, c int").repartition(4)
    got = sorted(tuple(r) for r in nj.linked_components(docs).select("id", "n", "component").collect())
    assert got == brute([r[:2] for r in rows], 4, 85)
    out = nj.drop_near_copies(spark, docs, "")
    kept = {i for i, _, c in brute([r[:2] for r in rows], 5, 80) if c == i}
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(kept)
    assert nj.linked_components(docs.limit(0)).count() == 0 and nj.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_stage_decides_by_row_where_ids_are_null_or_repeat(spark):
    rng = random.Random(12)

    def fresh():
        return ["w%d" % rng.randrange(10**6) for _ in range(40)]

    def near(words):
        return " ".join([*words[:-1], "x%d" % rng.randrange(10**6)])

    one, two, three, four, five, six = (fresh() for _ in range(6))
    own = [" ".join(fresh()) for _ in range(5)]
    rows = [(1, " ".join(one), "en"), (None, near(one), "en"), *((None, x, "en") for x in own[:3])]  # one null id is a near copy
    rows += [(None, " ".join(two), "b"), (None, near(two), "a"), (None, " ".join(three), "b"), (None, " ".join(three), "a")]
    rows += [(7, own[3], "en"), (7, own[4], "en"), (7, near(one), "en"), (8, " ".join(four), "en"), (8, near(four), "en"), (9, near(four), "en")]
    rows += [(10, " ".join(five), "en"), (11, near(five), "en"), (11, " ".join(six), "en"), (12, near(six), "en")]
    rows += [(None, None, "en"), (None, "", "en"), (7, "", "en"), (7, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = [tuple(r) for r in nj.drop_near_copies(spark, docs, "").collect()]
    count = lambda doc_id, *texts: sum(g[0] == doc_id and g[1] in texts for g in got)
    assert set(got) <= set(rows) and sorted(g[1] for g in got if g[0] is None and g[1] in own) == sorted(own[:3])
    assert count(1, rows[0][1]) == 1 and count(None, rows[1][1]) == 0
    assert count(None, rows[5][1], rows[6][1]) == 1 and [g for g in got if g[1] == " ".join(three)] == [(None, " ".join(three), "a")]
    assert sorted(g[1] for g in got if g[0] == 7 and g[1]) == sorted(own[3:])
    assert count(8, rows[12][1], rows[13][1]) == 1 and count(9, rows[14][1]) == 0
    assert sorted(g[0] for g in got if g[0] in (10, 11, 12)) == [10, 11] and count(11, " ".join(six)) == 1
    assert len([g for g in got if not g[1]]) == 4 and len(got) == 15


def test_words_that_break_polynomial_hashes(spark):
    """Sequences that collide for any polynomial modulo 2**64 are different words."""
    morse = ["".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(1024)) for flip in (0, 1)]
    docs = spark.createDataFrame([(1, f"x y z {morse[0]}"), (2, f"x y z {morse[1]}"), (3, f"X y\nz {morse[1]}")], "doc_id long, text string")
    assert sorted(tuple(r) for r in nj.linked_components(docs).select("id", "component").collect()) == [(1, 1), (2, 2), (3, 2)]


def test_sets_with_equal_halves_of_names_stay_apart(spark, monkeypatch):
    """Names have 128 bits, and half of them may collide."""
    monkeypatch.setattr(nj, "_name", lambda s: b"12345678" + nj.xxhash.xxh3_64_digest(s.tobytes()))
    rng = random.Random(13)
    bases = [["w%d" % rng.randrange(10**6) for _ in range(40)] for _ in range(4)]
    rows = [(10 * k + i, " ".join([*b, "x%d" % i])) for k, b in enumerate(bases) for i in range(3)]
    lists = [nj.keys(s, 0, nj.Scheme(4, 1, 1, 0)) for s in nj._sets(nj.pa.array([t for _, t in rows]), 4)]
    run = nj._blocks(nj.Likeness(), nj.Likeness().edges(100), {b: nj.Scheme(4, 1, 1, 0) for b in range(40)}, 3)
    blocks = list(run(iter([nj.pa.RecordBatch.from_arrays([nj.pa.array([t for _, t in rows])], ["text"])])))
    members = [r for b in nj._meet(iter(blocks)) for r in b.to_pylist()]
    assert lists and len({r["name"] for r in members}) == len(rows)
    assert sorted(tuple(r) for r in nj.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).select("id", "component").collect()) == [(i, i - i % 10) for i, _ in rows]


def test_stage_keeps_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 5, "n", {"a": 1}, 1), (2, text, 6, "m", {"b": 1}, 2), (None, "alone here " * 9, 7, None, None, 3), (None, "", 8, "e", {}, 4), (7, text + " x", 9, "r", {}, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, name string, root map<string,int>, row int")
    docs = docs.withColumnRenamed("row", "c.d")
    got = nj.drop_near_copies(spark, docs, "")
    assert got.schema == docs.schema
    assert sorted(got.collect(), key=lambda r: r.id) == [tuple(rows[0]), tuple(rows[2]), tuple(rows[3])]
    assert [tuple(r) for r in nj.drop_near_copies(spark, docs.where("doc_id > 0"), "").collect()] == [rows[0]]
