import random

import pytest

uf = pytest.importorskip("galaxis.llm.url_filter")


def hand(url):
    """(host, path, rule, verdict of the list) by plain string work."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


URLS = [None, "", "no scheme", "http://", "https://WWW.Example.COM/en/1?x=1#y", "https://m.example.com/en/1", "http://a.net/fr/x", "http://notnet/fr/x", "ftp://x.org?q=/en/", "http://example.com", "http://x.com/#/en/", "a://b://c.net/es/", "http://É.net/es/", "http://x.com/\n?z", "http://y.org/" + "a/" * 3000]


def test_hosts_paths_and_list(spark):
    pages = spark.createDataFrame([(i, u, "html", 1) for i, u in enumerate(URLS)], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in uf.filtered(pages).collect()}
    for i, url in enumerate(URLS):
        host, path, rule, verdict = hand(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert verdict is None or got[i].verdict == verdict
    assert got[0].verdict == got[2].verdict == "allow"
    assert uf.filtered(pages.limit(0)).count() == 0


def brute_rules(rows, mining):
    from itertools import combinations

    sets = {c for names, _ in rows for k in range(1, mining.most_tokens + 1) for c in combinations(sorted(names), k)}
    good = set()
    for c in sets:
        have = [label for names, label in rows if set(c) <= set(names)]
        for label in set(have):
            n = have.count(label)
            if n >= mining.support * len(rows) and n >= mining.confidence * len(have):
                good.add((c, label))
    return {(c, label) for c, label in good if not any((s, label) in good for k in range(1, len(c)) for s in combinations(c, k))}


def test_mined_rules_and_index_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        names = sorted(rng.sample("abcdefg", rng.randrange(1, 5)))
        rows.append((names, "block" if "a" in names and "b" in names or rng.random() < 0.05 else "allow"))
    mining = uf.Mining(least_rows=0, support=0.02, confidence=0.85)
    rules = uf.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), mining)
    assert {(r.tokens, r.label) for r in rules} == brute_rules(rows, mining)
    index = uf.Index(rules)
    for names, _ in rows:
        assert index.fits(names) == [r for r in rules if set(r.tokens) <= set(names)]


def test_mined_rules_judge_open_urls(spark):
    rows = [(i, f"http://{h}.org/{p}/{i}") for i in range(200) for h, p in (("spam", "buy"), ("fine", "read"))]
    urls = uf.with_tokens(spark.createDataFrame(rows, "page_id long, url string").withColumns(dict(zip(("host", "path"), uf.host_path(), strict=True))))
    labelled = urls.withColumn("label", uf.F.when(uf.F.col("url").contains("spam"), "block").otherwise("allow")).where("page_id < 100")
    got = uf.judge(urls, uf.mine(labelled)).collect()
    assert all((r.mined_verdict == "block") == ("spam" in r.url) for r in got)
    assert uf.mine(labelled.limit(0)) == []


def test_all_labelled_rows_count_however_many(spark):
    F = uf.F
    kind = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 500))
    rows = spark.range(240_000).select(F.array(kind).alias("tokens"), F.when(F.col("id") % 3 == 0, "block").otherwise("allow").alias("label"))
    hot = [r for r in uf.mine(rows) if r.tokens == ("hot",)]
    assert [(r.label, r.confidence, r.support) for r in hot] == [("block", 1.0, 80_000 / 240_000)]


def test_all_parts_of_a_url_are_tokens(spark):
    long = "a" * 64
    parts = {
        "http://x.org/2024/05/12/{}": ("casino-bonus", "garden-notes"),
        "http://{}.a.b.c.d.org/z": ("spam", "fine"),
        "http://y.org/?a=1&b=2&c=3&{}=4": ("aff", "page"),
        "http://z.org/{}/1": (long + "-buy", long + "-read"),
        "http://w.org/f.{}": ("a" * 16 + "exe", "a" * 16 + "txt"),
    }
    for form, (bad, good) in parts.items():
        rows = [(2 * i + k, form.format(x)) for i in range(60) for k, x in enumerate((bad, good))]
        labels = spark.createDataFrame([(i, "allow" if i % 2 else "block") for i in range(80)], "page_id long, label string")
        got = uf.filtered(spark.createDataFrame(rows, "page_id long, url string"), labels, rules=()).collect()
        assert len(got) == 120 and all(r.verdict == ("allow" if r.page_id % 2 else "block") for r in got), form


def test_block_rules_stay_beside_many_allow_rules(spark):
    many = [([f"t{i}"], "allow") for i in range(20_001)]
    rows = many + [(["a", "b"], "block")] * 3 + [(["a"], "allow"), (["b"], "allow")]
    labelled = spark.createDataFrame(rows, "tokens array<string>, label string")
    mining = uf.Mining(least_rows=1, support=0.0)
    urls = spark.createDataFrame([(["a", "b"],), (["a"],)], "tokens array<string>")
    assert {tuple(r.tokens): r.mined_verdict for r in uf.judge(urls, uf.mine(labelled, mining)).collect()} == {("a", "b"): "block", ("a",): "allow"}
    assert [(r.tokens, r.label) for r in uf.mine(labelled, mining, only="block")] == [(("a", "b"), "block")]


def test_tokens_that_always_occur_together_stand_for_each_other(spark):
    """Thirty names of a template would have 2**30 subsets."""
    form = [f"k{i:02d}" for i in range(30)]
    rows = [([*form, "bad"], "block")] * 12 + [(form, "allow")] * 30 + [(["bad"], "allow")] * 30 + [(["other"], "allow")] * 9
    rules = uf.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), uf.Mining(least_rows=2, support=0.01), only="block")
    assert [(r.tokens, r.label, r.confidence) for r in rules] == [(("bad", "k00"), "block", 1.0)]
    index = uf.Index(rules)
    assert index.fits(["k17", "bad"]) and index.fits(["bad", *form]) and not index.fits(form) and not index.fits(["bad", "other"])


def test_query_equals_brute_force_with_labels(spark, tmp_path):
    """The whole query on a small table: the list, labels by id, rules over all tokens, verdicts."""
    rng = random.Random(21)
    urls = list(URLS)
    for _ in range(2500):
        host = rng.choice(["a.org", "b.org", "shop.c.org", "d.net", "www.example.com", "x.com", "e.f.g.h.org"])
        path = "/".join(rng.choice(["casino", "news", "2024", "p1", "fr", "es", "en", "x.html"]) for _ in range(rng.randrange(4)))
        urls.append(f"http{rng.choice(['', 's'])}://{host}/{path}{rng.choice(['', '', '?id=3&ref=q', '#top'])}")
    pages = [(i, u) for i, u in enumerate(urls)] + [(None, urls[-1]), (3, urls[-2])]
    bad = lambda u: "casino" in (u or "") and "ref=" in (u or "") or "shop" in (u or "") and rng.random() < 0.97
    labels = [(i, 1, 1 if bad(u) else 0) for i, u in enumerate(urls) if i % 2] + [(21, 0, 0), (None, 0, 1), (25, None, None)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    label = {}
    for i, quality, toxic in labels:
        if i is not None:
            label[i] = "block" if toxic == 1 or quality == 0 or label.get(i) == "block" else "allow"
    known, want = [], []
    for i, u in pages:
        host, path, rule, verdict = hand(u)
        names = uf.tokens(u, host, path)
        want.append((i, host, path, rule, verdict, names))
        own = verdict or label.get(i)
        if own and names:
            known.append((names, own))
    mining = uf.Mining()
    least = max(mining.least_rows, mining.support * len(known))
    from collections import Counter
    from itertools import combinations

    total, hits = Counter(), Counter()
    for names, own in known:
        for c in (c for k in range(1, mining.most_tokens + 1) for c in combinations(sorted(set(names)), k)):
            total[c] += 1
            hits[c] += own == "block"
    good = {c for c in total if hits[c] >= least and hits[c] / total[c] >= mining.confidence}
    assert any(len(c) > 1 and not any(s in good for k in range(1, len(c)) for s in combinations(c, k)) for c in good)
    fits = lambda names: any(set(c) <= set(names) for c in good)
    want = [(i, host, path, rule, verdict or ("block" if fits(names) else "allow")) for i, host, path, rule, verdict, names in want]
    got = uf.op3_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {"block", "allow"} == {w[4] for w in want if w[3] is None}
