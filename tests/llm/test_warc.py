import hashlib
import random

import pytest

warc = pytest.importorskip("galaxis.llm.warc")


def test_round_trip_and_revisits(spark, tmp_path):
    rng = random.Random(1)
    big = ["<p>" + "".join(rng.choice("abcé \r\n") for _ in range(1500)) for _ in range(5)]
    rows = [(i, f"https://x.org/{i}\nq", rng.choice(big), "s") for i in range(60)] + [(100 + i, None, "small", "s") for i in range(3)]
    rows += [(200, "u", None, "s"), (201, "u", "", "s"), (None, "u", big[0], "s"), (59, "twice", rng.choice(big), "s"), (300, "u", "z" * 300_000, "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    folder = f"file://{tmp_path}/w"
    names = warc.write(pages, folder)
    got = warc.read_back(spark, folder, names, payloads=True).collect()
    largest = {}
    for i, _, html, _ in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            largest[html] = max(i, largest.get(html, -1))
    want = []
    for i, url, html, _ in rows:
        data = (html or "").encode()
        first = largest.get(html)
        visit = first is not None and first != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if visit else "response", first if visit else None, url and url.replace("\n", "%0A"), b"" if visit else data))
    key = lambda r: repr(r)
    assert sorted([(*r[:6], bytes(r[6])) for r in got], key=key) == sorted(want, key=key)
    assert any(w[3] == "revisit" for w in want)


def test_archives_begin_with_their_dictionary(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "some text " * 50 + str(i)) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/w"
    (name,) = warc.write(pages, folder)
    raw = (tmp_path / "w" / name).read_bytes()
    assert raw[:4] == bytes.fromhex("5d2a4d18") and len(raw) < 200 * 300
    assert len(list(warc.records(warc.open_file(folder, name)))) == 200
    assert warc.read_back(spark, folder, warc.write(pages.limit(0), folder)).count() == 0


def test_more_repeated_payloads_than_are_broadcast(spark):
    from collections import defaultdict

    body = lambda k: f"<p>{k}</p>" * 200
    rows = [(i, f"http://x/{i}", body(i % 3 if i % 2 else i % 40)) for i in range(300)] + [(1000, "u", None), (1001, "u", "short"), (1002, "u", "short")]
    largest = defaultdict(int)
    for i, _, html in rows:
        largest[html] = max(largest[html], i)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (1000, 5):
        typed, _ = warc.with_types(pages, most=most)
        got = {r.page_id: r.refers_to for r in typed.collect()}
        assert got == {i: None if i == largest[html] or len(html or "") < 1000 else largest[html] for i, _, html in rows}
