import random

import pytest

bpe = pytest.importorskip("galaxis.llm.bpe")
tokenizers = pytest.importorskip("tokenizers")

ODD = ["", " ", "\n\n  a", "a  b   c \t\n", "it's we'll I'D", "aaaaaaaaaaaaaaaa" * 50, "   x y　", "\x1c\x1d a", "é́ ñandú Straße", "日本語 テキスト", "😀👍🏽 ok", "x<|endoftext|> y<|endoftext|>", "١٢٣ 42½", "a" * 5000, "﻿z​", "<|endoftext", "ab " * 3000, "\x00\x01", "x\u0085y", "123 4567   ", "!!! ###$$$ %%%&&&"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_text_as_the_library(library):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab cé'\n\t19#ß語 sTre") for _ in range(rng.randrange(200))) for _ in range(400)]
    ours = bpe.ByteBPE(bpe.tokenizer_path("byte_bpe_50k.json"))
    for text, (ids, shown) in zip(texts, ours.encode_batch(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text[:40]
        assert shown == ",".join(map(str, want))
        assert ours.decode(ids) == library.decode(want, skip_special_tokens=False) == text


def test_lower_rank_made_by_a_merge_goes_first():
    """A merge may make a pair of a lower rank, which must go before the merge's later places in the word."""
    ours = bpe.ByteBPE.__new__(bpe.ByteBPE)
    a, b, c = b"abc"
    merges = [(300, c, 301), (b, c, 302), (a, b, 300), (301, a, 303), (a, a, 304), (304, a, 305)]
    ours._merges(list(range(256)), merges)
    rank = {(x, y): (r, m) for r, (x, y, m) in enumerate(merges)}

    def plain(word):
        s = list(word)
        while True:
            found = min(((rank[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in rank), default=None)
            if found is None:
                return tuple(s)
            i = found[1]
            s[i : i + 2] = [rank[s[i], s[i + 1]][1]]

    rng = random.Random(1)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(500)}
    ours.learn(sorted(words))
    assert all(ours.known[w][0] == plain(w.encode()) for w in words)


def test_frame_round_trip_and_clashing_names(spark):
    rows = [(1, "one two", 7), (2, None, 8), (3, "", 9), (3, "x" * 300, 9), (None, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    path = bpe.tokenizer_path("byte_bpe_50k.json")
    got = bpe.decoded(bpe.encoded(docs, path), path).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((a or 0, b or "") for a, b, _ in rows)
    assert bpe.digests(docs.limit(0), path).count() == 0
    assert {r.n_tokens for r in bpe.digests(docs.where("doc_id = 2"), path).collect()} == {0}


def test_many_distinct_words_take_bounded_memory(library):
    """200,000 distinct pre-tokens: what is remembered stays within its bound, and ids are as the library's."""
    import tracemalloc

    rng = random.Random(7)
    ours = bpe.ByteBPE(bpe.tokenizer_path("byte_bpe_50k.json"))
    texts = [" ".join("%s%d" % (rng.choice(["éa", "b-", "word", "Q"]), rng.randrange(10**9)) for _ in range(1000)) for _ in range(200)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    tracemalloc.start()
    try:
        for text, ids in zip(texts, want, strict=True):
            assert next(ours.encode_batch([text]))[0] == ids
            assert ours.held <= bpe.KNOWN_BYTES + 1024 * 1024 and len(ours.store) < 200_000
        assert tracemalloc.get_traced_memory()[0] < 64 << 20
    finally:
        tracemalloc.stop()


def test_query_equals_the_library(spark, library):
    import hashlib
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.op8_bpe(spark, folder).collect())) == sorted(want)
