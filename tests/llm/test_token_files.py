import random
import zlib

import numpy as np
import pytest

tf = pytest.importorskip("galaxis.llm.token_files")
tokenizers = pytest.importorskip("tokenizers")
ODD = ["", None, " \n", "It's WE'LL i'd 12 345 ½", "x<|endoftext|>y", "<|startoftext|>", "ÉTÉ é İstanbul ΣΊΣΥΦΟΣ ς", "日本語", "a\u0085b c　d", "!!! ### <|", "\x1c\x00\x1f", "ﬁ Å ǅ", "word " * 4000, "a" * 3000, "😀👍🏽"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(tf.tokenizer_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def texts(n=250):
    rng = random.Random(2)
    return ODD + ["".join(rng.choice("ab cé'\n\t19#ß語 sTreΣ") for _ in range(rng.randrange(120))) for _ in range(n)]


def test_encoder_as_the_library(library):
    own = tf.WordEncoder(tf.tokenizer_path("word_bpe_49k.json"))
    assert own.by_word
    for text, got in zip(texts(), own.encode(texts()), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_files_round_trip(spark, library, tmp_path):
    rng = random.Random(9)
    rows = [(i * 3, t, 1) for i, t in enumerate(texts())] + [(None, "no id", 1), (3, "again", 1)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    folder = f"file://{tmp_path}/ids"
    shards = tf.write(docs, folder, tf.tokenizer_path("word_bpe_49k.json"), per_shard=40)
    assert len(shards) > 3 and sum(x[1] for x in shards) == len(rows)
    got = sorted(tf.digests(spark, folder, shards).collect(), key=lambda r: r.start)
    ids = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows if r[0] != 3}
    start, seen = 0, -1
    for r in got:
        assert r.start == start and (r.doc_id is None and seen == -1 or r.doc_id >= seen)
        start, seen = start + r.n_tokens, -1 if r.doc_id is None else r.doc_id
        if r.doc_id != 3:
            assert r.n_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes())
    shard = tf.Shard(folder, shards[1][0])
    doc = int(shard.docs[5])
    assert shard.of(doc).tolist() == ids[doc] and shard.of(doc + 1) is None


def test_empty_table_and_changed_dictionary(spark, tmp_path):
    folder = f"file://{tmp_path}/ids"
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert tf.digests(spark, folder, tf.write(docs.limit(0), folder, tf.tokenizer_path("word_bpe_49k.json"))).count() == 0
    name = tf.write(docs, folder, tf.tokenizer_path("word_bpe_49k.json"))[0][0]
    assert len(tf.Shard(folder, name).ids(0)) == 4
    next((tmp_path / "ids").glob("*.zdict")).write_bytes(b"other")
    with pytest.raises(ValueError):
        tf.Shard(folder, name)


def same(library, texts):
    own = tf.WordEncoder(tf.tokenizer_path("word_bpe_49k.json"))
    for at in range(0, len(texts), 2000):
        part = texts[at : at + 2000]
        want = [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(part, add_special_tokens=False)]
        assert [t for t, a, b in zip(part, own.encode(part), want, strict=True) if a != b] == []


def test_every_character_as_the_library(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert sum(tf.plain(chr(c)) for c in points) > 700
    # Characters that are not plain go to the library, so of these some will do.
    some = [chr(c) for c in points if tf.plain(chr(c)) or c < 0x3100 or c % 97 == 0]
    same(library, [f"x{c}y {c}{c} 1{c}'s {c}" for c in some])


def test_random_texts_and_marks_as_the_library(library):
    rng = random.Random(11)
    plain = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and tf.plain(chr(c))]
    same(library, ["".join(rng.choice(plain) if rng.random() < 0.5 else rng.choice("abcs t'R 1") for _ in range(rng.randrange(40))) for _ in range(20_000)])
    odd = ["֚࢞", "᷷ᷙ", "഼݃", "᷹̓", "Ᲊ", "Ɤ", "\U000105c0", "İ", "Σ", "́", "ﬃ", " ", "<|ENDOFTEXT|>", "<|endoftext|>"]
    marks = [chr(c) for c in (*range(0x300, 0x370), *range(0x591, 0x5C8), *range(0x1DC0, 0x1E00), *range(0x0898, 0x08A0))]
    same(library, ["".join(rng.choice((rng.choice(odd), rng.choice(marks), rng.choice("aeE n1'"))) for _ in range(rng.randrange(30))) for _ in range(20_000)])


def test_hot_and_null_ids_take_several_shards(spark, tmp_path):
    words = ["a", "b c", "d e f", "once more", "and again"]
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"{words[i % 5]} {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = f"file://{tmp_path}/ids"
    shards = tf.write(docs, folder, tf.tokenizer_path("word_bpe_49k.json"), per_shard=20)
    assert sum(x[1] for x in shards) == 600 and max(x[1] for x in shards) < 80
    got = sorted(tf.digests(spark, folder, shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_query_equals_the_library(spark, library):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    start, want = 0, []
    for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tf.op9_token_files(spark, folder).collect())) == want
