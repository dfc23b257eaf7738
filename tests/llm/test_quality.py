import random
import re

import pytest

quality = pytest.importorskip("galaxis.llm.quality")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def cover(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        return {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + n)}

    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = lambda s: sum(len(w) for w in re.findall(r"[^\x20\x09-\x0D]+", s))
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover(5)),
        "dup_line_chars": sum(chars(x) for x in lines if lines.count(x) > 1),
        "dup_ngram_chars": [sum(len(words[p]) for p in cover(n)) for n in range(5, 11)],
    }


def test_measures_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "   \n\t\n", "a", "é " * 40, "one two three four five " * 5, "x\n" * 20, "w" * 100_000, "a b\n a b\na b\x0b"]
    texts += ["".join(rng.choice(["a ", "b ", "é ", "cc\n", "d\t", "#", "é\x0c", "  "]) for _ in range(rng.randrange(150))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r.asDict() for r in quality.with_measures(docs.coalesce(1)).collect()}
    for i, text in enumerate(texts):
        assert {k: got[i][k] for k in brute(text)} == brute(text), text


def test_verdicts_and_empty_table(spark):
    rng = random.Random(4)
    clean = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300))
    docs = spark.createDataFrame([(1, clean), (2, "too few words"), (3, "spam again " * 50), (4, clean[:600] + "\n" + clean[:600]), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judged(docs).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (True, False)}
    assert quality.judged(docs.limit(0)).count() == 0
    assert quality.keep_good(spark, docs, "").columns == docs.columns


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_and_lines_that_break_polynomial_hashes(spark):
    """Sequences that collide for any polynomial modulo 2**64."""
    a, b = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    rest = [f"x{i}" for i in range(8)]
    texts = [f"{a}\n{b}", " ".join([a, *rest[:4], b, *rest[:4], a, *rest[4:]]), " ".join(["p q r s", a[:64], "p q r s", b[:64]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.with_measures(docs).collect():
        want = brute(texts[r.doc_id])
        assert {k: r[k] for k in want} == want
    assert brute(texts[0])["n_dup_lines"] == 0


def test_stage_keeps_columns_of_any_name(spark):
    good = " ".join(f"word{i}" for i in range(200))
    docs = spark.createDataFrame([(1, good, 777, "a", 5, 0.5, None, True), (2, "few", 778, "b", 6, 1.5, 1, False)], "doc_id long, text string, kept int, n_words string, measures int, `a.b` double, measures_ int, base_failed boolean")
    got = quality.keep_good(spark, docs, "")
    assert got.schema.names == docs.schema.names
    assert [tuple(r) for r in got.collect()] == [(1, good, 777, "a", 5, 0.5, None, True)]


def test_spans_of_all_lengths():
    import numpy as np

    words = pytest.importorskip("galaxis.llm._words")
    rng = np.random.default_rng(5)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 20_000)
    ends = starts + rng.integers(0, 80, 20_000)
    seen: dict = {}
    for s, e, h in zip(starts.tolist(), ends.tolist(), words.spans_hash(data, starts, ends).tolist(), strict=True):
        assert seen.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)
