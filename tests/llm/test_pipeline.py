"""The pipeline's stages over the smallest tables, against plain versions of them."""

import hashlib
import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("tokenizers")
import test_line_dedup  # noqa: E402
import test_mixing  # noqa: E402
import test_ngram_join  # noqa: E402
import test_quality  # noqa: E402

from galaxis.llm import bpe, mixing, quality  # noqa: E402

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def good(text):
    m, rules = test_quality.brute(text), quality.Rules()
    if m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"] or 100 * m["dup_line_chars"] > rules.line_chars * m["word_chars"]:
        return False
    return all(100 * c <= rules.ngrams[n] * m["word_chars"] for n, c in zip(sorted(rules.ngrams), m["dup_ngram_chars"], strict=True))


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("n_chars < 3000")
    rows = {r.doc_id: r for r in docs.collect()}
    texts = {i: r.text for i, r in rows.items() if good(r.text)}
    texts = {i: t for i, _, t in test_line_dedup.brute(list(texts.items()))}
    texts = {i: texts[i] for i, _, c in test_ngram_join.brute(list(texts.items()), 5, 80) if c == i}
    taken = test_mixing.brute([(i, t, rows[i].lang, rows[i].source) for i, t in texts.items()], mixing.PIPELINE)
    library = bpe.ByteBPE(bpe.tokenizer_path("byte_bpe_50k.json"))
    want = sorted((i, hashlib.sha256(library.decode(next(library.encode_batch([texts[i]]))[0]).encode()).hexdigest()) for i, *_ in taken)
    step = docs
    for name, stage in pipeline.STAGES:
        step, _ = pipeline.saved(stage(spark, step, DIR), f"test-{name}")
        if name != "tokens":
            assert step.columns == docs.columns
    assert sorted((r.doc_id, r.decoded_sha256) for r in step.collect()) == want
    assert 0 < len(want) < len(rows)


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{DIR}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
