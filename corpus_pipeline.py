"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.

1. quality: documents that the quality rules reject go.
2. lines: repeated lines go, except in the largest document that holds them.
3. near_copies: of each component of near copies (five-word shingles, Jaccard 0.8) one document stays.
4. mix: documents are taken by domain, language and source to the target weights, nine tenths of all tokens.
5. tokens: documents are encoded and decoded; the result has digests of both.

The first four return the columns of documents. A stage's table is removed when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galaxis.llm import bpe, line_dedup, mixing, ngram_join, quality
from galaxis.llm._store import read, remove, saved

STAGES = [
    ("quality", quality.keep_good),
    ("lines", line_dedup.drop_lines),
    ("near_copies", ngram_join.drop_near_copies),
    ("mix", mixing.mix_stage),
    ("tokens", bpe.encode_stage),
]

#: BPE has no SQL; tests hold the pipeline against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, place = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            remove(spark, before)
        before = place
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
