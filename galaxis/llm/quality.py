"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths are computed in numpy over whole Arrow batches; a text is judged by the
share of its word characters that lie inside n-grams found twice or more, and inside lines found twice or more. Every
text is judged by itself, so the operator is one pass without a shuffle.

Defined cases: a null text has no words and no lines and fails the base rules; an empty or blank text likewise.
Repeated rows are judged one by one. Very long texts are measured whole, one at a time, in about 30 bytes of memory for
each byte of the text. All columns of the input but those
named like a result stay as they are; the pipeline stage changes none. Hashes have 64 bits, mixed after every eight bytes and every word: two different n-grams of one text of
n words count as equal with a probability of about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galaxis.llm._store import mapped, names_of, pieces, read, slim, unused, utf8
from galaxis.llm._words import Words, mix, rolling, spans_hash

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
PIECE_BYTES = 1 << 20

MEASURES = T.StructType(
    [T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("dup_line_chars", T.LongType()), T.StructField("dup_ngram_chars", T.ArrayType(T.LongType()))]
)


@dataclass(frozen=True)
class Rules:
    """ngrams: the most of its word characters that a text may have inside repeated n-grams, in hundredths, by n.
    line_chars: the same for repeated lines. The n-gram of the base rule has the least n."""

    min_words: int = 10
    max_repeat_words: int = 20
    ngrams: dict[int, int] = field(default_factory=lambda: {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10})
    line_chars: int = 20

    def base_failed(self, m: Column) -> Column:
        return (m["n_words"] < self.min_words) | (m["n_repeat_words"] * 100 > m["n_words"] * self.max_repeat_words)

    def covered(self, m: Column) -> Column:
        """True if repetition covers too much of a text."""
        bad = m["dup_line_chars"] * 100 > m["word_chars"] * self.line_chars
        for k, n in enumerate(sorted(self.ngrams)):
            bad = bad | (m["dup_ngram_chars"][k] * 100 > m["word_chars"] * self.ngrams[n])
        return bad

    def good(self, m: Column) -> Column:
        return ~self.base_failed(m) & ~self.covered(m)


def _twice(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur more than once."""
    order = np.argsort(keys)
    got = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = got[1:] == got[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = same[:-1] | same[1:]
    return out


def _earlier(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur before, in the order given."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    got = keys[order]
    out[order[1:]] = got[1:] == got[:-1]
    return out


def measure(data: np.ndarray, offsets: np.ndarray, lengths: list[int]) -> dict[str, np.ndarray]:
    """The measures of the texts data[offsets[k]:offsets[k+1]]."""
    w = Words(data, offsets)
    texts = len(offsets) - 1
    lead = ((data & 0xC0) != 0x80) & ~w.space
    chars = np.zeros(len(data) + 1, np.int32)
    np.cumsum(lead, out=chars[1:])
    out = {"n_words": w.counts, "word_chars": np.diff(chars[offsets]).astype(np.int64), "n_symbols": w.per_text(SYMBOLS[data])}
    word_len = (chars[w.ends] - chars[w.starts]).astype(np.int64)
    hashes, owner = w.hashes(), w.owner()
    last = w.bounds[1:][owner] if len(owner) else owner
    at, spans = np.arange(len(hashes)), []
    for n in lengths:
        at = at[at + n <= last[at]]
        if len(at):
            at = at[_twice(mix(rolling(hashes, n, at) + owner[at].astype(np.uint64)))]
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        inside = np.cumsum(edge)[:-1] > 0
        if n == lengths[0]:
            out["n_repeat_words"] = w.per_text_words(inside)
        spans.append(w.per_text_words(word_len * inside))
    out["dup_ngram_chars"] = np.stack(spans, 1)
    # lines: from a text's start or a line feed to the next line feed or the text's end
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    ends = np.sort(np.concatenate((offsets[1:], feeds)), kind="stable")
    line_chars = chars[ends] - chars[starts]
    full = line_chars > 0
    starts, ends, line_chars = starts[full], ends[full], line_chars[full]
    line_owner = np.searchsorted(offsets, starts, "right") - 1
    keys = mix(spans_hash(data, starts, ends) + line_owner.astype(np.uint64))
    out["n_dup_lines"] = np.bincount(line_owner[_earlier(keys)], minlength=texts)
    again = _twice(keys)
    out["dup_line_chars"] = np.bincount(line_owner[again], line_chars[again], minlength=texts).astype(np.int64)
    return out


def _column(name: str, got: np.ndarray) -> pa.Array:
    values = pa.array(got.ravel().astype(np.int64))
    if name != "dup_ngram_chars":
        return values
    return pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1]), values)


def measured(docs: DataFrame, rules: Rules | None = None, text: str = "text") -> tuple[DataFrame, str]:
    """docs with the measures of its texts in a struct column, and that column's name."""
    lengths = sorted((rules or Rules()).ngrams)
    names = [f.name for f in MEASURES]
    into = unused(docs, "measures")
    schema = T.StructType([*docs.schema, T.StructField(into, MEASURES)])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(at))
            parts = [measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lengths) for i, j in pieces(offsets, PIECE_BYTES)]
            none = {name: np.zeros((0, len(lengths)) if name == "dup_ngram_chars" else 0, np.int64) for name in names}
            columns = [_column(name, np.concatenate([p[name] for p in parts or [none]])) for name in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, names)], names=schema.names)
        slim()

    return mapped(docs, run, schema), into


def with_measures(docs: DataFrame, rules: Rules | None = None, text: str = "text") -> DataFrame:
    """docs with the measures of its texts as further columns; columns of docs with their names are replaced."""
    frame, into = measured(docs, rules, text)
    return frame.select(*names_of(docs.drop(*MEASURES.names)), f"{into}.*")


def judged(docs: DataFrame, rules: Rules | None = None, text: str = "text") -> DataFrame:
    """docs with its measures, base_failed and kept; columns of docs with these names are replaced."""
    rules = rules or Rules()
    frame, into = measured(docs, rules, text)
    m, rest = F.col(into), docs.drop(*MEASURES.names, "base_failed", "kept")
    return frame.select(*names_of(rest), f"{into}.*", rules.base_failed(m).alias("base_failed"), rules.good(m).alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(read(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go. Columns of any name stay as they are."""
    rules = Rules()
    frame, into = measured(docs, rules)
    return frame.where(rules.good(F.col(into))).select(*names_of(docs))


#: DuckDB: words and windows by position; a window is equal to another if its words are.
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM d, (SELECT unnest(range(5, 11)) AS n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
dup AS (SELECT doc_id, n, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT DISTINCT doc_id, n, p FROM dup, LATERAL (SELECT unnest(range(i, i + n)) AS p)),
sums AS (SELECT doc_id, n, count(*) AS words, sum(length(w[p])) AS chars FROM cov JOIN d USING (doc_id) GROUP BY ALL),
lines AS (SELECT doc_id, s, length(array_to_string(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+'), '')) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS s FROM d)),
ls AS (SELECT doc_id, sum(c) AS n, sum(CASE WHEN c > 1 THEN chars ELSE 0 END) AS chars, sum(c - 1) AS dups FROM (SELECT doc_id, s, count(*) AS c, sum(c) AS chars FROM lines WHERE c > 0 GROUP BY ALL) GROUP BY ALL),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(ls.chars, 0) AS line_chars,
  coalesce((SELECT words FROM sums WHERE sums.doc_id = d.doc_id AND n = 5), 0)::BIGINT AS n_repeat_words,
  coalesce((SELECT bool_or(100 * sums.chars > (20 - n) * length(array_to_string(d.w, ''))) FROM sums WHERE sums.doc_id = d.doc_id), false) AS bad
  FROM d LEFT JOIN ls USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT bad AND NOT 100 * line_chars > 20 * word_chars AS kept
FROM m
"""
