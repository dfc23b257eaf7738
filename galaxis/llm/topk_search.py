"""Exact top-k search by exhaustive term-at-a-time accumulation.

A task turns each chunk of its candidates into postings, one list of (row, weight) for each term (vector component).
Query rows are sparse: for each of a query's terms the weighted posting list is scattered into a dense array of scores,
one for each row of the chunk. Partition selection takes the k best of a chunk, with all that tie with the k-th; the best
of chunks and tasks are merged. A chunk has CHUNK rows or CHUNK_VALUES components at most, so that a task gives out
few hits for each query. Queries are written to the shared folder once and read there block by block, so neither the driver
nor a task ever holds them all.

Vectors become integers floor(scale * x), never clipped. Scores are exact: where the products of a query and a chunk might
not fit into 64 bits, they are summed as unbounded integers, and a score beyond a long raises OverflowError. So does a
component beyond a long. Vectors that are null or hold null or non-finite components take no part; neither do null ids. Vectors may differ in length: missing components count as 0. Rows that repeat an id
are candidates one by one; a query is an id, with the least of its vectors, and no row of its own id is its candidate.
Ties go to the smaller id. A query with fewer than k candidates gets them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galaxis.llm._store import read, saved

#: The most rows and components of a chunk, and the queries of a block.
CHUNK, CHUNK_VALUES, BLOCK = 1 << 16, 1 << 21, 1024
HITS = T.StructType([T.StructField(k, T.LongType()) for k in ("query_id", "vec_id", "score")])


def integers(vector: str, scale: int) -> Column:
    """floor(scale * x) as longs; what is too large for one becomes null, which postings() refuses."""
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    return F.transform(F.col(vector), lambda x: F.when(F.abs(F.lit(float(scale)) * x.cast("double")) < F.lit(2.0**63), whole(x)))


def sound(frame: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return frame.where(F.col(vec_id).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), integers(vector, scale).alias("v"))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    values = lists.flatten()
    if values.null_count:
        raise OverflowError("a component doesn't fit into a long")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], values.to_numpy(zero_copy_only=False).astype(np.int64)


def _largest(values: np.ndarray) -> int:
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


class Postings:
    """Candidates of a chunk by term."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, values: np.ndarray):
        self.ids = ids
        rows = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(offsets))
        terms = (np.arange(len(values)) - offsets[rows]).astype(np.int32)
        some = values != 0
        rows, terms, values = rows[some], terms[some], values[some]
        order = np.argsort(terms, kind="stable")
        self.rows, self.weights, self.largest = rows[order], values[order], _largest(values)
        self.starts = np.searchsorted(terms[order], np.arange(int(terms.max(initial=-1)) + 2))
        #: Weights of all rows for the terms that most rows have.
        self.dense: dict[int, np.ndarray] = {}
        for term in np.flatnonzero(np.diff(self.starts) * 2 > len(ids)).tolist():
            a, b = self.starts[term], self.starts[term + 1]
            self.dense[term] = np.zeros(len(ids), np.int64)
            self.dense[term][self.rows[a:b]] = self.weights[a:b]

    def scores(self, query: np.ndarray) -> np.ndarray:
        terms = np.flatnonzero(query[: len(self.starts) - 1]).tolist()
        wide = _largest(query) * self.largest * max(1, len(terms)) >= 2**63
        out = np.zeros(len(self.ids), object if wide else np.int64)
        for term in terms:
            weight, rows, weights = query[term], slice(None), self.dense.get(term)
            if weights is None:
                a, b = self.starts[term], self.starts[term + 1]
                rows, weights = self.rows[a:b], self.weights[a:b]
            out[rows] += int(weight) * weights.astype(object) if wide else weight * weights
        return out

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows outside the query's own id."""
        scores, ids = self.scores(query), self.ids
        own = ids == query_id
        if own.any():
            scores, ids = scores[~own], ids[~own]
        if scores.dtype == object:
            if len(scores) and max(map(abs, scores.tolist())) >= 2**63:
                raise OverflowError("a score doesn't fit into a long")
            scores = scores.astype(np.int64)
        if len(ids) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            top = scores >= least
            scores, ids = scores[top], ids[top]
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def _chunks(batches: Iterator[pa.RecordBatch], most_rows: int, most_values: int) -> Iterator[Postings]:
    held, count, values = [], 0, 0
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        rows = max(1, min(most_rows, most_values // max(1, int(lengths.max(initial=1)))))
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            size = int(lengths[at : at + rows].sum())
            if held and (values + size > most_values or count + part.num_rows > most_rows):
                yield _postings(held)
                held, count, values = [], 0, 0
            held.append(part)
            count += part.num_rows
            values += size
    if held:
        yield _postings(held)


def _postings(held: list[pa.RecordBatch]) -> Postings:
    table = pa.Table.from_batches(held).combine_chunks()
    return Postings(table.column(0).chunk(0).to_numpy(), *_flat(table.column(1).chunk(0)))


def top_k(queries: DataFrame, candidates: DataFrame, k: int, chunk: tuple[int, int] | None = None) -> DataFrame:
    """queries and candidates: (vec_id, v). Returns query_id, rank, vec_id, score. chunk: rows and components at most."""
    most_rows, most_values = chunk or (CHUNK, CHUNK_VALUES)
    _, place = saved(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(place)
        blocks = ds.dataset(base, filesystem=store, format="parquet")
        for postings in _chunks(batches, most_rows, most_values):
            for block in blocks.to_batches(batch_size=BLOCK):
                if not block.num_rows:
                    continue
                offsets, values = _flat(block.column("v"))
                names, found = block.column("vec_id").to_numpy(), []
                for i, q in enumerate(names.tolist()):
                    ids, scores = postings.best(q, values[offsets[i] : offsets[i + 1]], k)
                    found.append((np.full(len(ids), q), ids, scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=HITS.names)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = candidates.mapInArrow(run, HITS)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = sound(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
