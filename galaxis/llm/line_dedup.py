"""Line dedup by range-partitioned hashes.

Every line becomes (hash of its key, document, position). These rows are range-partitioned by hash, document (largest
first) and position and sorted so within partitions; a stream over a partition then meets a key's occurrences one after
another, the document that keeps the key first, and remembers nothing but the current key. Ranges may cut a key that is
very frequent: what a partition saw of its first and its last key (at most three documents of each) is gathered from all
partitions, two rows of each, and completes the streams. What comes out are the positions to drop, as a compressed keep
bitmap per document; texts are not moved until a caller applies the bitmaps.

A line's key is the line without white space [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased. Keys of at least `min_chars`
code points that at least `min_docs` documents hold lose all their lines except those in the largest document id.

Defined cases: a null or empty text is one empty line; lines with short keys stay; a document without dropped lines has
no bitmap. A document is what shares an id: rows that repeat an id count once, and all keep the lines of a key that the
id keeps. Null ids count together as one document below all others, of which an id of -2**63 is a part. Other columns, of
any name, stay as they are; the pipeline stage sets n_chars anew where it was the text's length. Hashes have 128 bits.
Lines are written as hashes once; that table and the next are removed when the bitmaps are written.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galaxis.llm._store import mapped, names_of, read, remove, saved, slim, unused, utf8

NO_ID = -(2**63)
LINES = T.StructType(
    [T.StructField("h1", T.LongType(), False), T.StructField("h2", T.LongType(), False), T.StructField("doc", T.LongType(), False), T.StructField("mark", T.LongType(), False), T.StructField("pos", T.IntegerType(), False), T.StructField("n_lines", T.IntegerType(), False)]
)
#: kind 0: a line to drop; 1: a line of a key that may go on in another partition; 2: three documents at most of such a key.
SEEN = T.StructType([T.StructField("kind", T.IntegerType(), False), *LINES])
BITMAPS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("keep", T.BinaryType())])


def _marks(offsets: np.ndarray, data: np.ndarray) -> list[int]:
    """A fingerprint of each text, which tells rows of one id apart."""
    view = memoryview(data)
    return [xxhash.xxh3_64_intdigest(view[a:b]) - 2**63 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _ids(column: pa.Array) -> list[int]:
    return [NO_ID if x is None else x for x in column.to_pylist()]


def lines(docs: DataFrame, min_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line whose key has at least min_chars code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            raw, bounds = data.tobytes(), offsets.tolist()
            digests, owner, where, count = [], [], [], []
            ids, marks = _ids(batch.column(0)), _marks(offsets, data)
            for k in range(len(ids)):
                found = raw[bounds[k] : bounds[k + 1]].split(b"\n")
                for pos, line in enumerate(found):
                    if len(line) >= min_chars:
                        key = line.strip().lower()
                        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                            digests.append(xxhash.xxh3_128_digest(key))
                            owner.append(k)
                            where.append(pos)
                            count.append(len(found))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = np.array(owner, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.array(ids, np.int64)[at]), pa.array(np.array(marks, np.int64)[at]), pa.array(where, pa.int32()), pa.array(count, pa.int32())],
                names=LINES.names,
            )

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, LINES)


def _stream(min_docs: int):
    """Over the sorted lines of a partition: the lines to drop, and what is known of its first and its last key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None
        first = True  # the key is the partition's first one, and may have begun in another partition
        docs: list[int] = []  # the key's largest documents, min_docs at most
        waiting: list[list[np.ndarray]] = []  # the key's lines outside docs[0], while fewer than min_docs documents hold it
        out: list[tuple[int, list[np.ndarray]]] = []

        def known() -> None:
            n = len(docs)
            fill = [np.full(n, v, np.int64) for v in key] + [np.array(docs, np.int64), np.zeros(n, np.int64)]
            out.append((2, [*fill, np.zeros(n, np.int32), np.zeros(n, np.int32)]))

        def flush() -> pa.RecordBatch:
            kinds = np.concatenate([np.full(len(c[0]), kind, np.int32) for kind, c in out] or [np.zeros(0, np.int32)])
            cols = [np.concatenate([c[i] for _, c in out]) if out else np.zeros(0, np.int64 if i < 4 else np.int32) for i in range(6)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds), *map(pa.array, cols)], names=SEEN.names)

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            n = len(cols[0])
            if not n:
                continue
            edges = np.concatenate(([0], np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1, [n]))
            # A key that begins and ends within the batch needs a look only if it has min_docs lines.
            look = np.diff(edges) >= min_docs
            look[[0, -1]] = True
            for i in np.flatnonzero(look).tolist():
                a, b = int(edges[i]), int(edges[i + 1])
                now = (int(cols[0][a]), int(cols[1][a]))
                if now != key:
                    if key is not None and first:
                        known()
                    first = key is None
                    key, docs, waiting = now, [], []
                ids = cols[2][a:b]
                if len(docs) < min_docs:
                    for x in ids[np.flatnonzero(np.diff(ids, prepend=ids[0] + 1))].tolist():  # from the largest down
                        if len(docs) < min_docs and (not docs or docs[-1] != x):
                            docs.append(x)
                if first:
                    out.append((1, [c[a:b] for c in cols]))
                else:
                    other = ids != docs[0]
                    waiting.append([c[a:b][other] for c in cols])
                    if len(docs) >= min_docs:
                        out.extend((0, c) for c in waiting)
                        waiting = []
            yield flush()
        if key is not None:
            known()
            out.extend((1, c) for c in waiting)
            yield flush()

    return run


def dropped(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """(doc, mark, pos, n_lines) of the lines to drop, and the place of the table behind it."""
    spark = docs.sparkSession
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("mark"), F.col("pos")]
    # Ranges are found in a pass of its own over the lines, so these are written first.
    found, found_place = saved(lines(docs, min_chars, doc_id, text), "hashes")
    ranged = found.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    seen, place = saved(ranged.sortWithinPartitions(*order).mapInArrow(_stream(min_docs), SEEN), "lines")
    remove(spark, found_place)
    # Two keys of each partition at most, so this may be broadcast.
    edge = seen.where("kind = 2").groupBy("h1", "h2").agg(F.size(F.collect_set("doc")).alias("docs"), F.max("doc").alias("keeper")).where(F.col("docs") >= min_docs)
    open_lines = seen.where("kind = 1").join(F.broadcast(edge), ["h1", "h2"]).where("doc <> keeper")
    columns = ["doc", "mark", "pos", "n_lines"]
    return seen.where("kind = 0").select(*columns).unionByName(open_lines.select(*columns)), place


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, mark, number, lists = batch.columns
        gone, packed = [], []
        for n, pos in zip(number.to_pylist(), lists, strict=True):
            keep = np.ones(n, bool)
            keep[pos.values.to_numpy()] = False
            gone.append(n - int(keep.sum()))
            packed.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6))
        yield pa.RecordBatch.from_arrays([doc, mark, number.cast(pa.int64()), pa.array(gone, pa.int64()), pa.array(packed, pa.binary())], names=BITMAPS.names)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document that loses lines: doc (its id, NO_ID for null), mark (of its text), n_lines, n_dropped and
    keep, a zlib-compressed bitmap of n_lines bits, lowest bit first. A group is one document's dropped lines."""
    rows, place = dropped(docs, min_chars, min_docs, doc_id, text)
    made = rows.groupBy("doc", "mark").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("pos")).mapInArrow(_bitmaps, BITMAPS)
    out, _ = saved(made, "bitmaps")
    remove(docs.sparkSession, place)
    return out


def unpack(keep: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines, bitorder="little").astype(bool)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs and two last columns under names of their own, null where all lines stay: the number of lines and the bitmap."""
    own, mark, n, keep = (unused(docs, c) for c in ("doc", "mark", "n", "keep"))
    schema = T.StructType([*docs.schema, T.StructField(own, T.LongType()), T.StructField(mark, T.LongType())])
    at = [docs.columns.index(doc_id), docs.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array(_ids(batch.column(at[0])), pa.int64()), pa.array(_marks(*utf8(batch.column(at[1]))), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    small = bitmaps.select(F.col("doc").alias(own), F.col("mark").alias(mark), F.col("n_lines").alias(n), F.col("keep").alias(keep))
    return mapped(docs, run, schema).join(small, [own, mark], "left").select(*names_of(docs), n, keep)


def _kept(text: bytes, keep: bytes | None, n: int | None) -> tuple[int, int, bytes]:
    found = text.split(b"\n")
    if keep is None:
        return len(found), 0, text
    flags = unpack(keep, n)
    rest = [x for x, flag in zip(found, flags.tolist(), strict=True) if flag]
    return len(found), len(found) - len(rest), b"\n".join(rest)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the dropped lines gone from its texts; a text that loses nothing stays as it is, also a null one."""
    joined = with_bitmaps(docs, bitmaps, doc_id, text)
    at, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, numbers, keeps = batch.columns
            lose = np.flatnonzero(keeps.is_valid().to_numpy(zero_copy_only=False)).tolist()
            if lose:
                texts = columns[at].to_pylist()
                for i in lose:
                    texts[i] = _kept((texts[i] or "").encode(), keeps[i].as_py(), numbers[i].as_py())[2].decode()
                columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        slim()

    return mapped(joined, run, schema)


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, *rest = batch.columns
            rows = [_kept((t or "").encode(), k, n) for t, n, k in zip(*(c.to_pylist() for c in rest), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())], names=DIGEST.names)

    return mapped(with_bitmaps(docs, keep_bitmaps(docs)), run, DIGEST)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without their repeated lines. n_chars follows the text where it was its length."""
    bitmaps = keep_bitmaps(docs)
    kind = dict(zip(docs.columns, (f.dataType for f in docs.schema), strict=True)).get("n_chars")
    if not isinstance(kind, T.IntegralType):
        return apply_bitmaps(docs, bitmaps)
    same = unused(docs, "same")
    out = apply_bitmaps(docs.withColumn(same, F.col("n_chars") == F.length("text")), bitmaps)
    return out.withColumn("n_chars", F.when(F.col(same), F.length("text").cast(kind)).otherwise(F.col("n_chars"))).select(*names_of(docs))


#: DuckDB: translate() for A-Z alone, trim() by the six characters.
ORACLE = """
WITH l AS (SELECT doc_id, s, row_number() OVER () AS r, pos FROM (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))),
k AS (SELECT doc_id, pos, s, translate(trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
b AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.s, b.key IS NOT NULL AND k.doc_id <> b.keeper AS gone FROM k LEFT JOIN b USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(s, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
