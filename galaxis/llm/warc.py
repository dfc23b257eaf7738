"""WARC archives with a Zstandard dictionary.

A dictionary is built from a bounded sample of the records themselves: SAMPLE of all by hash, of each payload at most
SAMPLE_CHARS characters, which changes sizes of archives and never what is read back. Every archive begins with a skippable frame that
holds it, followed by one Zstandard frame for each record, so that records can be read singly and an archive needs no
other file. Pages with equal payloads are found by their digests alone; of those of at least `min_bytes` bytes, the one
with the largest page id is a response and the others are revisits, which carry headers but no payload. Each task writes
one archive, under a name of its own until it is whole.

Defined cases: a null payload is empty; a null url is left out; line ends in a url are escaped. A null page id is never
the largest, unless all are null: then each such page is a response. Rows that repeat the largest id are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galaxis.llm._store import new_folder, open_file, read, remove, saved, slim, write_file

#: Fixed value: the skippable frame's number for dictionaries in archives.
SKIPPABLE = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
LEVEL, SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 3, 400, 16_000, 1 << 16
#: The most keys of repeated payloads that are broadcast. If there are more, these are the most frequent ones, and the rest
#: are joined by a shuffle: none of them has more than this part of all rows.
MOST_BROADCAST = 200_000
URN = "urn:page:"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: bytes, refers_to: int | None = None, revisit: bool = False, date: str = DATE) -> bytes:
    """A response record, or a revisit of the page refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    length = len(http) + (0 if revisit else len(payload))
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + (b"" if revisit else payload) + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def train(samples: list[bytes], most: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary; of too few samples for training, their own bytes."""
    try:
        return zstandard.train_dictionary(most, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-most:]


def with_types(pages: DataFrame, min_bytes: int = 1000, most: int = MOST_BROADCAST) -> tuple[DataFrame, str]:
    """pages (page_id, url, html) with digest and the page that each revisit refers to, and the place of the table of
    repeated payloads. Payloads are moved only where more than `most` of them are repeated."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.withColumn("digest", F.sha1(payload))
    repeated = (
        hashed.where(F.octet_length(payload) >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first_id"))
        .where((F.col("n") > 1) & F.col("first_id").isNotNull())
    )
    repeated, place = saved(repeated, "repeated")
    keys, rows = repeated.agg(F.count("*"), F.sum("n")).first()
    if keys <= most:
        typed = hashed.join(F.broadcast(repeated.drop("n")), "digest", "left")
    else:
        hot = F.col("n") * most > rows  # so fewer than `most` are hot
        frequent = F.broadcast(repeated.where(hot).drop("n"))
        others = hashed.join(frequent, "digest", "left_anti").join(repeated.where(~hot).drop("n").hint("shuffle_merge"), "digest", "left")
        typed = hashed.join(frequent, "digest").unionByName(others)
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return typed.withColumn("refers_to", F.when(revisit, F.col("first_id"))).drop("first_id"), place


ARCHIVES = T.StructType([T.StructField("name", T.StringType()), T.StructField("n_records", T.LongType())])


def write(pages: DataFrame, folder: str, min_bytes: int = 1000) -> list[str]:
    """Write the archives of pages into a folder of the shared store; returns their names."""
    typed, place = with_types(pages, min_bytes)
    rows, h = pages.count(), F.xxhash64("page_id", "url", F.length("html"))
    some = pages.where(h < -(2**63) + 2**64 * 2 * SAMPLE // rows) if rows > 2 * SAMPLE else pages
    sample = some.orderBy(h).limit(SAMPLE).select("page_id", "url", F.substring("html", 1, SAMPLE_CHARS).alias("html")).collect()
    payloads = [(r.page_id, r.url, (r.html or "").encode()) for r in sample]
    dictionary = train([record(i, url, data, len(data), hashlib.sha1(data).digest()) for i, url, data in payloads])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_checksum=True).compress
        rows = (row for batch in batches for at in range(0, batch.num_rows, 64) for row in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True))
        first = next(rows, None)
        if first is None:
            return
        count = 0

        def parts() -> Iterator[bytes]:
            nonlocal count
            yield dictionary_frame(dictionary)
            row = first
            while row is not None:
                page_id, url, html, digest, refers_to = row
                data = (html or "").encode()
                yield pack(record(page_id, url, data, len(data), bytes.fromhex(digest), refers_to, refers_to is not None))
                count += 1
                row = next(rows, None)

        name = f"part-{TaskContext.get().partitionId():06d}.warc.zst"
        write_file(folder, name, parts())
        yield pa.RecordBatch.from_pydict({"name": [name], "n_records": [count]})
        slim()

    names = sorted(r.name for r in typed.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(save, ARCHIVES).collect())
    remove(pages.sparkSession, place)
    return names


def records(file) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, HTTP head, payload) of each record of an open archive."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary")
    dictionary = zstandard.ZstdDecompressor().decompress(file.read(size))
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).stream_reader(file, read_across_frames=True), 1 << 18)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[key] = value
        block = stream.read(int(head["Content-Length"]))
        if len(block) != int(head["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("the archive ends within a record")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield head, http, payload


def _page(urn: str | None) -> int | None:
    return int(urn[len(URN) + 1 : -1]) if urn and urn[len(URN) + 1 : -1] else None


DIGEST = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def read_back(spark: SparkSession, folder: str, names: list[str], payloads: bool = False) -> DataFrame:
    """The records of archives. Digests and sizes of responses are taken from their payloads and held against the
    headers. payloads: also url and payload."""
    schema = T.StructType([*DIGEST, *([T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType())] if payloads else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for head, http, payload in records(open_file(folder, name)):
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:"))
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    if head["WARC-Type"] == "response" and (hashlib.sha1(payload).digest(), len(payload)) != (digest, size):
                        raise ValueError(f"{name}: {head['WARC-Record-ID']} has another payload than its headers say")
                    rows.append((_page(head["WARC-Record-ID"]), size, digest.hex(), head["WARC-Type"], _page(head.get("WARC-Refers-To")), *([head.get("WARC-Target-URI"), payload] if payloads else [])))
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], arrow)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], arrow)

    kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])
    return spark.createDataFrame([(x,) for x in names], "name string").repartition(max(1, len(names))).mapInArrow(run, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    return read_back(spark, folder, write(read(spark, sf_dir, "pages"), folder))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha1(h) AS s FROM p),
g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY s) END AS f FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN f IS NULL OR f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to
FROM g
"""
