"""Token ids in binary files, each document compressed by itself with a shared Zstandard dictionary.

A dictionary is trained on the serialized id arrays of a bounded sample. Documents are encoded and compressed where they
are read; what is shuffled are compressed frames. Shards hold ranges of document ids in ascending order, and are written
in one stream each. A shard is

    magic (8 bytes) | width of an id in bytes (u32) | SHA-256 of the dictionary (32 bytes)
    one Zstandard frame for each document
    index: document ids (i64), ends of frames (u64), numbers of ids (u32), one array after another
    number of documents (u64) | place of the index (u64) | magic

all little-endian, so that one document is read with two short reads. The dictionary lies beside the shards in a file
named by its hash, which readers check.

Defined cases: a null text counts as empty (only the end id is written); null document ids come first and are read back
as null, and so is an id of -2**63; rows that repeat an id stand one after another, ordered by hashes of their frames, in
as many shards as they take. An empty table has no shard. A very long text is one frame, encoded by itself. Other columns
are not looked at.

The dictionary's sample is taken from all rows by hash: SAMPLE of them, of each at most SAMPLE_CHARS characters. It changes
sizes of files, never what is read back.
"""

from __future__ import annotations

import gc
import hashlib
import io
import json
import math
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galaxis.llm._store import new_folder, open_file, read, slices, slim, write_file
from galaxis.llm.bpe import WHITE, _class, tokenizer_path

MAGIC = b"GXIDS001"
NO_ID = -(2**63)
#: Bytes of chunks and words with their ids that a worker remembers, and what one takes besides.
KNOWN_BYTES, ENTRY = 160 << 20, 150
#: The sample that the dictionary is trained on, and the characters used of a document of it.
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 600, 16_000, 1 << 16
DOCS_PER_SHARD, MOST_SHARDS, LEVEL, PIECE_BYTES = 8192, 50_000, 1, 4 << 20
_encoders: dict[str, WordEncoder] = {}

#: The parts of the vocabulary file that WordEncoder's own splitting stands for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
#: No match of it holds white space or looks at it, so a text may be split at white space first.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: What str.split() takes for white space and Unicode doesn't.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Characters beyond Latin-1 for which lower case, composition and class are each character's own and alike in all versions
#: of Unicode: letters below the combining marks but the dotted capital I, general punctuation, currencies, trade mark.
BEYOND = re.compile("[^\x00-\u012f\u0131-\u02ff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2122]").search


def plain(text: str) -> bool:
    """True if the text has characters only that Python and the library treat alike."""
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return BEYOND(text) is None


class WordEncoder:
    """Ids by the tokenizers library, which sees each distinct word once: plain() texts are put in lower case and split at
    white space here, and chunks are looked up; what is new is split into words, and new words go to the library. All other
    texts, those with strings of special tokens, and vocabularies of another make go to the library whole.

    What is remembered is in two generations of KNOWN_BYTES / 2: when the young one is full it becomes the old one, and
    what is found there moves to the young one. It lasts as long as the worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.library, self.words):
            t.no_truncation()
            t.no_padding()
        # The same model for text that is normalised and split already, with a blank between words.
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        suffix = spec["model"].get("end_of_word_suffix")
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        self.last[[i for token, i in self.library.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.by_word = bool(suffix) and spec["normalizer"] == NORMALIZER and steps[0].get("pattern") == {"Regex": PATTERN} and steps[0].get("behavior") == "Removed" and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        letters, numbers = _class("L"), _class("N")
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+").findall
        added = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search if added else lambda text: None
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words, 2000 of them as one text: the ids that end a word tell them apart again."""
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                yield from zip(part, self._ids(part), strict=True)
                continue
            data, ends = ids.astype(f"<u{self.width}").tobytes(), (ends * self.width).tolist()
            yield from zip(part, (data[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True)

    def _keep(self, name: str, ids: bytes) -> None:
        self.known[name] = ids
        self.held += ENTRY + len(name) + len(ids)

    def _learn(self, chunks: Iterable[str]) -> None:
        """Remember the ids of chunks without white space."""
        known, old, fresh = self.known, self.old.get, {}
        for c in chunks:
            if (ids := old(c)) is not None:
                self._keep(c, ids)
            else:
                fresh[c] = (c,) if c.isalpha() else self.split(c)
        words: dict[str, None] = {}
        for w in chain.from_iterable(fresh.values()):
            if w not in known and w not in words:
                if (ids := old(w)) is not None:
                    self._keep(w, ids)
                else:
                    words[w] = None
        for w, ids in self._words(list(words)):
            self._keep(w, ids)
        for c, parts in fresh.items():
            if c not in known:
                self._keep(c, b"".join(map(known.__getitem__, parts)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian."""
        gc.disable()  # many small objects are made, and no cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if self.held > KNOWN_BYTES // 2:
            self.old, self.known, self.held = self.known, {}, 0
        out, places, lower = [b""] * len(texts), [], []
        for k, t in enumerate(texts):
            t = t or ""
            if not self.by_word or not plain(t) or self.special(t) or any(c in t for c in ODD_SPACE):
                out[k] = self._ids([t])[0]
            else:
                places.append(k)
                lower.append(t.lower().replace("\x85", " ").replace("\xa0", " "))
        for k, ids in zip(places, self._looked_up(lower), strict=True):
            out[k] = ids
        return out

    def _looked_up(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts in lower case by their chunks, each distinct one looked up once."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        self._learn([c for c in chunks if c not in self.known])
        table = pa.array(list(map(self.known.__getitem__, chunks)), pa.large_binary()).take(coded.indices)
        _, ends, data = table.buffers()
        data = data.to_pybytes() if data else b""
        cuts = np.frombuffer(ends, np.int64)[table.offset :][lists.offsets.to_numpy()].tolist() if len(table) else [0] * (len(texts) + 1)
        return (data[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True))

    def forget(self) -> None:
        self.known, self.old, self.held = {}, {}, 0


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def train(samples: list[bytes], most: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary; of too few samples for training, their own bytes."""
    try:
        return zstandard.train_dictionary(most, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-most:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _name(digest: bytes) -> str:
    return f"dictionary-{digest.hex()}.zdict"


FRAMES = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("h", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("frame", T.BinaryType())])
SHARDS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])


def _shards(cuts: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Shards of documents by where their ids lie among the cuts. An id that makes up several cuts has as many shards, and
    its rows lie in them by their hashes."""
    first = np.searchsorted(cuts, ids)
    many = np.maximum(np.searchsorted(cuts, ids, "right") - first, 1)
    return (first + ((hashes >> np.uint64(32)) * many.astype(np.uint64) >> np.uint64(32)).astype(np.int64)).astype(np.int32)


def _shard_parts(rows: Iterator[tuple], head: bytes, count: list[int]) -> Iterator[bytes]:
    docs, ends, numbers, at = [], [], [], len(head)
    yield head
    for _, doc, _, n, frame in rows:
        at += len(frame)
        docs.append(doc)
        ends.append(at)
        numbers.append(n)
        yield frame
    yield np.array(docs, "<i8").tobytes() + np.array(ends, "<u8").tobytes() + np.array(numbers, "<u4").tobytes()
    yield np.array([len(docs), at], "<u8").tobytes() + MAGIC
    count[:] = len(docs), sum(numbers)


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", per_shard: int = DOCS_PER_SHARD) -> list[tuple[str, int, int]]:
    """Write shards of docs into a folder of the shared store. Returns (name, documents, ids) of each in order; there are
    MOST_SHARDS at most, which then hold more documents."""
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))
    rows = docs.count()
    if not rows:
        return []
    n = min(MOST_SHARDS, math.ceil(rows / per_shard))
    cuts = docs.approxQuantile("doc", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    cuts = np.clip(np.sort(np.array(cuts, np.float64)), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    h = F.xxhash64("doc", "text")
    some = docs.where(h < -(2**63) + 2**64 * 2 * SAMPLE // rows) if rows > 2 * SAMPLE else docs
    sample = some.orderBy(h).limit(SAMPLE).select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect()
    dictionary = train(encoder(vocabulary).encode([r.text for r in sample]))
    digest = hashlib.sha256(dictionary).digest()
    write_file(folder, _name(digest), [dictionary])
    head = MAGIC + np.array([encoder(vocabulary).width], "<u4").tobytes() + digest

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        end = np.array([end_id], f"<u{own.width}").tobytes()
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary)).compress
        for batch in batches:
            for i, j in slices(batch.column(1), PIECE_BYTES):
                part = batch.slice(i, j - i)
                ids = part.column(0).to_numpy()
                data = [x + end for x in own.encode(part.column(1).to_pylist())]
                frames = list(map(pack, data))
                hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in frames], np.uint64)
                made = (_shards(cuts, ids, hashes), ids, hashes.view(np.int64), np.array([len(x) // own.width for x in data], np.int32))
                yield pa.RecordBatch.from_arrays([*map(pa.array, made), pa.array(frames, pa.binary())], names=FRAMES.names)
        slim()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for at in range(0, batch.num_rows, 512) for row in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True))
        for shard, rows in groupby(stream, itemgetter(0)):
            count: list[int] = []
            write_file(folder, name := f"ids-{shard:05d}.gx", _shard_parts(rows, head, count))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "n_docs": [count[0]], "n_tokens": [count[1]]})

    frames = docs.mapInArrow(encode, FRAMES).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "doc", "h", "frame")
    return [(r.name, r.n_docs, r.n_tokens) for r in sorted(frames.mapInArrow(save, SHARDS).collect())]


class Shard:
    """A shard, read by parts. It checks the hash of its dictionary."""

    def __init__(self, folder: str, name: str):
        self.file = open_file(folder, name)
        size = self.file.size()
        self.file.seek(size - 24)
        tail = self.file.read(24)
        self.file.seek(0)
        head = self.file.read(44)
        if head[:8] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{name} is not a whole shard")
        self.width = int(np.frombuffer(head[8:12], "<u4")[0])
        n, at = (int(x) for x in np.frombuffer(tail[:16], "<u8"))
        self.file.seek(at)
        index = io.BytesIO(self.file.read(20 * n))
        self.docs = np.frombuffer(index.read(8 * n), "<i8")
        self.ends = np.frombuffer(index.read(8 * n), "<u8").astype(np.int64)
        self.starts = np.concatenate(([44], self.ends[:-1])).astype(np.int64)
        self.numbers = np.frombuffer(index.read(4 * n), "<u4")
        dictionary = open_file(folder, _name(head[12:])).read()
        if hashlib.sha256(dictionary).digest() != head[12:]:
            raise ValueError(f"the dictionary of {name} has changed")
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def ids(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document."""
        self.file.seek(int(self.starts[k]))
        return np.frombuffer(self.unpack(self.file.read(int(self.ends[k] - self.starts[k]))), f"<u{self.width}")

    def of(self, doc: int) -> np.ndarray | None:
        """The ids of a document by its id."""
        k = int(np.searchsorted(self.docs, doc))
        return self.ids(k) if k < len(self.docs) and self.docs[k] == doc else None


DIGEST = T.StructType([T.StructField(k, T.LongType()) for k in ("doc_id", "start", "n_tokens", "ids_crc32")])


def digests(spark: SparkSession, folder: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """Read shards and return where each document's ids start, their number and their CRC-32 as u32."""
    starts = np.cumsum([0] + [x[2] for x in shards]).tolist()
    rows = [(name, start) for (name, _, _), start in zip(shards, starts, strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(folder, name)
                crc = [zlib.crc32(shard.ids(k).astype("<u4").tobytes()) for k in range(len(shard.docs))]
                numbers = shard.numbers.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard.docs.astype(np.int64), mask=shard.docs == NO_ID), pa.array(start + np.cumsum(numbers) - numbers), pa.array(numbers), pa.array(crc, pa.int64())], names=DIGEST.names)

    return spark.createDataFrame(rows, "name string, start long").repartition(max(1, len(rows))).mapInArrow(run, DIGEST)


def op9_token_files(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    folder = new_folder(spark, "token-files")
    return digests(spark, folder, write(read(spark, sf_dir, "documents"), folder, vocabulary or tokenizer_path("word_bpe_49k.json")))
