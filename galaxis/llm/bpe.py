"""BPE encoding and decoding by a pair occurrence index.

Each Arrow batch of a partition is split into pre-tokens; those that are new to the worker are laid one after another,
and a map leads from each pair of neighbouring symbols to all its positions among them. Ranks that are present are taken
from a heap in ascending order; a rank is applied at all its positions, and the lists of the pairs that this makes are
updated. Texts are then lookups of whole pre-tokens. One pass, no shuffle.

Defined cases: a null text is encoded as an empty one (no ids); a pre-token may be as long as the whole text; the
strings of special tokens in a text become their ids, as the tokenizers library does by default; an empty table has an
empty result, and repeated rows are encoded one by one. Texts are taken by about PIECE_BYTES at a time, a longer one by
itself; known pre-tokens are kept within a partition up to KNOWN_BYTES, and beyond it but for the latest forgotten, which
changes no result. A worker takes some 100 MB beside what Python and Arrow take, and 120 bytes for each byte of a longer
text than PIECE_BYTES.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galaxis.llm._store import mapped, pieces, read, slices, slim

#: Bytes of pre-tokens and their ids that are remembered within a partition, and what one takes besides its text and ids.
KNOWN_BYTES, ENTRY = 48 << 20, 150
#: Places from which on a rank is applied to all at once; bytes of text that are encoded together.
MANY, PIECE_BYTES = 32, 1 << 20
_codecs: dict[str, ByteBPE] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _class(kind: str) -> str:
    """The characters of a general category's first letter, as the inside of a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


#: The characters of Unicode's White_Space property.
WHITE = r"\x09-\x0d\x20\x85\xa0  -     　"


def splitter() -> re.Pattern:
    """The public pre-token pattern of byte-level BPE vocabularies, with letters and numbers spelled out."""
    letters, numbers = _class("L"), _class("N")
    other = f"[^{WHITE}{letters}{numbers}]"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?{other}+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 characters stand
    for themselves, the other bytes take characters from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ByteBPE:
    """A byte-level BPE vocabulary, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, shown = spec["model"], byte_characters()
        vocab = model["vocab"]
        if spec["normalizer"] or model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("unk_token"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        self._merges([vocab[c] for c in shown], [(vocab[x], vocab[y], vocab[x + y]) for x, y in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])])
        byte = {c: b for b, c in enumerate(shown)}
        self.bytes: dict[int, bytes] = {i: bytes(map(byte.__getitem__, s)) for s, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes.update({i: s.encode() for s, i in self.special.items()})
        self.decimal = [b"%d," % i for i in range(max(self.bytes) + 1)]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = splitter().findall

    def _merges(self, start: list[int], merges: list[tuple[int, int, int]]) -> None:
        """start: the symbol of each byte; merges: (left, right, merged) in ascending rank."""
        self.start = np.array(start, np.int64)
        self.merges = merges
        self.ranks: dict[int, int] = {}
        for rank, (a, b, _) in enumerate(merges):
            self.ranks.setdefault(a << 24 | b, rank)
        #: Ranks of pairs of bytes, by the bytes.
        self.first = np.full((256, 256), -1, np.int32)
        of = {symbol: byte for byte, symbol in enumerate(start)}
        for key, rank in self.ranks.items():
            if (key >> 24) in of and (key & 0xFFFFFF) in of:
                self.first[of[key >> 24], of[key & 0xFFFFFF]] = rank
        order = sorted(self.ranks)
        self.pairs = np.array(order, np.int64)
        self.pair_ranks = np.array([self.ranks[k] for k in order], np.int64)
        #: Ranks whose merge can make a pair of a lower rank.
        least: dict[int, int] = {}
        for key, rank in self.ranks.items():
            for symbol in (key >> 24, key & 0xFFFFFF):
                least[symbol] = min(rank, least.get(symbol, rank))
        self.backward = {rank for rank, (_, _, m) in enumerate(merges) if least.get(m, rank) < rank}
        #: Ids of pre-tokens, little-endian in four bytes each.
        self.store: dict[str | int, bytes] = {}
        self.held = 0
        self.decimal = [b"%d," % i for i in range(max((*start, *(m for *_, m in merges)), default=0) + 1)]

    def _apply(self, places: list[int], rank: int, symbols: np.ndarray, follow: np.ndarray, before: np.ndarray, index: dict, heap: list[int]) -> None:
        """A rank at all its places at once, for two different symbols: no two of its pairs then overlap."""
        a, b, merged = self.merges[rank]
        at = np.unique(np.array(places, np.int64))
        at = at[symbols[at] == a]
        after = follow[at]
        fits = (after >= 0) & (symbols[after] == b)
        at, after = at[fits], after[fits]
        symbols[at], symbols[after] = merged, -1
        beyond = follow[at] = follow[after]
        more = beyond >= 0
        before[beyond[more]] = at[more]
        prior = before[at]
        prior = prior[prior >= 0]
        spots = np.concatenate((at[more], prior))
        pairs = np.concatenate((merged << 24 | symbols[beyond[more]], symbols[prior] << 24 | merged))
        found = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        there = self.pairs[found] == pairs
        spots, ranks = spots[there], self.pair_ranks[found[there]]
        if not len(spots):
            return
        order = np.argsort(ranks, kind="stable")
        spots, ranks = spots[order].tolist(), ranks[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        for r, x, y in zip(ranks[cuts].tolist(), cuts, [*cuts[1:], len(spots)], strict=True):
            if r in index:
                index[r].extend(spots[x:y])
            else:
                index[r] = spots[x:y]
                heapq.heappush(heap, r)

    def learn(self, tokens: list[str]) -> None:
        """Encode pre-tokens together and remember their ids and these as text."""
        coded = [t.encode() for t in tokens]
        data = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum([len(c) for c in coded])
        begins = np.concatenate(([0], ends[:-1]))
        state = self.start[data]
        follow = np.arange(1, len(data) + 1)
        follow[ends - 1] = -1
        before = np.arange(-1, len(data) - 1)
        before[begins] = -1
        ranks = np.append(self.first[data[:-1], data[1:]], -1)
        ranks[ends - 1] = -1
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        there, cuts = np.unique(ranks[order], return_index=True)
        index = {r: places.tolist() for r, places in zip(there.tolist(), np.split(order, cuts[1:]), strict=True)} if len(there) else {}
        heap = list(index)  # ascending, so a heap
        after_state, before_state = follow, before
        symbols, follow, before = memoryview(state), memoryview(follow), memoryview(before)
        get, merges, seen, push = self.ranks.get, self.merges, index.get, heapq.heappush
        while heap:
            rank = heapq.heappop(heap)
            a, b, merged = merges[rank]
            places = index.pop(rank)
            if len(places) >= MANY and a != b and rank not in self.backward:
                self._apply(places, rank, state, after_state, before_state, index, heap)
                continue
            if a == b:
                places.sort()
            left = merged << 24
            for k, at in enumerate(places):
                if symbols[at] != a:
                    continue  # it has gone into another merge
                after = follow[at]
                if after < 0 or symbols[after] != b:
                    continue
                symbols[at], symbols[after] = merged, -1
                beyond = follow[at] = follow[after]
                least = rank
                if beyond >= 0:
                    before[beyond] = at
                    r = get(left | symbols[beyond])
                    if r is not None:
                        held = seen(r)
                        if held is None:
                            index[r] = [at]
                            push(heap, r)
                        else:
                            held.append(at)
                        least = r if r < least else least
                prior = before[at]
                if prior >= 0:
                    r = get(symbols[prior] << 24 | merged)
                    if r is not None:
                        held = seen(r)
                        if held is None:
                            index[r] = [prior]
                            push(heap, r)
                        else:
                            held.append(prior)
                        least = r if r < least else least
                if least < rank:  # a lower rank goes first, also before this rank's other places
                    if rest := places[k + 1 :]:
                        if rank in index:
                            index[rank].extend(rest)
                        else:
                            index[rank] = rest
                            push(heap, rank)
                    break
        kept = np.flatnonzero(state >= 0)
        flat = state[kept].astype("<u4").tobytes()
        cuts = (np.searchsorted(kept, ends) * 4).tolist()
        at = 0
        for token, end in zip(tokens, cuts, strict=True):
            self.store[token] = flat[at:end]
            at = end
        self.held += ENTRY * len(tokens) + len(data) + len(flat)

    def parts(self, text: str) -> list[str | int]:
        """Pre-tokens of a text, and ids of special tokens."""
        if self.cut is None or self.cut.search(text) is None:
            return self.split(text)
        out: list[str | int] = []
        for piece in self.cut.split(text):
            out.extend([self.special[piece]] if piece in self.special else self.split(piece))
        return out

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[list[int], str]]:
        """The ids of each text, and the ids as decimal numbers with commas."""
        for packed in self.packed(texts):
            ids = np.frombuffer(packed, "<u4").tolist()
            yield ids, b"".join(map(self.decimal.__getitem__, ids))[:-1].decode()

    def packed(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, little-endian in four bytes each."""
        sizes = np.concatenate(([0], np.cumsum([len(t or "") for t in texts])))
        for start, stop in pieces(sizes, PIECE_BYTES):
            split = [self.parts(t or "") for t in texts[start:stop]]
            if self.held > KNOWN_BYTES:  # what comes again now is likely to do so later
                self.store = {t: self.store[t] for t in set(chain.from_iterable(split)) if t in self.store}
                self.held = sum(ENTRY + len(x) + (len(t) if isinstance(t, str) else 0) for t, x in self.store.items())
                if self.held > KNOWN_BYTES // 2:
                    self.forget()
            get = self.store.get
            found = [list(map(get, tokens)) for tokens in split]
            lacking = [k for k, got in enumerate(found) if None in got]
            fresh = {t for k in lacking for t, got in zip(split[k], found[k], strict=True) if got is None}
            for i in [x for x in fresh if isinstance(x, int)]:
                self.store[i] = i.to_bytes(4, "little")
                fresh.discard(i)
            if fresh:
                gc.disable()  # it makes many lists and no cycles
                try:
                    self.learn(list(fresh))
                finally:
                    gc.enable()
            for k in lacking:
                found[k] = list(map(get, split[k]))
            yield from map(b"".join, found)
    @property
    def known(self) -> dict[str | int, tuple[tuple[int, ...], str]]:
        """The pre-tokens that are remembered, with their ids as numbers and as text."""
        ids = {t: np.frombuffer(x, "<u4").tolist() for t, x in self.store.items()}
        return {t: (tuple(x), ",".join(map(str, x))) for t, x in ids.items()}

    def forget(self) -> None:
        self.store, self.held = {}, 0

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> ByteBPE:
    """The vocabulary of a file, loaded once per worker."""
    if path not in _codecs:
        _codecs[path] = ByteBPE(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the token ids of its texts in column `ids` (array of int), which replaces one of that name."""
    rest = docs.drop(ids)
    schema = T.StructType([*rest.schema, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    kept = [k for k, c in enumerate(docs.columns) if c in rest.columns]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for i, j in slices(batch.column(at), PIECE_BYTES):
                part = batch.slice(i, j - i)
                got = list(bpe.packed(part.column(at).to_pylist()))
                ends = np.cumsum([0] + [len(x) // 4 for x in got]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), "<i4")))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), made], names=schema.names)
        bpe.forget()
        slim()

    return mapped(docs, run, schema)


def decoded(frame: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """frame with the texts of its id arrays in column `text`, which replaces one of that name; null stays null."""
    rest = frame.drop(text)
    schema = T.StructType([*rest.schema, T.StructField(text, T.StringType())])
    kept = [k for k, c in enumerate(frame.columns) if c in rest.columns]
    at = frame.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            got = [bpe.decode(x.as_py()) if x.is_valid else None for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(got, pa.string())], names=schema.names)
        slim()

    return mapped(frame, run, schema)


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Ids and decoded texts of documents as digests, made in one pass so that neither crosses to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            texts, rows = batch.column(1), []
            for i, j in slices(texts, PIECE_BYTES):
                for ids, shown in bpe.encode_batch(texts[i:j].to_pylist()):
                    rows.append((len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=DIGEST.names)
        bpe.forget()
        slim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGEST)


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), vocabulary or tokenizer_path("byte_bpe_50k.json"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: documents with the digests of their ids and decoded texts."""
    return digests(docs, tokenizer_path("byte_bpe_50k.json"))
