"""Exact Jaccard join of n-gram sets by a partitioned universe and the pigeonhole principle.

Documents are sets of word shingles. Two sets whose sizes allow a link differ in at most H elements, so if the universe
is hashed into segments, H + 1 of them can't all differ. Segments are counted by size band: scheme k holds the sets of
band k and k + 1 and finds the pairs whose smaller set is in band k. A scheme has K segments, of which the first d are
also indexed by their one-deletion neighbourhoods; these differ unnoticed only if they differ twice, and so count twice.
K, d and the slack below are chosen for each band by expected cost from the numbers of documents of the bands.

Segments with no more than w elements are weak: unrelated documents share them. A scheme has more segments than it
needs, by a slack; a set skips its weak segments as long as they count no more than the slack, as then a linked pair
still shares another one. The few sets with more index all their segments, and meet among themselves.

Keys are packed into blocks by hash range, a few rows for each batch of documents, and met in numpy. What shares a key is
a bucket; buckets with the same members are one. Within a bucket, sets are compared by parity sketches: bits that tell
whether an even or odd number of elements falls on them differ at most where the sets do, so sets whose sketches differ
in more than H bits can't be linked. What passes is verified exactly on the texts, by rounds: each set against its most
alike one in a bucket, then a few others, then all that is left, always without those that are connected already or have
failed; a bucket whose pairs have all been taken is done with. So thousands of near copies, or of documents that share a long passage, don't become all their pairs. No cap
anywhere: the last round takes whatever is left, which for M unlinked sets of one bucket is at most the M**2 / 2 pairs
whose sketches allow a link. Buckets of more than BUCKET_ROWS sets are compared in pairs of parts.

Sets are named by 128-bit hashes of their 64-bit shingle hashes; those that share a bucket are numbered, and everything
after that is done by number.

Defined cases: texts without words, or null, have empty sets and are linked with nothing; with fewer words than a shingle
has, the whole sequence is one. Equal sets are one class from the start. Rows that repeat an id are documents one by
one. Null ids are larger than all others, and a component of them alone has the id null; the largest long counts as null.
Very long texts are read whole, one at a time, in about 30 bytes of memory for each byte of the text. Other columns, of any
name, are not looked at, and the pipeline stage returns them as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galaxis.llm._store import mapped, names_of, pieces, read, remove, saved, slim, unused, utf8
from galaxis.llm._words import LOWER, Words, mix, rolling

PIECE_BYTES, FLUSH_KEYS, KEYS_PER_TASK = 1 << 20, 1 << 18, 600_000
#: The sets that a task remembers to leave out copies, and the pairs of a batch.
SEEN, PAIR_ROWS = 200_000, 100_000
#: The most document ids that are broadcast to fetch or drop documents; more are joined by a shuffle.
MOST_BROADCAST = 400_000
NO_ID = 2**63 - 1
#: The sets of a bucket that are compared in one task; larger buckets are split. Partners of a set in a bucket by round.
BUCKET_ROWS, PARTNERS = 4096, (1, 3, 8)


@dataclass(frozen=True)
class Likeness:
    """Shingles of `words` words; sets are linked if 100 * intersection >= percent * union."""

    words: int = 4
    percent: int = 85

    def differ(self, a: int, b: int) -> int:
        """The most elements in which linked sets of a and b elements differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def edges(self, largest: int) -> list[int]:
        """The largest size of each band; a set's partners are at most one band away."""
        out, low = [], 1
        while low <= largest:
            out.append(low * 100 // self.percent)
            low = out[-1] + 1
        return out


@dataclass(frozen=True)
class Scheme:
    """segments K, of which `deletions` (d) have their one-deletion neighbourhoods indexed; slack; weak: w."""

    segments: int
    deletions: int
    slack: int
    weak: int


def _poisson_tail(mean: float, most: int) -> float:
    """P(X > most)."""
    if mean > 60:
        return 0.5 * math.erfc((most + 0.5 - mean) / math.sqrt(2 * mean))
    term = total = math.exp(-mean)
    for k in range(1, most + 1):
        term *= mean / k
        total += term
    return max(0.0, 1 - total)


def allocate(low: int, high: int, units: int, documents: int) -> Scheme:
    """The cheapest scheme for sets of low to high elements in which `units` segments suffice: its keys for a document,
    what unrelated documents meet in weak segments, and single elements, which may be frequent ones."""
    best: tuple[float, Scheme] | None = None
    size = (low + high) / 2
    for weak in (0, 1):
        for deletions in range(0, min(units // 2, 24) + 1):
            slack, worse = 0, 0
            while worse < 4 and slack <= units + 8:
                k = units + slack - deletions
                load = low / k
                p = [math.exp(-load) * load**c / math.factorial(c) for c in range(3)]
                few = sum(p[: weak + 1])
                mean = (k - deletions) * few + deletions * (2 * few + p[weak + 1])
                if k >= max(1, deletions):
                    over = _poisson_tail(mean, slack) if k > 1 else 0.0
                    cost = k + deletions * size / k + (0 if weak else 3 * k * p[1]) + over + documents * over * over * k * few
                    if best is None or cost < best[0]:
                        best, worse = (cost, Scheme(k, deletions, slack, weak)), 0
                    else:
                        worse += 1
                slack += 1 + slack // 8
    return best[1]


def schemes(likeness: Likeness, counts: dict[int, int]) -> tuple[list[int], dict[int, Scheme]]:
    """counts: documents by size band, of edges(). Schemes that can only find equal sets are left out."""
    edges = likeness.edges(likeness_size(likeness, max(counts, default=0)))
    out = {}
    for band in sorted({b for c in counts for b in (c, c - 1) if b >= 0}):
        low, high = (edges[band - 1] + 1 if band else 1), edges[band]
        apart = likeness.differ(high, high * 100 // likeness.percent)
        if apart:
            out[band] = allocate(low, high, apart + 1, counts.get(band, 0) + counts.get(band + 1, 0))
    return edges, out


def likeness_size(likeness: Likeness, band: int) -> int:
    """A size in a band."""
    low = 1
    for _ in range(band):
        low = low * 100 // likeness.percent + 1
    return low


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(data, offsets)
    lower = Words.__new__(Words)
    lower.data, lower.starts, lower.ends = LOWER[data], w.starts, w.ends
    hashes = lower.hashes()
    grams = rolling(hashes, words) if len(hashes) >= words else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        n = b - a
        if n >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif n:
            out.append(rolling(hashes[a:b], n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    offsets, data = utf8(column)
    for i, j in pieces(offsets, PIECE_BYTES):
        yield from shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)


def _name(elements: np.ndarray) -> bytes:
    """A set's name: 128 bits of a hash."""
    return xxhash.xxh3_128_digest(elements.tobytes())


SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("name", T.BinaryType()), T.StructField("band", T.IntegerType())])
BLOCKS = T.StructType([T.StructField("p", T.IntegerType()), T.StructField("names", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("keys", T.BinaryType())])
MEMBERS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("name", T.BinaryType())])
TEXTS = T.StructType([T.StructField("name", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("text", T.StringType())])
PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("open", T.LongType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("linked", T.BooleanType())])


def describe(docs: DataFrame, likeness: Likeness) -> DataFrame:
    """(id, n, name, band) of each document; the name is null for empty sets."""
    edges = np.array(likeness.edges(1 << 40), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), _name(s) if len(s) else None) for s in _sets(batch.column(1), likeness.words)]
            n, name = zip(*found, strict=True) if found else ((), ())
            band = np.searchsorted(edges, np.array(n, np.int64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(band)], names=SETS.names)
        slim()

    return docs.mapInArrow(run, SETS)


def keys(elements: np.ndarray, band: int, scheme: Scheme) -> np.ndarray:
    """The keys of a set in a scheme: a segment's is made of the sum of its elements' hashes, so that a deletion's is a
    subtraction."""
    k, d, w = scheme.segments, scheme.deletions, scheme.weak
    h = mix(elements + np.uint64(0x5851F42D4C957F2D))
    seg = ((h >> np.uint64(33)) * np.uint64(k) >> np.uint64(31)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    seg, h = seg[order], h[order]
    count = np.bincount(seg, minlength=k)
    sums = np.zeros(k, np.uint64)
    some = np.flatnonzero(count)
    sums[some] = np.add.reduceat(h, np.concatenate(([0], np.cumsum(count[some])[:-1])))
    lost = int((count[d:] <= w).sum()) + int(2 * (count[:d] <= w).sum() + (count[:d] == w + 1).sum())
    least = w if lost <= scheme.slack else -1  # keys of segments with more elements than this
    at = np.flatnonzero(count > least)
    tag = np.uint64((band + 1) * 0x9FB21C651E98DF25 % 2**64)

    def named(total: np.ndarray, segment: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(total + mix(segment.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64) + tag))

    out = named(sums[at], at, count[at])
    if d:
        inner = np.flatnonzero(seg < d)
        inner = inner[count[seg[inner]] - 1 > least]
        own = seg[inner]
        out = np.concatenate((out, named(sums[own] - h[inner], own, count[own] - 1)))
    return out


def _blocks(likeness: Likeness, edges: list[int], found: dict[int, Scheme], parts: int):
    """Keys of documents, packed by hash range: sets with the numbers of their keys, and 6 bytes of each key."""
    bands = np.array(edges, np.int64)

    def packed(names: list[bytes], lists: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(x) for x in lists]
        owner = np.repeat(np.arange(len(names)), sizes)
        values = np.concatenate(lists)
        p = ((values >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(p, kind="stable")
        p, owner = p[order], owner[order]
        # The low 48 bits: within a range of the high bits they tell keys apart well enough, as all links are verified.
        low = values[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        table = np.frombuffer(b"".join(names), "V16")
        cuts = np.searchsorted(p, np.arange(parts + 1))
        rows: list[tuple] = []
        for q in range(parts):
            a, b = int(cuts[q]), int(cuts[q + 1])
            if a < b:
                first = np.concatenate(([0], np.flatnonzero(np.diff(owner[a:b])) + 1))
                counts = np.diff(np.append(first, b - a)).astype("<u4")
                rows.append((q, table[owner[a:b][first]].tobytes(), counts.tobytes(), low[a:b].tobytes()))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=BLOCKS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lists, held, seen = [], [], 0, set()
        for batch in batches:
            for s in _sets(batch.column(0), likeness.words):
                if not len(s):
                    continue
                name = _name(s)
                if name in seen:
                    continue  # a copy of a set of this task
                seen.add(name)
                band = int(np.searchsorted(bands, len(s)))
                own = [keys(s, b, found[b]) for b in (band, band - 1) if b in found]
                if own:
                    names.append(name)
                    lists.append(np.concatenate(own))
                    held += len(lists[-1])
                if held >= FLUSH_KEYS:
                    yield packed(names, lists)
                    names, lists, held = [], [], 0
                if len(seen) >= SEEN:
                    seen.clear()
        if held:
            yield packed(names, lists)
        slim()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of a partition's keys: sets of two or more, each named by its members."""
    tables, owners, values, rows = [], [], [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            names, counts, low = (batch.column(c)[k].as_buffer() for c in (1, 2, 3))
            tables.append(np.frombuffer(names, "<u8").reshape(-1, 2).copy())
            owners.append(np.repeat(np.arange(rows, rows + len(tables[-1]), dtype=np.int32), np.frombuffer(counts, "<u4")))
            rows += len(tables[-1])
            wide = np.zeros((len(low) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(low, np.uint8).reshape(-1, 6)
            values.append(wide.view("<u8").ravel())
    if not tables:
        return
    table, owner, key = np.concatenate(tables), np.concatenate(owners), np.concatenate(values)
    del tables, owners, values
    order = np.argsort(key)
    owner, key = owner[order], key[order]
    del order
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    some = same[:-1] | same[1:]
    key, high, low = key[some], table[owner[some], 0], table[owner[some], 1]
    del table, owner, some, same
    order = np.lexsort((low, high, key))
    key, high, low = key[order], high[order], low[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    key, high, low = key[fresh], high[fresh], low[fresh]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    many = size > 1
    rows = np.repeat(many, size)
    high, low, size = high[rows], low[rows], size[many]
    if not len(high):
        return
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    bucket = mix(np.add.reduceat(mix(high ^ mix(low)), first) + size.astype(np.uint64))
    _, once = np.unique(bucket, return_index=True)
    keep = np.zeros(len(bucket), bool)
    keep[once] = True
    rows = np.repeat(keep, size)
    bucket, names = np.repeat(bucket, size)[rows].view(np.int64), np.stack((high[rows], low[rows]), 1)
    for a in range(0, len(bucket), PAIR_ROWS):
        part = np.ascontiguousarray(names[a : a + PAIR_ROWS])
        packed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(np.arange(0, 16 * len(part) + 1, 16, dtype=np.int32)), pa.py_buffer(part)])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[a : a + PAIR_ROWS]), packed], names=MEMBERS.names)
    slim()


def sketch(elements: np.ndarray) -> np.ndarray:
    """For each of some bits, a power of two of them, the parity of the number of elements that fall on it."""
    bits = 64
    while bits < 1.25 * len(elements):
        bits *= 2
    at = (mix(elements ^ np.uint64(0x243F6A8885A308D3)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer words, as it would have been made."""
    return np.bitwise_xor.reduce(words.reshape(-1, size), 0)


def _texts(likeness: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(_name(s), len(s), sketch(s).tobytes()) if len(s) else (None, 0, b"") for s in _sets(batch.column(0), likeness.words)]
            name, n, bits = zip(*sets, strict=True) if sets else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), batch.column(0)], names=TEXTS.names)

    return run


def _alike(likeness: Likeness, number: int):
    """Pairs of a round from buckets (bucket, p, q, part, node, c, n, sketch, buckets), sorted by bucket, p and q: sets of
    part p with sets of part q that may be linked and aren't connected. Where the buckets of each set are given, a pair is
    taken in the least that the two share. Buckets with more pairs than this round takes are `open`."""
    most = PARTNERS[number] if number < len(PARTNERS) else None
    less, more = 100 - likeness.percent, 100 + likeness.percent

    def of(rows: list[tuple], bucket: int, p: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Pairs of a set each, and whether it has others."""
        part, node, c, n, bits, lists = zip(*rows, strict=True)
        part, node, c, n = (np.array(v, np.int64) for v in (part, node, c, n))
        if (c == c[0]).all():
            return
        words = [np.frombuffer(x, np.uint64) for x in bits]
        size = min(map(len, words))
        table = np.stack([folded(w, size) for w in words])
        below = [np.array([x for x in y if x < bucket], np.int64) for y in lists] if lists[0] is not None else None
        for i in range(len(rows)):
            fits = c != c[i]
            if p != q:
                fits &= part != part[i]
            fits &= np.minimum(n, n[i]) * 100 >= likeness.percent * np.maximum(n, n[i])
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            apart = np.bitwise_count(table[at] ^ table[i]).sum(1, dtype=np.int64)
            near = apart * more <= less * (n[at] + n[i])
            at, apart = at[near], apart[near]
            if below is not None and len(at) and len(below[i]):
                elsewhere = np.isin(np.concatenate([below[j] for j in at.tolist()]), below[i])
                first = np.concatenate(([0], np.cumsum([len(below[j]) for j in at.tolist()])))
                own = np.diff(np.concatenate(([0], np.cumsum(elsewhere)))[first]) == 0
                at, apart = at[own], apart[own]
            others = most is not None and len(at) > most
            if most is None:
                at = at[at > i]
            elif others:
                if number:  # others in another bucket
                    apart = mix(node[at].astype(np.uint64) + np.uint64(rows_salt(rows)))
                at = at[np.argpartition(apart, most - 1)[:most]]
            if len(at):
                yield np.maximum(node[at], node[i]), np.minimum(node[at], node[i]), others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, held, open_ = None, [], [], []
        seen: set[int] = set()  # pairs of this task, to give out most of them once

        def out(least: int) -> Iterator[pa.RecordBatch]:
            if len(held) + len(open_) >= least:
                a, b = zip(*held, strict=True) if held else ((), ())
                none = [None]
                columns = (list(a) + none * len(open_), list(b) + none * len(open_), none * len(held) + open_)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PAIRS.names)
                held.clear()
                open_.clear()

        def close() -> Iterator[pa.RecordBatch]:
            others = False
            for a, b, more_of_it in of(rows, *key) if len(rows) > 1 else ():
                others |= more_of_it
                for pair in zip(a.tolist(), b.tolist(), strict=True):
                    if (name := pair[0] << 64 | pair[1]) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(name)
                        held.append(pair)
                yield from out(PAIR_ROWS)
            if others:
                open_.append(key[0])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    if row[:3] != key:
                        yield from close()
                        key, rows = row[:3], []
                    rows.append(row[3:])
                yield from out(PAIR_ROWS)
        yield from close()
        yield from out(1)
        slim()

    return run


def rows_salt(rows: list[tuple]) -> int:
    """A number of a bucket's own."""
    return (rows[0][1] * 31 + rows[-1][1]) & (2**63 - 1)


def _verify(likeness: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                a, b, left, right = batch.slice(at, 512).columns
                a, b = a.to_numpy(), b.to_numpy()
                names, back = np.unique(b, return_inverse=True)
                once = np.zeros(len(names), np.int64)
                once[back[::-1]] = np.arange(len(b))[::-1]
                pivots = list(_sets(right.take(pa.array(once)), likeness.words))
                linked = []
                for s, k in zip(_sets(left, likeness.words), back.tolist(), strict=True):
                    t = pivots[k]
                    common = len(np.intersect1d(s, t, assume_unique=True)) if min(len(s), len(t)) * 100 >= likeness.percent * max(len(s), len(t)) else 0
                    linked.append(common * 100 >= likeness.percent * (len(s) + len(t) - common))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(linked, pa.bool_())], names=LINKS.names)

    return run


def components(links: DataFrame, before: DataFrame | None) -> tuple[DataFrame, str]:
    """(node, c) of the nodes of links (a, b) and of `before`, the components so far: c is the least node that can be
    reached. Labels are taken from neighbours and then from the labels' own labels until nothing changes; each step is
    a table in the shared folder."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if before is not None:
        both = both.unionByName(before.where("node <> c").select(F.col("node").alias("a"), F.col("c").alias("b")))
        both = both.unionByName(before.where("node <> c").select(F.col("c").alias("a"), F.col("node").alias("b")))
    spark = links.sparkSession
    edges, edges_place = saved(both.distinct(), "edges")
    labels, place = saved(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("near"))
        step = labels.join(near, "node").select("node", "c", F.least("c", "near").alias("m"))
        own = labels.select(F.col("node").alias("m"), F.col("c").alias("jump"))
        step = step.join(own, "m").select("node", F.least("m", "jump").alias("c"), (F.least("m", "jump") != F.col("c")).alias("moved"))
        now, now_place = saved(step, "labels")
        moved = not now.where("moved").isEmpty()
        remove(spark, place)
        labels, place = now.select("node", "c"), now_place
        if not moved:
            remove(spark, edges_place)
            return labels, place


def _rounds(docs: DataFrame, classes: DataFrame, nodes: DataFrame, members: DataFrame, likeness: Likeness) -> tuple[DataFrame | None, list[str]]:
    """Components (node, c) of sets, by verified links of sets that share a bucket; None without links. And the tables that
    were written for them."""
    spark = docs.sparkSession
    reps, reps_place = _ids(classes.join(nodes, "name").select(F.col("rep").alias("id")))
    known = F.broadcast(nodes) if nodes.count() <= MOST_BROADCAST else nodes
    made = docs.join(reps, "id", "left_semi").select("text").mapInArrow(_texts(likeness), TEXTS).join(known, "name").drop("name")
    texts, texts_place = saved(made, "texts")
    places = [reps_place, texts_place]
    if texts.count() > nodes.count():  # an id that repeats has brought another row's text
        texts, once_place = saved(texts.dropDuplicates(["node"]), "texts")
        places.append(once_place)
    parts = members.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("parts"))
    members = members.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    comp, comp_place, number = None, None, 0
    done: list[DataFrame] = []
    while number <= len(PARTNERS):
        about = texts.select("node", "n", "sketch", F.col("node").alias("c"), F.lit(None).cast("array<long>").alias("buckets"))
        if number:
            about = about.drop("buckets").join(members.groupBy("node").agg(F.collect_set("bucket").alias("buckets")), "node")
        if comp is not None:
            about = about.withColumnRenamed("c", "own").join(comp, "node", "left").withColumn("c", F.coalesce("c", "own")).drop("own")
        whole = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("h")
        now = members.select("bucket", "node", "part", whole).withColumns({"p": F.least("part", "h"), "q": F.greatest("part", "h")})
        rows = now.join(about, "node").select("bucket", "p", "q", "part", "node", "c", "n", "sketch", F.filter("buckets", lambda x: x < F.col("bucket")).alias("buckets"))
        rows = rows.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "node")
        found, found_place = saved(rows.mapInArrow(_alike(likeness, number), PAIRS).distinct(), "alike")
        pairs = found.where("a IS NOT NULL").select("a", "b")
        if done:  # not those that have failed
            pairs = pairs.join(reduce(DataFrame.unionByName, done), ["a", "b"], "left_anti")
        pairs, pairs_place = saved(pairs, "pairs")
        open_, open_place = saved(found.where("a IS NULL").select(F.col("open").alias("bucket")), "open")
        remove(spark, found_place)
        places.append(open_place)
        number += 1
        if not pairs.isEmpty():
            needed, needed_place = _ids(pairs.select("a").union(pairs.select("b")).withColumnRenamed("a", "node"))
            own = texts.select("node", "text").join(needed, "node", "left_semi")
            left, right = own.toDF("a", "text_a"), own.toDF("b", "text_b")
            verified, links_place = saved(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify(likeness), LINKS), "links")
            places.append(links_place)
            remove(spark, needed_place)
            done.append(verified.where("NOT linked").select("a", "b"))
            links = verified.where("linked")
            if not links.isEmpty():
                before = comp_place
                comp, comp_place = components(links, comp)
                if before:
                    remove(spark, before)
        remove(spark, pairs_place)
        if open_.isEmpty():
            break
        members = members.join(open_, "bucket", "left_semi")
        if comp is not None:  # nor those whose sets are all connected
            found = members.join(comp, "node", "left").groupBy("bucket").agg(F.min(F.coalesce("c", "node")).alias("low"), F.max(F.coalesce("c", "node")).alias("high"))
            members = members.join(found.where("low <> high").select("bucket"), "bucket", "left_semi")
        members, members_place = saved(members, "members")
        places.append(members_place)
    return comp, places + ([comp_place] if comp_place else [])


def _ids(ids: DataFrame) -> tuple[DataFrame, str]:
    """Distinct ids as a table, to be broadcast unless there are too many; and the table's place."""
    ids, place = saved(ids.distinct(), "ids")
    return (F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids), place


def linked_components(docs: DataFrame, likeness: Likeness | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, name, component, root) of each document; ids are NO_ID for null. component is the least id; components of
    their own may have the same one, but not the same root."""
    likeness = likeness or Likeness()
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    sets, sets_place = saved(describe(docs, likeness), "sets")
    classes, classes_place = saved(sets.where("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("rep"), F.first("band").alias("band"), F.first("n").alias("n")), "classes")
    tally = classes.groupBy("band").agg(F.count("*").alias("sets"), F.sum("n").alias("n")).collect()
    edges, found = schemes(likeness, {r.band: r.sets for r in tally})
    expected = sum(r.n / (max(1, likeness_size(likeness, r.band))) * sum(found[b].segments + found[b].deletions * 8 for b in (r.band, r.band - 1) if b in found) for r in tally)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(expected / KEYS_PER_TASK))
    places, comp = [sets_place, classes_place], None
    if found:
        blocks = docs.select("text").mapInArrow(_blocks(likeness, edges, found, parts), BLOCKS)
        named, named_place = saved(blocks.repartitionById(parts, F.col("p")).mapInArrow(_meet, MEMBERS).distinct(), "named")
        nodes, nodes_place = saved(named.select("name").distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
        members, members_place = saved(named.join(nodes, "name").select("bucket", "node"), "members")
        remove(spark, named_place)
        comp, more = _rounds(docs, classes, nodes, members, likeness)
        places += [nodes_place, members_place, *more]
    if comp is None:
        of = classes.select("name", F.col("rep").alias("component"), F.hex("name").alias("root"))
    else:
        numbered = classes.select("name", "rep").join(nodes.join(comp, "node").select("name", "c"), "name", "left")
        least = numbered.where("c IS NOT NULL").groupBy("c").agg(F.min("rep").alias("least"))
        of = numbered.join(least, "c", "left").select("name", F.coalesce("least", "rep").alias("component"), F.coalesce(F.col("c").cast("string"), F.hex("name")).alias("root"))
    out, _ = saved(sets.select("id", "n", "name").join(of, "name", "left").select("id", "n", "name", F.coalesce("component", "id").alias("component"), "root"), "components")
    remove(spark, *places)
    return out


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return linked_components(read(spark, sf_dir, "documents")).select(null("id").alias("doc_id"), F.col("n").alias("n_shingles"), null("component").alias("component_id"))


def with_name(docs: DataFrame, likeness: Likeness, into: str, text: str = "text") -> DataFrame:
    """docs and the name of the text's set, as in describe()."""
    schema = T.StructType([*docs.schema, T.StructField(into, T.BinaryType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = [_name(s) if len(s) else None for s in _sets(batch.column(at), likeness.words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, pa.binary())], names=schema.names)

    return mapped(docs, run, schema)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near copies (five words, 0.8) one row stays: of those with the least id that
    with the least name, and of rows with one id and name the least row (as JSON if its columns have no order). Rows with
    empty sets are in no component and all stay. Null ids are larger than all others."""
    likeness = Likeness(5, 80)
    own = unused(docs, "id")
    marked = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    found = linked_components(docs, likeness)
    gone, _ = _ids(found.where("component <> id").select(F.col("id").alias(own)))
    # Null ids, and ids that repeat, don't name a row: their rows are decided by id and name.
    again, _ = _ids(found.groupBy("id").count().where("count > 1").select(F.col("id").alias(own)))
    if again.isEmpty():
        return marked.join(gone, own, "left_anti").select(*names_of(docs))
    name, row = unused(docs, "name"), F.struct(*names_of(docs))
    least = found.where("component = id AND name IS NOT NULL").withColumnRenamed("id", own).join(again, own, "left_semi")
    least = least.groupBy("root").agg(F.min(own).alias(own), F.min("name").alias(name)).select(own, name)
    rows = with_name(marked.join(again, own, "left_semi").select(*names_of(docs), own), likeness, name)
    unordered = any(kind in docs.schema.simpleString() for kind in ("map<", "variant"))
    once = rows.where(F.col(name).isNotNull()).groupBy(own, name).agg((F.min_by(row, F.to_json(row)) if unordered else F.min(row)).alias("row"))
    once = once.join(least, [own, name], "left_semi").select("row.*")
    rest = marked.join(again, own, "left_anti").join(gone, own, "left_anti").select(*names_of(docs))
    return rest.union(rows.where(F.col(name).isNull()).select(*names_of(docs))).union(once)


#: DuckDB: all pairs that share a shingle, and a recursive walk over the links.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)
"""
