"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import xxhash

#: White space of the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Spans of more bytes are hashed one by one.
LONG = 64
#: The bytes of a block of eight that belong to a span of which 0 to 8 bytes are left.
OWN = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(values: np.ndarray) -> np.ndarray:
    """0 and the running sums, modulo 2**64 for unsigned values."""
    out = np.zeros(len(values) + 1, values.dtype if values.dtype == np.uint64 else np.int64)
    np.cumsum(values, out=out[1:])
    return out


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, equal for equal bytes wherever they stand: eight bytes a step, with
    the state mixed after each; long spans by XXH3."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # one from each byte on
    at, done = np.flatnonzero(size <= LONG), 0
    while len(at):
        left = size[at] - done
        out[at] = mix((out[at] ^ (blocks[starts[at] + done] & OWN[np.minimum(left, 8)])) * np.uint64(0xFF51AFD7ED558CCD))
        done += 8
        at = at[left > 8]
    view = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(view[starts[i] : ends[i]])
    return out


def rolling(values: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of values[i:i+n] for each i, or for those i in `at`; the state is mixed after each value."""
    if at is None:
        at = np.arange(max(0, len(values) - n + 1))
    out = mix(values[at] + np.uint64(n))
    for k in range(1, n):
        out = mix((out * np.uint64(0xC4CEB9FE1A85EC53)) ^ values[at + k])
    return out


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of the texts data[offsets[k]:offsets[k+1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """offsets start at 0 and end at len(data)."""
        self.data, self.offsets = data, offsets
        space = SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        inner = ~space
        before = np.ones(len(data), bool)
        before[1:] = space[:-1]
        after = np.ones(len(data), bool)
        after[:-1] = space[1:]
        self.space = space
        self.starts = np.flatnonzero(inner & (before | first[:-1]))
        self.ends = np.flatnonzero(inner & (after | first[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return spans_hash(self.data, self.starts, self.ends)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """The number of a text's bytes that have a flag, which few have."""
        return np.diff(np.searchsorted(np.flatnonzero(flags), self.offsets))

    def per_text_words(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each word over each text."""
        total = running(values.astype(np.int64))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]
