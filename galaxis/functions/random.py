"""Seeded random streams that draw the same numbers as the engine whose results this library matches.

The generator is MT19937, but its key is filled by a recurrence on signed words whose product is rounded to a double
before it is cut to 32 bits, so the stream differs from that of numpy.random.RandomState with the same seed.
"""

from __future__ import annotations

import numpy as np


def _key(seed: int) -> np.ndarray:
    words = [seed & 0xFFFFFFFF]
    for i in range(1, 624):
        mixed = words[-1] ^ words[-1] >> 30
        signed = mixed - 2**32 if mixed >= 2**31 else mixed
        words.append(int(1812433253.0 * signed + i) & 0xFFFFFFFF)
    return np.array(words, np.uint32)


class SeededStream:
    """rand() in [0, 1) with 53 bits, uint32(), and rand_int(n) without bias. Without a seed it is NumPy's own."""

    def __init__(self, seed: int | None = None):
        bits = np.random.MT19937()
        if seed is not None:
            bits.state = {"bit_generator": "MT19937", "state": {"key": _key(int(seed)), "pos": 624}}
        self._state = np.random.RandomState(bits)

    def uint32(self) -> int:
        return int(self._state.randint(0, 2**32, dtype=np.uint32))

    def rand(self) -> float:
        return float(self._state.random_sample())

    def rand_int(self, n: int) -> int:
        """The draws below 2**32 mod n are rejected, so that all results are equally likely."""
        if int(n) != n or not 0 < n < 2**32:
            raise ValueError("n must be a positive integer below 2**32")
        least = 2**32 % n
        while True:
            x = self.uint32()
            if x >= least:
                return x % n

    def permutation(self, n: int) -> np.ndarray:
        """Each place, from the last down, changes with a drawn one at or before it."""
        out = np.arange(n)
        for i in range(n - 1, 0, -1):
            j = self.rand_int(i + 1)
            out[i], out[j] = out[j], out[i]
        return out
