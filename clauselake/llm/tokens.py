"""Words and their hashes from UTF-8 bytes, by whole arrays.

Words are runs of bytes other than ASCII white space (0x20, 0x09 to 0x0D); they never cross documents. A word's hash
mixes its bytes block by block, without the algebra that lets polynomials modulo 2**64 collide on long regular words.
Windows of word hashes are polynomials modulo 2**64 with odd bases, so a window's hash is a difference of prefix sums
times an inverse power.
"""

from __future__ import annotations

import hashlib

import numpy as np

from clauselake.llm.common import Slice

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
NONE = np.uint64(np.iinfo(np.uint64).max)
LONG_WORD = 256  # bytes; longer words are hashed one by one
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse for i below ``n`` at least, kept for the worker's next slices."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        tables = []
        for b in (base, inverse):
            table = np.full(size, b, dtype=np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        held = _powers[base] = (tables[0], tables[1])
    return held


def mixed(values: np.ndarray) -> np.ndarray:
    """Scramble 64 bits (the finaliser of splitmix64)."""
    z = values.astype(np.uint64, copy=True)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def window_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hashes of ``values[start:end]`` for arrays of bounds."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


class Words:
    """The words of a slice: ``starts`` and ``ends`` in its bytes, ``bounds`` of each row's words."""

    def __init__(self, part: Slice, lower: bool = False):
        self.data = _LOWER[part.data] if lower else part.data
        space = _SPACE[self.data]
        before = np.ones(len(space), dtype=bool)
        before[1:] = space[:-1]
        firsts = part.offsets[:-1]
        before[firsts[firsts < len(space)]] = True
        self.starts = np.flatnonzero(before & ~space)
        after = np.ones(len(space), dtype=bool)
        after[:-1] = space[1:]
        lasts = part.offsets[1:] - 1
        after[lasts[lasts >= 0]] = True
        self.ends = np.flatnonzero(after & ~space) + 1
        self.bounds = np.searchsorted(self.starts, part.offsets)
        self.counts = np.diff(self.bounds)
        self.rows = np.repeat(np.arange(part.rows), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: scrambled once per 8 bytes, by BLAKE2 for the few long ones."""
        size = self.ends - self.starts
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        blocks = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded, strides=(1,))
        out = mixed(size.astype(np.uint64) ^ np.uint64(BASES[0]))
        own, step = np.flatnonzero(size <= LONG_WORD), 0
        while len(own):
            left = np.minimum(size[own] - step, 8).astype(np.uint64)
            block = blocks[self.starts[own] + step] & (NONE >> (np.uint64(64) - left * np.uint64(8)))
            out[own] = mixed((out[own] + np.uint64(BASES[1])) ^ block)
            step += 8
            own = own[size[own] > step]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            digest = hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=8).digest()
            out[i] = np.frombuffer(digest, "<u8")[0]
        return out
