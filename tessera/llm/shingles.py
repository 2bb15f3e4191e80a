"""Word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of `k` words; with fewer words the whole sequence is one; without words there are none.

    Words are runs of characters other than space and \\x09-\\x0D, with A-Z lower-cased. A set's id is a hash of
    its sorted hashes.
    """

    def __init__(self, k: int = 5):
        self.k = k
        self.words = _Words()
        self.weights = mixed(np.arange(1, k + 1, dtype=np.uint64) * MIX[0]) | np.uint64(1)

    def __call__(self, text: str) -> np.ndarray:
        # bytes.lower and bytes.split know ASCII only: exactly these letters and these spaces
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        width = min(self.k, len(h))
        n = len(h) - width + 1
        out = np.full(n, width, np.uint64)
        for j in range(width):
            out += mixed(h[j : j + n] + self.weights[j]) * self.weights[j]
        return np.unique(mixed(out))


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit id of a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def width_of(n: int, least: int = 64, most: int = 1 << 14) -> int:
    """Bits of the bitmap of a set of n: the power of two from 2 n on, within bounds."""
    return min(most, max(least, 1 << (2 * n - 1).bit_length()))


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity bitmap: bit i says whether an odd number of shingles hash to i.

    Two sets differ in at least as many shingles as their bitmaps differ in bits; a bitmap of half the width is the
    exclusive or of the two halves.
    """
    width = width_of(len(shingles))
    bits = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def folded(image: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(image, np.uint64)
    while len(x) * 64 > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x
