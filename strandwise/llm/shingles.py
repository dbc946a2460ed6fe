"""Word shingles of byte strings in numpy: 64-bit hashes, MinHash signatures, exact overlap."""

from __future__ import annotations

import numpy as np
import xxhash

from .shared import remembers

WIDTH = 5
#: Odd multipliers, one for each word of a shingle; made from a rule, any odd numbers do.
FACTORS = np.array([xxhash.xxh3_64_intdigest(b"shingle%d" % i) | 1 for i in range(WIDTH)], np.uint64)


class Hashes(dict):
    """word -> 64-bit hash, forgotten when there are too many words."""

    most = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = Hashes()
remembers("near_dedup", _known.clear)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(data: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer words than
    width is one shingle; without words, or null, the set is empty.
    """
    words = data.lower().split() if data else ()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, n)
    if n < width:
        return mixed(np.atleast_1d((h * FACTORS[:n]).sum(dtype=np.uint64) + np.uint64(n)))
    total = h[: n - width + 1] * FACTORS[0]
    for i in range(1, width):
        total += h[i : n - width + 1 + i] * FACTORS[i]
    return np.unique(mixed(total))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


class MinHash:
    """Signatures of `slots` minima of random linear maps modulo 2^32: `keyed` of them as 16 bits, the others as 8."""

    def __init__(self, slots: int, keyed: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**31, slots, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, slots, dtype=np.uint32)
        self.keyed = keyed

    def __call__(self, hashes: np.ndarray, chunk: int = 512) -> bytes:
        least = np.full(len(self.a), 2**32 - 1, np.uint32)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(short), chunk):
            values = np.multiply.outer(self.a, short[i : i + chunk])
            values += self.b[:, None]
            np.minimum(least, values.min(1), out=least)
        least ^= least >> np.uint32(9)
        return least[: self.keyed].astype(np.uint16).tobytes() + least[self.keyed :].astype(np.uint8).tobytes()


def unpacked(sigs: list[bytes], keyed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (16-bit slots, 8-bit slots)."""
    flat = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)
    return np.ascontiguousarray(flat[:, : 2 * keyed]).view(np.uint16), flat[:, 2 * keyed :]
