"""The solid set as two sorted numpy arrays, and k-mers as unsigned integers, two bits a base, the last base lowest."""

from __future__ import annotations

import numpy as np

CODE = np.zeros(256, np.uint8)
for _i, _b in enumerate("ACGT"):
    CODE[ord(_b)] = CODE[ord(_b.lower())] = _i
LETTERS = "ACGT"
#: Odd, about 2^64 over the golden ratio: products spread neighbouring keys.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: The longest k-mers that are looked up in a table of all of their length.
DENSE = 13


def encode(bases: str) -> np.ndarray:
    """Codes 0 to 3; any other letter counts as A."""
    return CODE[np.frombuffer(bases.encode("latin-1", "replace"), np.uint8)]


def packed_windows(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(forward, reverse complement) values of all k-mers, vectorised over the windows."""
    n = len(codes) - k + 1
    forward, back = np.zeros(max(n, 0), np.uint64), np.zeros(max(n, 0), np.uint64)
    if n > 0:
        wide = codes.astype(np.uint64)
        for i in range(k):
            forward = (forward << np.uint64(2)) | wide[i : i + n]
            back = (back << np.uint64(2)) | (np.uint64(3) - wide[k - 1 - i : k - 1 - i + n])
    return forward, back


def revcomp(forward: np.ndarray, k: int) -> np.ndarray:
    back, left = np.zeros_like(forward), forward.copy()
    for _ in range(k):
        back = back << np.uint64(2) | (np.uint64(3) - (left & np.uint64(3)))
        left >>= np.uint64(2)
    return back


class SolidSet:
    """Multiplicity of canonical k-mers; 9 bytes for each."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, k: int):
        order = np.argsort(keys)
        self.keys, self.counts, self.k = keys[order], counts[order].astype(np.uint8), k
        self.mask = (1 << (2 * k)) - 1
        self.known: dict[int, int] = {}
        self._sieve, self._dense, self._ahead = None, None, {}

    def __getstate__(self):
        return self.keys, self.counts, self.k

    def __setstate__(self, state):
        self.keys, self.counts, self.k = state
        self.mask, self.known, self._sieve, self._dense, self._ahead = (1 << (2 * self.k)) - 1, {}, None, None, {}

    def sieve(self) -> tuple[np.ndarray, np.uint64]:
        """(whether any key falls there, by the top bits of a product; how far the product is shifted): about eight places a key, at most 64 MB."""
        if self._sieve is None:
            bits = min(26, max(10, int(len(self.keys) * 8).bit_length()))
            places = np.zeros(1 << bits, bool)
            places[(self.keys * SPREAD) >> np.uint64(64 - bits)] = True
            self._sieve = places, np.uint64(64 - bits)
        return self._sieve

    def dense(self) -> np.ndarray | None:
        """Multiplicity by the value of either strand, 64 MB at most; None for a k beyond DENSE."""
        if self._dense is None and self.k <= DENSE:
            self._dense = np.zeros(1 << 2 * self.k, np.uint8)
            self._dense[self.keys] = self.counts
            self._dense[revcomp(self.keys, self.k)] = self.counts
        return self._dense

    def at(self, forward: np.ndarray) -> np.ndarray:
        """Multiplicity of k-mers given by the value of one strand."""
        if (table := self.dense()) is not None:
            return table[forward]
        flat = forward.ravel()
        return self.of_many(flat, revcomp(flat, self.k)).astype(np.uint8).reshape(forward.shape)

    def ahead(self, forward: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The best multiplicity of solid k-mers that follow within `depth` bases, 0 where no chain of them is that long."""
        out = np.zeros(len(forward), np.int64)
        if self.k > DENSE:
            pairs, back = np.unique(np.stack([forward, depth.astype(np.uint64)]), axis=1, return_inverse=True)
            best = []
            for f, d in pairs.T:
                level, top = np.array([f]), 0
                for _ in range(int(d)):
                    level = np.unique(((level << np.uint64(2))[:, None] | np.arange(4, dtype=np.uint64)) & np.uint64(self.mask))
                    m = self.at(level)
                    level, top = level[m > 0], max(top, int(m.max()))
                best.append(top if len(level) else 0)
            return np.array(best, np.int64)[back.ravel()]
        short = np.uint64(self.mask >> 2)
        for d in np.unique(depth).tolist():
            i = np.flatnonzero(depth == d)
            out[i] = self.followed(d)[forward[i] & short]
        return out

    def followed(self, depth: int) -> np.ndarray:
        """ahead() by the last k - 1 bases."""
        if depth not in self._ahead:
            m = self.dense().reshape(4, -1)
            top, alive = m.reshape(-1, 4).max(1), None
            alive = top > 0
            self._ahead[1] = top
            for d in range(2, depth + 1):
                top = np.where(m > 0, np.maximum(m, top[None, :]), 0).reshape(-1, 4).max(1)
                alive = ((m > 0) & alive[None, :]).reshape(-1, 4).any(1)
                self._ahead[d] = np.where(alive, top, 0).astype(np.uint8)
        return self._ahead[depth]

    def of_many(self, forward: np.ndarray, back: np.ndarray) -> np.ndarray:
        own = np.minimum(forward, back)
        out = np.zeros(len(own), np.int64)
        if len(self.keys) and len(own):
            places, shift = self.sieve()
            maybe = np.flatnonzero(places[(own * SPREAD) >> shift])
            some = own[maybe]
            at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == some, self.counts[at], 0)
        return out

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """Multiplicity of every window, 0 if not solid."""
        return self.of_many(*packed_windows(codes, self.k))

    def mutants(self, codes: np.ndarray) -> np.ndarray:
        """Multiplicity by (window, offset, base) of every window with one base replaced; 0 for its own base."""
        k = self.k
        forward, back = packed_windows(codes, k)
        own = np.lib.stride_tricks.sliding_window_view(codes, k).astype(np.uint64)[:, :, None]
        base = np.arange(4, dtype=np.uint64)[None, None, :]
        right = np.arange(2 * (k - 1), -1, -2, dtype=np.uint64)[None, :, None]
        left = np.arange(0, 2 * k, 2, dtype=np.uint64)[None, :, None]
        f = forward[:, None, None] + (base << right) - (own << right)
        r = back[:, None, None] + (own << left) - (base << left)
        m = self.of_many(f.ravel(), r.ravel()).reshape(f.shape)
        return np.where(own == base, 0, m)

    def of(self, codes) -> int:
        """Multiplicity of one k-mer given as codes."""
        forward = back = 0
        for c in codes:
            forward = forward << 2 | int(c)
        for c in reversed(codes):
            back = back << 2 | 3 - int(c)
        own = min(forward, back)
        found = self.known.get(own)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            at = int(np.searchsorted(self.keys, np.uint64(own)))
            found = self.known[own] = int(self.counts[at]) if at < len(self.keys) and int(self.keys[at]) == own else 0
        return found


def decode(codes, original: str) -> str:
    """Letters of codes where they differ from the original's code, else the original's letters."""
    old = encode(original)
    changed = np.flatnonzero(old != np.asarray(codes, np.uint8))
    if not len(changed):
        return original
    out = list(original)
    for i in changed:
        out[i] = LETTERS[int(codes[i])]
    return "".join(out)
