"""Many reads at once: their k-mer windows, multiplicities and mutants as flat numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .lookup import SolidSet, packed_windows

N = 4
CODE = np.zeros(256, np.uint8)
for _i, _b in enumerate("ACGT"):
    CODE[ord(_b)] = CODE[ord(_b.lower())] = _i
CODE[ord("N")] = CODE[ord("n")] = N
#: Mutants held at a time, whatever the batch: about 8 bytes each in a few arrays.
MUTANTS = 1 << 21


def laid(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all reads end to end, where each begins and the end): 0 to 3, N as 4, any other character as A; null is empty."""
    text = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(text) else (0, 0)
    data = np.frombuffer(text.buffers()[2], np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
    if len(data) and data.max() >= 128:  # a character is one base, however many bytes it has
        plain = [x.encode("ascii", "replace") for x in text.to_pylist()]
        data, offsets, first = np.frombuffer(b"".join(plain), np.uint8), np.cumsum([0, *map(len, plain)]), 0
    return CODE[data], offsets.astype(np.int64) - first


@dataclass
class Windows:
    """All windows of k bases that lie inside a read: where each starts, whose it is, its place there, and its two packed values."""

    k: int
    codes: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    read: np.ndarray
    forward: np.ndarray
    back: np.ndarray

    @property
    def pos(self) -> np.ndarray:
        return self.start - self.offsets[self.read]


def windows(codes: np.ndarray, offsets: np.ndarray, k: int, n_as_a: bool) -> Windows:
    """The windows of reads laid end to end; without n_as_a those with N are left out."""
    size = len(codes) - k + 1
    if size <= 0:
        none = np.empty(0, np.int64)
        return Windows(k, codes, offsets, none, none, none.astype(np.uint64), none.astype(np.uint64))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    good = owner[:size] == owner[k - 1 :]
    if not n_as_a:
        ns = np.concatenate([[0], np.cumsum(codes == N)])
        good &= ns[k:] == ns[:-k]
    clean = np.where(codes == N, 0, codes).astype(np.uint8)
    forward, back = packed_windows(clean, k)
    start = np.flatnonzero(good)
    return Windows(k, clean, offsets, start, owner[start], forward[start], back[start])


def partial_counts(column: pa.Array, k: int, n_as_a: bool) -> pa.RecordBatch:
    """(p, n): canonical k-mers of a batch, packed into signed 64 bits, and how often each occurs there."""
    w = windows(*laid(column), k, n_as_a)
    p, n = np.unique(np.minimum(w.forward, w.back), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(n.astype(np.int64))], ["p", "n"])


def runs(good: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each maximal run of good windows within one read."""
    if not len(good):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.concatenate([[True], read[1:] != read[:-1]])
    before = np.concatenate([[False], good[:-1]]) & ~new
    after = np.concatenate([good[1:] & ~new[1:], [False]])
    return np.flatnonzero(good & ~before), np.flatnonzero(good & ~after)


def lists(owner: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """values, in order of their owners 0 .. rows - 1, as one list for each owner."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def profile(column: pa.Array, solid: SolidSet) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(number of bases, multiplicity of every window, runs of solid windows (l, r)) of every read."""
    codes, offsets = laid(column)
    w = windows(codes, offsets, solid.k, True)
    m = solid.of_many(w.forward, w.back)
    first, last = runs(m > 0, w.read)
    pos, rows = w.pos, len(column)
    isles = pa.StructArray.from_arrays([pa.array(pos[first]), pa.array(pos[last])], ["l", "r"])
    return pa.array(np.diff(offsets)), lists(w.read, rows, pa.array(m.astype(np.int32))), lists(w.read[first], rows, isles)


def all_solid(column: pa.Array, solid: SolidSet, least: int = 1) -> np.ndarray:
    """Which reads have windows, no N, and a multiplicity of `least` or more in every window."""
    codes, offsets = laid(column)
    w = windows(codes, offsets, solid.k, True)
    weak = np.bincount(w.read[solid.of_many(w.forward, w.back) < least], minlength=len(column))
    unknown = np.bincount(np.searchsorted(offsets, np.flatnonzero(codes == N), "right") - 1, minlength=len(column))
    return (weak == 0) & (unknown == 0) & (np.diff(offsets) >= solid.k)


class Mutants:
    """Solid mutants of the weak windows of some reads: hit (window, offset, base), as flat indices and multiplicities."""

    def __init__(self, w: Windows, weak: np.ndarray, solid: SolidSet):
        self.w, self.weak = w, weak
        k = w.k
        own = w.codes[w.start[weak][:, None] + np.arange(k)[None, :]].astype(np.uint64)[:, :, None]
        base = np.arange(4, dtype=np.uint64)[None, None, :]
        right = np.arange(2 * (k - 1), -1, -2, dtype=np.uint64)[None, :, None]
        left = np.arange(0, 2 * k, 2, dtype=np.uint64)[None, :, None]
        forward = w.forward[weak][:, None, None] + (base << right) - (own << right)
        back = w.back[weak][:, None, None] + (own << left) - (base << left)
        m = solid.of_many(forward.ravel(), back.ravel()).reshape(forward.shape)
        m[np.broadcast_to(own == base, m.shape)] = 0
        self.m = m

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(read, place of the window, offset, base, multiplicity) of every solid mutant."""
        at, o, b = np.nonzero(self.m)
        window = self.weak[at]
        return self.w.read[window], self.w.pos[window], o, b, self.m[at, o, b]


def portions(offsets: np.ndarray, k: int, most: int = MUTANTS):
    """(first, past) of portions of the reads whose windows have about `most` mutants; a longer read is a portion of its own."""
    cost = np.maximum(np.diff(offsets) - k + 1, 0) * 4 * k
    total, first = 0, 0
    for i, c in enumerate(cost):
        if total and total + c > most:
            yield first, i
            total, first = 0, i
        total += c
    if first < len(cost):
        yield first, len(cost)


def each_portion(column: pa.Array, solid: SolidSet):
    """(first read, number of reads, windows, multiplicities, Mutants) of portions of a batch."""
    codes, offsets = laid(column)
    for first, past in portions(offsets, solid.k):
        w = windows(codes[offsets[first] : offsets[past]], offsets[first : past + 1] - offsets[first], solid.k, True)
        m = solid.of_many(w.forward, w.back)
        yield first, past - first, w, m, Mutants(w, np.flatnonzero(m == 0), solid)


LETTERS = np.array(list("ACGT"))


def mutations(column: pa.Array, solid: SolidSet):
    """(read, pos, o, b, m) arrays of all solid mutants of weak windows, portion by portion."""
    for first, _, _, _, mutants in each_portion(column, solid):
        read, pos, o, b, m = mutants.hits()
        yield first + read, pos, o, LETTERS[b], m


def vote_lists(column: pa.Array, solid: SolidSet, least: int) -> tuple[pa.ListArray, pa.ListArray]:
    """For every read the (pos, b, votes) by position and base: windows that would be solid with that base there; and the (pos, b) that win.

    They win where exactly one base has the read's most votes, at least `least`.
    """
    none = np.empty(0, np.int64)
    owners, places, bases, counts = [none], [none], [none], [none]
    for first, _, w, _, mutants in each_portion(column, solid):
        read, pos, o, b, _ = mutants.hits()
        key, n = np.unique((w.offsets[read] + pos + o) * 4 + b, return_counts=True)
        place = key // 4
        own = np.searchsorted(w.offsets, place, "right") - 1
        owners.append(first + own)
        places.append(place - w.offsets[own])
        bases.append(key % 4)
        counts.append(n)
    owner, pos, base, n = (np.concatenate(x) for x in (owners, places, bases, counts))
    names = pa.array(LETTERS[base]).cast(pa.string())
    top = np.zeros(len(column), np.int64)
    np.maximum.at(top, owner, n)
    best = np.flatnonzero((n == top[owner]) & (n >= least))
    same = (owner[best][1:] == owner[best][:-1]) & (pos[best][1:] == pos[best][:-1])
    won = best[~(np.concatenate([[False], same]) | np.concatenate([same, [False]]))] if len(best) else best
    ballots = pa.StructArray.from_arrays([pa.array(pos), names, pa.array(n)], ["pos", "b", "votes"])
    winners = pa.StructArray.from_arrays([pa.array(pos[won]), names.take(pa.array(won))], ["pos", "b"])
    return lists(owner, len(column), ballots), lists(owner[won], len(column), winners)


def unique_fixes(column: pa.Array, solid: SolidSet):
    """(read, pos, b) arrays: of every read of 2k - 1 bases and more the first base under no solid window whose outermost windows become solid by one base only.

    The windows are the one that starts at the base (or the last) and the one that ends there (or the first).
    """
    k = solid.k
    for first, _, w, m, mutants in each_portion(column, solid):
        size = np.diff(w.offsets)
        covered = np.zeros(len(w.codes) + 1, np.int64)
        good = np.flatnonzero(m > 0)
        np.add.at(covered, w.start[good], 1)
        np.add.at(covered, w.start[good] + k, -1)
        owner = np.repeat(np.arange(len(size)), size)
        at = np.flatnonzero((np.cumsum(covered)[:-1] == 0) & (size[owner] >= 2 * k - 1))
        read = owner[at]
        p = at - w.offsets[read]
        row = np.full(len(w.codes), -1, np.int64)
        row[w.start[mutants.weak]] = np.arange(len(mutants.weak))
        starts, ends = np.minimum(p, size[read] - k), np.maximum(p - k + 1, 0)
        a, z = row[w.offsets[read] + starts], row[w.offsets[read] + ends]
        both = (mutants.m[a, p - starts] > 0) & (mutants.m[z, p - ends] > 0)
        one = np.flatnonzero(both.sum(1) == 1)
        one = one[np.unique(read[one], return_index=True)[1]]
        yield first + read[one], p[one], LETTERS[both[one].argmax(1)]
