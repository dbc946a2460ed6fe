"""Conservative correction: two-sided unique fixes, one-sided extension of solid regions, then votes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from strandwise.config import Conservative

from .batch import all_solid
from .lookup import SolidSet, decode, encode


def solid_regions(m: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of windows with multiplicity `least` or more."""
    good = np.concatenate([[False], m >= least, [False]])
    edges = np.flatnonzero(good[1:] != good[:-1])
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def covered(regions: list[tuple[int, int]], n: int, k: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for a, b in regions:
        out[a : b + k] = True
    return out


def leads(kmer: list[int]) -> bool:
    """Whether a k-mer comes before its reverse complement, compared by groups of four bases, in each of which the last base weighs most."""
    groups = lambda x: [x[i : i + 4][::-1] if len(x) - i >= 4 else [0] * (i + 4 - len(x)) + x[i:][::-1] for i in range(0, len(x), 4)]
    return groups(list(kmer)) < groups([3 - b for b in reversed(kmer)])


def served(regions: list[tuple[int, int]], longest_first: bool) -> list[tuple[int, int]]:
    """The regions in the order of a binary heap by length whose comparison never finds two equal.

    Of two regions of one length either is after the other, whichever is asked first; which comes out
    then depends on their places in the heap. It matters where regions fix one base differently.
    """
    size = lambda r: r[1] - r[0] if longest_first else r[0] - r[1]
    after = lambda a, b: size(a) <= size(b)
    heap: list[tuple[int, int]] = []
    for r in regions:
        at = len(heap)
        heap.append(r)
        while at and not after(r, heap[(at - 1) // 2]):
            heap[at], at = heap[(at - 1) // 2], (at - 1) // 2
        heap[at] = r
    out = []
    while heap:
        out.append(heap[0])
        r, at = heap.pop(), 0
        while 2 * at + 1 < len(heap):
            child = 2 * at + 1
            if child + 1 < len(heap) and after(heap[child], heap[child + 1]):
                child += 1
            if not after(r, heap[child]):
                break
            heap[at], at = heap[child], child
        if heap:
            heap[at] = r
    return out


class Corrector:
    """correct(bases, quals) -> (bases, quals, status)."""

    SETTLED = "clean"

    def settled(self, bases: pa.Array) -> np.ndarray:
        """Reads of solid windows only."""
        return all_solid(bases, self.solid, self.threshold)

    def __init__(self, solid: SolidSet, threshold: int, config: Conservative | None = None):
        self.solid, self.k, self.threshold, self.config = solid, solid.k, threshold, config or Conservative()

    def fixes(self, kmer: list[int], offset: int) -> list[tuple[int, int]]:
        """(base, multiplicity) of the other bases at the offset that make the k-mer solid, in cyclic order from its own on the strand that leads()."""
        kmer, own, out = list(kmer), kmer[offset], []
        turn = 1 if leads(kmer) else -1
        for step in (1, 2, 3):
            kmer[offset] = (own + turn * step) % 4
            if (m := self.solid.of(kmer)) >= self.threshold:
                out.append((kmer[offset], m))
        return out

    def correct(self, bases: str, quals: str) -> tuple[str, str, str]:
        n, k, c = len(bases), self.k, self.config
        if n < k:
            return bases, quals, "short"
        codes = encode(bases).copy()
        if (self.solid.windows(codes) >= self.threshold).all():
            return bases, quals, "clean"
        status, done = "corrected", self.two_sided(codes)
        for errors in range(1, c.max_errors + 1) if not done else ():
            if (end := self.one_sided(codes, errors)) or (end := self.vote(codes)):
                status = end
                break
        out = decode(codes, bases)
        if c.max_trim > 0 and not done:
            regions = solid_regions(self.solid.windows(codes), self.threshold)
            if regions:
                a, b = max(regions, key=lambda r: (r[1] - r[0], -r[0]))
                b += k
                if a > 0 and n - (b - a) <= c.max_trim:
                    return out[a:b], quals[a:b], "trimmed"
        return out, quals, status if out != bases or status == "clean" else "unchanged"

    def two_sided(self, codes: np.ndarray) -> bool:
        """Up to max_iters fixes that the k-mers at both ends of a position agree on; True when a round begins with all bases covered.

        They are the window that starts there (or the last) and the one that ends there (or the first).
        In a read of fewer than 2k - 1 bases the left k-mer of positions behind the last window's start
        isn't a window: it is the first window, rolled on by the bases from there.
        """
        n, k = len(codes), self.k
        last = n - k
        for _ in range(self.config.max_iters):
            cover = covered(solid_regions(self.solid.windows(codes), self.threshold), n, k)
            if cover.all():
                return True
            at = np.flatnonzero(~cover)
            start, end = np.minimum(at, last), np.maximum(at - k + 1, 0)
            good = self.solid.mutants(codes) >= self.threshold
            common = good[start, at - start] & good[end, at - end]
            for i in np.flatnonzero(at > last) if last < k - 1 else ():
                t = int(at[i]) - last
                left = [*codes[t:k].tolist(), *codes[last + 1 : last + 1 + t].tolist()]
                allowed = {b for b, _ in self.fixes(left, k - 1)}
                common[i] = good[start[i], at[i] - start[i]] & np.array([b in allowed for b in range(4)])
            single = np.flatnonzero(common.sum(1) == 1)
            if not len(single):
                return False
            codes[at[single[0]]] = int(common[single[0]].argmax())
        return False

    def one_sided(self, codes: np.ndarray, errors: int) -> str:
        """Two rounds of extending every solid region to both sides; a reason to end, or ''."""
        n, k = len(codes), self.k
        for longest_first in (True, False):
            regions = solid_regions(self.solid.windows(codes), self.threshold)
            if not regions:
                return "clean"
            cover = covered(regions, n, k)
            changes: dict[int, int] = {}
            for a, b in served(regions, longest_first):
                ahead = self.extend(codes, cover, b, errors, 1, -1)
                changes.update(ahead)
                changes.update(self.extend(codes, cover, a, errors, -1, ahead[0][0] if ahead else -1))
            for p, base in changes.items():
                codes[p] = base
        return ""

    def extend(self, codes: np.ndarray, cover: np.ndarray, window: int, errors: int, step: int, since: int) -> list[tuple[int, int]]:
        """(position, base) fixes of the bases that enter the window on its way from a region to the next covered base.

        Counted are fixes less than k from where counting began (`since`, or the first fix); one farther
        off begins anew, itself not counted. More than `errors` of them are taken back and end the way.
        """
        n, k = len(codes), self.k
        own, out, count = codes.tolist(), [], 0
        offset = k - 1 if step > 0 else 0
        window += step
        while 0 <= window <= n - k:
            p = window + offset
            if cover[p]:
                break
            if self.solid.of(own[window : window + k]) < self.threshold:
                found = self.fixes(own[window : window + k], offset)
                if len(found) > 1:
                    best = max((f for f in found if self.solid_ahead(own, window, p, f[0], step, self.config.max_errors - errors + 1)), key=lambda f: f[1], default=None)
                    found = [best] if best else []
                if not found:
                    break
                own[p] = found[0][0]
                out.append((p, own[p]))
                since = p if since < 0 else since
                if (p - since) * step < k:
                    count += 1
                    if count > errors:
                        del out[-count:]
                        break
                else:
                    since, count = p, 0
            window += step
        return out

    def solid_ahead(self, codes: list[int], window: int, p: int, base: int, step: int, count: int) -> bool:
        """Whether the next `count` k-mers, as far as there are, are solid with the base in place.

        To the left the base next to the window is passed over: the k-mers go on with those before it.
        """
        k = self.k
        kmer = codes[window : window + k]
        kmer[p - window] = base
        if step > 0:
            entering = codes[window + k : window + k + count]
        else:
            entering = codes[max(0, window - 1 - count) : max(0, window - 1)][::-1]
        for x in entering:
            kmer = [*kmer[1:], x] if step > 0 else [x, *kmer[:-1]]
            if self.solid.of(kmer) < self.threshold:
                return False
        return True

    def vote(self, codes: np.ndarray) -> str:
        """Set the bases that most weak windows would become solid with; a reason to end, or ''."""
        k, m = self.k, self.solid.windows(codes)
        votes = np.zeros((len(codes), 4), np.int64)
        good = (self.solid.mutants(codes) >= self.threshold) & (m < self.threshold)[:, None, None]
        for o in range(k):
            votes[o : o + len(m)] += good[:, o]
        top = votes.max()
        if top == 0:
            return "corrected"
        if top >= self.config.min_votes:
            hits = votes == top
            for p in map(int, np.flatnonzero(hits.sum(1) == 1)):
                codes[p] = int(hits[p].argmax())
        return ""
