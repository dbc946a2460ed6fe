"""The conservative corrector against a plain one over strings, quirks included."""

import heapq
import random

import numpy as np
import pytest

from strandwise.config import Conservative
from strandwise.operators.kernels.conservative import Corrector, leads, served
from strandwise.operators.kernels.lookup import SolidSet

PAIR = str.maketrans("ACGT", "TGCA")


def rc(x):
    return x[::-1].translate(PAIR)


class Plain:
    """Reads as strings, k-mers as substrings, the solid set as a dictionary."""

    def __init__(self, known, k, threshold, max_errors=4, max_iters=2, max_trim=0):
        self.known, self.k, self.w, self.errors, self.iters, self.trim = known, k, threshold, max_errors, max_iters, max_trim

    def m(self, x):
        return self.known.get(min(x, rc(x)), 0)

    def solid(self, x):
        return self.m(x) >= self.w

    def mutants(self, x, i):
        order = []
        strand = x if self.front(x) else rc(x)
        j = i if strand is x else self.k - 1 - i
        for s in (1, 2, 3):
            y = strand[:j] + "ACGT"["ACGT".index(strand[j]) + s & 3] + strand[j + 1 :]
            if self.solid(y):
                y = y if strand is x else rc(y)
                order.append((y[i], self.m(y)))
        return order

    def front(self, x):
        value = lambda y: [sum("ACGT".index(c) * 4**p for p, c in enumerate(y[g : g + 4])) for g in range(0, len(y), 4)]
        return value(x) < value(rc(x))

    def under(self, b):
        return {p for w in range(len(b) - self.k + 1) if self.solid(b[w : w + self.k]) for p in range(w, w + self.k)}

    def both_ends(self, b):
        k, under = self.k, self.under(b)
        left = b[:k]
        for p in range(len(b)):
            size = len(b) - k
            right = b[min(p, size) : min(p, size) + k]
            if p >= k or p > size:
                left = left[1:] + b[p]
            if p in under:
                continue
            ours = [x for x, _ in self.mutants(right, p - min(p, size))]
            theirs = [x for x, _ in self.mutants(left, k - 1 if p >= k or p > size else p)]
            common = [x for x in ours if x in theirs]
            if len(common) == 1:
                return b[:p] + common[0] + b[p + 1 :]
        return None

    def regions(self, b):
        flags = "".join("1" if self.solid(b[w : w + self.k]) else "0" for w in range(len(b) - self.k + 1)) + "0"
        out, start = [], None
        for w, f in enumerate(flags):
            if f == "1" and start is None:
                start = w
            if f == "0" and start is not None:
                out.append((start, w - 1))
                start = None
        return out

    def way(self, b, under, kmer, path, at_end, e, since):
        """Roll kmer along the positions of path; the list of (position, base)."""
        got, count = [], 0
        for p in path:
            if p in under:
                break
            kmer = kmer[1:] + b[p] if at_end else b[p] + kmer[:-1]
            if self.solid(kmer):
                continue
            i = self.k - 1 if at_end else 0
            put = lambda x: kmer[:-1] + x if at_end else x + kmer[1:]
            found = self.mutants(kmer, i)
            if len(found) != 1:
                good = []
                for x, m in found:
                    y, ok = put(x), True
                    coming = b[p + 1 : p + 1 + self.errors - e + 1] if at_end else b[max(0, p - 1 - (self.errors - e + 1)) : max(0, p - 1)][::-1]
                    for c in coming:
                        y = y[1:] + c if at_end else c + y[:-1]
                        ok = ok and self.solid(y)
                    if ok:
                        good.append((x, m))
                found = [max(good, key=lambda f: f[1])] if good else []
            if not found:
                break
            kmer = put(found[0][0])
            got.append((p, found[0][0]))
            since = p if since < 0 else since
            if (p - since if at_end else since - p) < self.k:
                count += 1
                if count > e:
                    return got[: len(got) - count]
            else:
                since, count = p, 0
        return got

    def correct(self, b):
        k, n = self.k, len(b)
        if n < k:
            return b
        for _ in range(self.iters):
            if len(self.under(b)) == n:
                return b
            c = self.both_ends(b)
            if c is None:
                break
            b = c
        for e in range(1, self.errors + 1):
            for longest in (True, False):
                regions, under, fixes = self.regions(b), self.under(b), []
                if not regions:
                    return b
                for a, z in served(regions, longest):
                    ahead = self.way(b, under, b[z : z + k], range(z + k, n), True, e, -1)
                    back = self.way(b, under, b[a : a + k], range(a - 1, -1, -1), False, e, ahead[0][0] if ahead else -1)
                    fixes += ahead + back
                if not fixes:
                    break
                for p, x in fixes:
                    b = b[:p] + x + b[p + 1 :]
            votes = {}
            for w in range(n - k + 1):
                if not self.solid(b[w : w + k]):
                    for o in range(k):
                        for x, _ in self.mutants(b[w : w + k], o):
                            votes[w + o, x] = votes.get((w + o, x), 0) + 1
            top = max(votes.values(), default=0)
            if not top:
                break
            if top >= 3:
                for p in range(n):
                    best = [x for x in "ACGT" if votes.get((p, x)) == top]
                    if len(best) == 1:
                        b = b[:p] + best[0] + b[p + 1 :]
        if self.trim:
            best = max(self.regions(b), key=lambda r: (r[1] - r[0], -r[0]), default=None)
            if best and n - (best[1] + k - best[0]) <= self.trim and best[0] > 0:
                return b[best[0] : best[1] + k]
        return b


@pytest.mark.parametrize("k,dense", [(5, 0.1), (5, 0.3), (6, 0.15), (9, 0.0), (13, 0.0)])
@pytest.mark.parametrize("trim", [0, 12])
def test_equals_the_plain_corrector(k, dense, trim):
    rng = random.Random(k * 100 + int(dense * 10))
    changed = 0
    for _ in range(12):
        genome = "".join(rng.choice("ACGT") for _ in range(120))
        known = {}
        for w in range(len(genome) - k + 1):
            x = genome[w : w + k]
            known[min(x, rc(x))] = rng.choice([3, 4, 4, 9])
        for _ in range(int(dense * 4**k)):  # other k-mers, so that several changes are possible
            x = "".join(rng.choice("ACGT") for _ in range(k))
            known.setdefault(min(x, rc(x)), rng.choice([2, 3, 4, 4, 9]))
        names = sorted(known)
        value = lambda x: int("".join(str("ACGT".index(c)) for c in x), 4)
        solid = SolidSet(np.array([value(x) for x in names], np.uint64), np.array([known[x] for x in names], np.uint8), k)
        ours, plain = Corrector(solid, 3, Conservative(max_trim=trim)), Plain(known, k, 3, max_trim=trim)
        for _ in range(25):
            at = rng.randrange(80)
            b = list(genome[at : at + rng.choice([k - 1, k, k + 1, 2 * k - 2, 2 * k, 30, 40])])
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                b[rng.randrange(len(b))] = rng.choice("ACGT")
            b = "".join(b)
            want = plain.correct(b)
            assert ours.correct(b, "I" * len(b))[0] == want, (b, k)
            changed += want != b
    assert changed > 20


def test_strand_that_leads():
    assert leads([0, 0, 0, 0]) and not leads([3, 3, 3, 3])
    assert not leads([0, 3, 0, 3])  # ACAT... its own reverse complement comes first by the last base of the group
    assert not leads([0, 1, 2, 3])  # equal to its reverse complement
    rng = random.Random(1)
    for k in (3, 4, 7, 13, 32):
        for _ in range(50):
            x = [rng.randrange(4) for _ in range(k)]
            y = [3 - b for b in reversed(x)]
            assert leads(x) != leads(y) or x == y


def test_served_holds_every_region_by_length():
    rng = random.Random(2)
    for n in range(12):
        regions = [(i * 10, i * 10 + rng.randrange(4)) for i in range(n)]
        for longest in (True, False):
            out = served(regions, longest)
            sizes = [b - a for a, b in out]
            assert sorted(out) == regions and sizes == sorted(sizes, reverse=longest)
    different = [(i * 50, i * 50 + n) for i, n in enumerate([7, 3, 9, 1, 5])]
    assert served(different, False) == heapq.nsmallest(5, different, key=lambda r: r[1] - r[0])
