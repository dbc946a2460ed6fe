"""Walks over the weak stretches of many reads at once: a depth-first search for each, all of them a window further at a time.

A step takes one window off each walk's stack, in the order in which PathCorrector.walk() takes them, so that
the paths and where they end are the same. A leftward walk goes right over the reverse complement.
"""

from __future__ import annotations

import numpy as np

from .lookup import SolidSet

#: Walks at a time; steps after which those that are left are walked one by one, as they may remember dead ends.
WALKS, STEPS = 4096, 6000
#: Paths that a walk without a limit may have before it is walked by itself.
PATHS = 512


class Stretch:
    """What fix() is asked for: a walk over a weak stretch from the window `before` to `end`."""

    __slots__ = ("codes", "q", "before", "end", "step", "boundary", "trim", "right", "made")

    def __init__(self, codes, q, before, end, step, boundary, trim, right, made=None):
        self.made = made  # changes of the first window, if the walk goes over a whole read
        self.codes, self.q, self.before, self.end, self.step, self.boundary, self.trim, self.right = codes, q, before, end, step, boundary, trim, right


class Walks:
    """The walks of some stretches, all of one corrector."""

    def __init__(self, solid: SolidSet, stretches: list[Stretch], free, most: int | None, partial: bool, fails: int, reach: int, powers: np.ndarray | None, boundary_free: bool):
        k, n = solid.k, len(stretches)
        self.solid, self.k, self.n, self.stretches = solid, k, n, stretches
        self.most, self.partial, self.fails, self.reach, self.powers = most, partial, fails, reach, powers
        self.depth = np.array([abs(s.end - s.before) for s in stretches], np.int64)
        self.width = w = int(self.depth.max()) + 1
        self.own, q, self.tail = np.zeros((n, w), np.uint8), np.full((n, w), 1 << 14, np.int16), np.zeros((n, k), np.uint8)
        first = np.empty((n, k), np.uint8)
        self.flip = np.array([0 if s.step > 0 else 3 for s in stretches], np.uint8)
        self.bounded = np.array([s.right is not None for s in stretches])
        for i, s in enumerate(stretches):
            if s.step > 0:
                a, b = s.before + k, s.end + k
                self.own[i, 1 : b - a + 1], q[i, 1 : b - a + 1] = s.codes[a:b], s.q[a:b]
                first[i] = s.codes[s.before : a]
                if s.right is not None:
                    after = s.codes[b : b + k]
                    self.tail[i, : len(after)] = after
            else:
                a, b = s.end, s.before
                self.own[i, 1 : b - a + 1], q[i, 1 : b - a + 1] = s.codes[a:b][::-1], s.q[a:b][::-1]
                first[i] = 3 - s.codes[b : b + k][::-1]
        self.free = free(q, self.bounded)
        for i, s in enumerate(stretches):
            e = -1 if s.boundary is None else (s.boundary - s.before) * s.step
            if 1 <= e < w:
                self.free[i, e] |= boundary_free
        self.q = q
        #: windows past the last one that can still lie over a changed base, as there are in the read
        self.whole = np.array([s.made is not None for s in stretches])
        self.touched = np.array([bool(s.made) for s in stretches])
        self.past = np.array([min(s.right, len(s.codes) - k) - s.end if s.right is not None else 0 for s in stretches], np.int64)
        self.start = np.zeros(n, np.uint64)
        for j in range(k):
            self.start = self.start << np.uint64(2) | first[:, j]

    def walked(self, leaf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By walk: whether it met more paths than are allowed, whether one without changes, and whether it has to be done by itself.

        leaf(walks, bases by window, mass, doubt, gain) is told of the paths with changes that hold, in their order.
        A path without changes ends its walk, as nothing will be changed then.
        """
        n, w, k = self.n, self.width, self.k
        two, mask = np.uint64(2), np.uint64(self.solid.mask)
        size = 3 * w + 5
        sf, sd, sb, sm = np.zeros(n * size, np.uint64), np.zeros(n * size, np.int16), np.zeros(n * size, np.uint8), np.zeros(n * size, np.uint8)
        sp = np.zeros(n, np.int64)
        own, free, path = self.own.ravel(), self.free.ravel(), np.zeros(n * w, np.uint8)
        mass, last = np.zeros(n * w), np.zeros(n * w, np.int16)
        doubt = np.ones(n * w) if self.powers is not None else None
        power = self.powers[self.q.ravel() & 511] if self.powers is not None else None
        if self.whole.any():
            mass[::w] = np.where(self.whole, self.solid.at(self.start), 0)
            if doubt is not None:
                doubt[::w] = [self.doubted(s) for s in self.stretches]
        count, alone, over = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
        most = PATHS if self.most is None else self.most
        bases = np.arange(4, dtype=np.uint8)
        late = np.zeros(n, bool)
        paths = path.reshape(n, w)

        def expand(r, f, d, root):
            at = r * w + d
            o = own[at]
            nxt = ((f << two)[:, None] | (bases[None, :] ^ self.flip[r][:, None])) & mask
            m = self.solid.at(nxt)
            ok = m > 0
            if not root:
                several = free[at] | ~ok[np.arange(len(r)), o]
                ok &= several[:, None] | (bases[None, :] == o[:, None])
            up = ok[:, ::-1].cumsum(1)[:, ::-1]
            i, b = np.nonzero(ok)
            to = (r * size + sp[r])[i] + up[i, b] - 1
            sf[to], sd[to], sb[to], sm[to] = nxt[i, b], d[i], b, m[i, b]
            sp[r] += up[:, 0]

        a = np.arange(n)
        expand(a, self.start, np.ones(n, np.int64), True)
        a = a[sp > 0]
        steps = 0
        while len(a):
            steps += 1
            if steps > STEPS:
                late[a] = True
                break
            top = sp[a] - 1
            sp[a] = top
            at = a * size + top
            f, d, b = sf[at], sd[at].astype(np.int64), sb[at]
            row = a * w + d
            changed = b != own[row]
            path[row] = b
            mass[row] = mass[row - 1] + sm[at]
            last[row] = np.where(changed, d, last[row - 1])
            if doubt is not None:
                doubt[row] = doubt[row - 1] * np.where(changed, power[row], 1.0)
            end = d == self.depth[a]
            if end.any():
                i = np.flatnonzero(end)
                r, e = a[i], row[i]
                count[r] += 1
                plain = (last[e] == 0) & ~self.touched[r]
                alone[r[plain]] = True
                if not self.partial:
                    over[r[count[r] > most]] = True
                good = ~plain & ~over[r]
                i, r, e = i[good], r[good], e[good]
                if len(r):
                    gain = self.holding(r, f[i], last[e].astype(np.int64))
                    gain = np.where(last[e] == 0, 0, gain)
                    good = gain >= 0
                    r, e, gain = r[good], e[good], gain[good]
                    if len(r):
                        leaf(r, paths, mass[e], doubt[e] if doubt is not None else None, gain)
                if self.most is None:
                    late |= count > most
            quit = alone[a] & (self.partial | ~self.whole[a])
            go = ~end & ~quit
            if self.partial or self.most is None:
                stop = count[a] > most
                go &= ~stop
                over[a[stop & ~end]] = True
            if go.any():
                expand(a[go], f[go], d[go] + 1, False)
            a = a[(sp[a] > 0) & ~over[a] & ~(alone[a] & (self.partial | ~self.whole[a])) & ~late[a]]
        return over, alone, late

    def doubted(self, s: Stretch) -> float:
        out = 1.0
        for p in s.made or ():
            out *= self.powers[s.q[p] & 511]
        return out

    def holding(self, r: np.ndarray, f: np.ndarray, last: np.ndarray) -> np.ndarray:
        """-1 where a path doesn't hold, else the multiplicity that prolonging the read adds, as holds() and extension() say."""
        gain = np.zeros(len(r), np.int64)
        inner = self.bounded[r]
        i = np.flatnonzero(~inner)
        if len(i):
            depth = np.minimum(self.reach - (self.depth[r[i]] - last[i]), self.k - 1)
            i, depth = i[depth > 0], depth[depth > 0]
            if len(i):
                best = self.solid.ahead(f[i], depth)
                gain[i] = np.where(best > 0, best, -1)
        i = np.flatnonzero(inner)
        if len(i):
            rr, g = r[i], f[i]
            over = np.minimum(last[i] - self.depth[rr] + self.k - 1, self.past[rr])
            failed = np.zeros(len(i), np.int64)
            for j in range(int(over.max())):
                g = (g << np.uint64(2) | self.tail[rr, j]) & np.uint64(self.solid.mask)
                failed += (j < over) & (self.solid.at(g) == 0)
            gain[i] = np.where(failed <= self.fails, 0, -1)
        return gain
