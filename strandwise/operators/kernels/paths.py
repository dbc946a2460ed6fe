"""Correction by candidate paths: solid regions are joined and prolonged over weak stretches.

Both correctors find the weak stretches alike and walk over them window by window, trying other bases
where a window isn't solid. They differ in which paths they keep and how they choose: by consensus
and qualities, or by a score of multiplicities and error probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import prod

import numpy as np
import pyarrow as pa

from strandwise.config import Consensus, Scored

from .batch import all_solid, laid, runs, windows
from .lanes import WALKS, Stretch, Walks
from .lookup import SolidSet, decode, encode


@dataclass
class Path:
    """Changed bases by position, in the order of the walk, and the weighted multiplicities met."""

    changes: dict[int, int] = field(default_factory=dict)
    mass: float = 0.0
    weight: float = 0.0

    def grown(self, p: int, base: int | None, m: float, weight: float) -> Path:
        return Path(self.changes if base is None else self.changes | {p: base}, self.mass + m * weight, self.weight + weight)


@dataclass
class Whole:
    """A read without a region to begin from."""

    codes: np.ndarray
    q: list[int]
    trim: Trim


@dataclass
class Trim:
    five: int = 0
    three: int = 0


class TooMany(Exception):
    """A walk met more paths than are allowed."""


def islands(good: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
    return [[int(a), int(b) - 1] for a, b in zip(edges[::2], edges[1::2])]


class PathCorrector:
    """What both correctors share; correct(bases, quals) -> (bases, quals, status)."""

    SETTLED = "unchanged"
    shave_ends_always = False
    #: The probability of an error by quality, as doubt() has it; negative qualities from the end.
    POWERS = np.array([10.0 ** (-(i if i < 256 else i - 512) / 10.0) for i in range(512)])
    #: Whether paths found before a walk met too many still count; how many bases a branch may try towards an end.
    partial, tried_limit = False, None

    def __init__(self, solid: SolidSet, config, offset: int, low: int, extreme: int):
        self.solid, self.k, self.config = solid, solid.k, config
        self.offset, self.low, self.extreme = offset, low, extreme

    def settled(self, bases: pa.Array) -> np.ndarray:
        """Reads of solid windows only: regions() leaves a region of all windows whole, whatever the qualities."""
        return all_solid(bases, self.solid)

    # --- k-mers as (forward, reverse complement) values

    def kmer(self, codes, window: int) -> tuple[int, int]:
        f = r = 0
        for i in range(self.k):
            f = f << 2 | int(codes[window + i])
            r = r << 2 | 3 - int(codes[window + self.k - 1 - i])
        return f, r

    def rolled(self, kmer: tuple[int, int], base: int, step: int) -> tuple[int, int]:
        f, r = kmer
        top = 2 * (self.k - 1)
        if step > 0:
            return (f << 2 | base) & self.solid.mask, r >> 2 | 3 - base << top
        return f >> 2 | base << top, (r << 2 | 3 - base) & self.solid.mask

    def m(self, kmer: tuple[int, int]) -> int:
        own, known = min(kmer), self.solid.known
        found = known.get(own)
        if found is None:
            if len(known) > 500_000:
                known.clear()
            keys = self.solid.keys
            at = int(np.searchsorted(keys, np.uint64(own)))
            found = known[own] = int(self.solid.counts[at]) if at < len(keys) and int(keys[at]) == own else 0
        return found

    # --- regions

    def regions(self, codes: np.ndarray, q: list[int], found: list[list[int]] | None = None) -> tuple[list[list[int]], list[list[int]]]:
        """Solid window runs (found, if known) after clean-up by quality, and the original run each one comes from."""
        c, k, n = self.config, self.k, len(codes)
        found = islands(self.solid.windows(codes) > 0) if found is None else found
        origin = [list(r) for r in found]
        if not found or found == [[0, n - k]]:
            return found, origin
        low = [x < self.low for x in q]
        if len(found) == 1:
            parts = [r for r in self.high_quality_parts(found[0], low, c.min_solid_length) if r]
            if parts and parts != found:
                found, origin = parts, [origin[0]] * len(parts)
        elif any(b[0] - a[1] < k for a, b in zip(found, found[1:])):
            split = [(part, o) for r, o in zip(found, origin) for part in self.high_quality_parts(r, low, 1)]
            found, origin = [p for p, _ in split], [o for _, o in split]
        kept = [(r, o) for r, o in zip(found, origin) if r[1] - r[0] + 1 >= c.min_solid_length]
        found, origin = [], []
        for r, o in kept:
            if found and r[0] - found[-1][1] - 1 < c.min_non_solid_length:
                found[-1][1] = r[1]
            else:
                found.append(list(r))
                origin.append(list(o))
        for a, b in zip(found, found[1:]):
            if k - c.suspect_length <= b[0] - a[1] - 1 < k:
                if b[1] - b[0] + 1 > c.suspect_length:
                    b[0] += c.suspect_length
                if a[1] - a[0] + 1 > c.suspect_length:
                    a[1] -= c.suspect_length
        if len(found) == 2 and found[1][0] - found[0][1] < k + 1:
            sizes = [r[1] - r[0] + 1 for r in found]
            if found[0][0] == 0:
                del found[1], origin[1]
            elif found[1][1] == n - k and sizes[1] >= 0.1 * n > sizes[0]:
                del found[0], origin[0]
        self.shave(found, low, n)
        return found, origin

    def high_quality_parts(self, region: list[int], low: list[bool], least: int) -> list[list[int]]:
        """The runs of windows of a region without a base of low quality, of `least` windows or more."""
        a, b = region[0], region[1] + self.k
        bad = [a - 1, *(p for p in range(a, b) if low[p]), b]
        return [[x + 1, y - self.k] for x, y in zip(bad, bad[1:]) if y - self.k - x >= least]

    def shave(self, found: list[list[int]], low: list[bool], n: int) -> None:
        """Shorten regions by up to adjust_range windows whose end bases have low quality."""
        k, reach = self.k, self.config.adjust_range
        for i, r in enumerate(found):
            size = r[1] - r[0] + (1 if self.shave_ends_always else 0)
            if size <= (min(reach, size) - 1 if self.shave_ends_always else reach):
                continue
            last, first = i == len(found) - 1, i == 0
            if not last or r[1] < n - k or self.shave_ends_always:
                hit = [w for w in range(r[1], max(r[0], r[1] - reach), -1) if low[w + k - 1] or (not last and low[w])]
                if hit:
                    r[1] = (min(hit) if self.shave_ends_always else hit[0]) - 1
            if (first and (r[0] > 0 or self.shave_ends_always)) or (self.shave_ends_always and not first):
                hit = [w for w in range(r[0], min(r[1], r[0] + reach)) if low[w if self.shave_ends_always else w + k - 1]]
                if hit:
                    r[0] = (max(hit) if self.shave_ends_always else hit[0]) + 1

    # --- walking

    def walk(self, codes, q, before: int, end: int, step: int, boundary: int | None, most: int | None, bounded: bool) -> list[Path]:
        """All paths of solid windows from the one after `before` to `end`.

        At the first window all four bases are tried; then all four where `free` says so, else the
        read's own base if that is solid and the other three if not. Beyond `most` paths the walk ends:
        with those found so far where `partial` says so, else by TooMany. A branch that has tried more
        than `tried_limit` bases goes no further. Windows found to lead nowhere aren't entered again.
        """
        k, out = self.k, []
        limit = None if bounded else self.tried_limit
        w = before + step
        p = w + k - 1 if step > 0 else w
        start = self.kmer(codes, before)
        stack, dead, cuts = [], set(), 0
        for base in (3, 2, 1, 0):
            nxt = self.rolled(start, base, step)
            if m := self.m(nxt):
                stack.append((w, nxt, Path().grown(p, None if base == codes[p] else base, m, 1.0), 0))
        while stack:
            w, kmer, path, tried = stack.pop()
            if path is None:
                if tried == (len(out), cuts):
                    dead.add((w, kmer))
                continue
            if w == end:
                out.append(path)
                if most is not None and len(out) > most and not self.partial:
                    raise TooMany
                continue
            if (w, kmer) in dead or (most is not None and len(out) > most):
                continue
            stack.append((w, kmer, None, (len(out), cuts)))
            w += step
            p = w + k - 1 if step > 0 else w
            own = int(codes[p])
            m_own = self.m(self.rolled(kmer, own, step))
            several = self.free(q, p, w, boundary, bounded) or not m_own
            further = []
            for b in range(4) if several else (own,):
                nxt = self.rolled(kmer, b, step)
                if m := self.m(nxt):
                    if several and w != end:
                        tried += 1
                        if limit is not None and tried > limit:
                            cuts += 1
                            break
                    further.append((w, nxt, path.grown(p, None if b == own else b, m, 1.0), tried))
            stack += reversed(further)
        return out

    def free(self, q, p: int, w: int, boundary: int | None, bounded: bool) -> bool:
        raise NotImplementedError

    def applied(self, codes, changes: dict[int, int]):
        out = codes.copy()
        for p, b in changes.items():
            out[p] = b
        return out

    def extension(self, codes, path: Path, step: int) -> float | None:
        """The best multiplicity met when the read is prolonged by solid windows past its end; None if it can't be.

        Only asked for changes nearer to the end than max_extend; as many windows as the change is nearer.
        """
        n, c = len(codes), self.config
        if not path.changes:
            return 0.0
        gap = n - 1 - max(path.changes) if step > 0 else min(path.changes)
        depth = c.max_extend - gap
        if depth <= 0:
            return 0.0
        kmer = self.kmer(self.applied(codes, path.changes), n - self.k if step > 0 else 0)
        level, best = [kmer], 0
        for _ in range(min(depth, self.k - 1)):
            level = [x for kmer in level for b in range(4) if self.m(x := self.rolled(kmer, b, step))]
            if not level:
                return None
            level = list(dict.fromkeys(level))
            best = max(best, *map(self.m, level))
        return float(best)

    # --- a read

    def correct(self, bases: str, quals: str) -> tuple[str, str, str]:
        job = self.job(bases, quals)
        try:
            want = next(job)
            while True:
                want = job.send(self.fix_one(want))
        except StopIteration as done:
            return done.value

    def correct_many(self, reads: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
        """correct() of many reads: the next weak stretches of all of them are walked at once."""
        out, jobs = [None] * len(reads), []
        for i, ((bases, quals), found) in enumerate(zip(reads, self.runs([bases for bases, _ in reads]))):
            jobs.append((i, self.job(bases, quals, found), None))
        while jobs:
            wanted = []
            for i, job, given in jobs:
                try:
                    wanted.append((i, job, job.send(given)))
                except StopIteration as done:
                    out[i] = done.value
            jobs = []
            for at in range(0, len(wanted), WALKS):
                some = wanted[at : at + WALKS]
                jobs += [(i, job, codes) for (i, job, _), codes in zip(some, self.fix_many([s for _, _, s in some]))]
        return out

    def runs(self, reads: list[str]) -> list[list[list[int]]]:
        """The runs of solid windows of every read, N as the base that takes its place."""
        base = self.config.subst_base
        codes, offsets = laid(pa.array([x.replace("N", base).replace("n", base) for x in reads], pa.string()))
        w = windows(codes, offsets, self.k, True)
        first, last = runs(self.solid.at(w.forward) > 0, w.read)
        out = [[] for _ in reads]
        pos = w.pos
        for r, a, b in zip(w.read[first].tolist(), pos[first].tolist(), pos[last].tolist()):
            out[r].append([a, b])
        return out

    def job(self, bases: str, quals: str, found: list[list[int]] | None = None):
        """Corrects a read; yields each Stretch to be fixed and is sent the codes after that."""
        n, k, c = len(bases), self.k, self.config
        if n < k or len(quals) != n:
            return bases, quals, "short"
        unknown = sum(map(bases.count, "Nn"))
        if self.too_many_unknown(unknown, n):
            return bases, quals, "unknown"
        clean = bases.replace("N", c.subst_base).replace("n", c.subst_base)
        codes = encode(clean).copy()
        q = [ord(x) - self.offset for x in quals]
        found, origin = self.regions(codes, q, found)
        trim = Trim()
        short_gap = any(b[0] - a[1] <= k for a, b in zip(found[:-1], found[1:-1]))
        if found and not short_gap:
            fixed = yield from self.around(codes, q, found, origin, trim)
        else:
            fixed = yield Whole(codes, q, trim)
        changed = int((fixed != codes).sum())
        if changed > c.max_error_ratio * n:
            return clean, quals, "too many errors"
        out = decode(fixed, clean)
        return self.finish(out, quals, trim, "corrected" if out != bases else "unchanged")

    def around(self, codes, q, found, origin, trim: Trim):
        n, k = len(codes), self.k
        for i, (a, b) in enumerate(zip(found, found[1:])):
            if b[0] - a[1] - 1 >= k and a[1] + k < n - trim.three and b[0] > trim.five:
                codes = yield Stretch(codes, q, a[1], b[0] - k, 1, origin[i][1], trim, b[0] - 1)
        if found[0][0] > 0 and found[0][0] > trim.five:
            codes = yield Stretch(codes, q, found[0][0], 0, -1, origin[0][0], trim, None)
        if found[-1][1] < n - k and found[-1][1] + k < n - trim.three:
            codes = yield Stretch(codes, q, found[-1][1], n - k, 1, origin[-1][1], trim, None)
        return codes

    def fix_one(self, s: Stretch | Whole):
        if isinstance(s, Whole):
            return self.without_region(s.codes, s.q, s.trim)
        return self.fix(s.codes, s.q, s.before, s.end, s.step, s.boundary, s.trim, s.right)

    def walks(self, stretches: list[Stretch], inner: bool) -> Walks:
        return Walks(self.solid, stretches, self.free_many, self.cap(inner), self.partial, self.allowed_fails(), self.config.max_extend, self.POWERS if self.partial else None, not self.partial)

    def fix_many(self, wanted: list[Stretch | Whole]) -> list:
        """fix() or without_region() of many; those of long reads, odd qualities or too many dead ends one by one."""
        out = [None] * len(wanted)
        for inner in (False, True):
            at = [i for i, s in enumerate(wanted) if isinstance(s, Stretch) and (s.right is not None) == inner and self.even(s)]
            if at:
                some = [wanted[i] for i in at]
                for i, s, found in zip(at, some, self.outcomes(self.walks(some, inner))):
                    if found is not None:
                        out[i] = self.applied(s.codes, self.combined(s, [found]))
        tried = [(i, changes) for i, s in enumerate(wanted) if isinstance(s, Whole) and len(s.codes) > self.k for changes in self.first_candidates(s.codes, s.q)]
        tried = [(i, x) for (i, x), good in zip(tried, self.prolonged(wanted, tried)) if good]
        by: dict[int, list] = {i: [] for i, s in enumerate(wanted) if isinstance(s, Whole) and len(s.codes) > self.k}
        for at in range(0, len(tried), WALKS):
            some = [(i, Stretch(self.applied(wanted[i].codes, x), wanted[i].q, 0, len(wanted[i].codes) - self.k, 1, None, wanted[i].trim, None, x)) for i, x in tried[at : at + WALKS]]
            good = [x for x in some if self.even(x[1])]
            for i, s in some:
                if not self.even(s):
                    by[i].append((s, None))
            if good:
                for (i, s), found in zip(good, self.outcomes(self.walks([s for _, s in good], False))):
                    by[i].append((s, found))
        for i, found in by.items():
            if all(x is not None for _, x in found):
                s = wanted[i]
                whole = Stretch(s.codes, s.q, 0, len(s.codes) - self.k, 1, None, s.trim, None, {})
                out[i] = self.applied(s.codes, self.combined(whole, [x for _, x in found]))
        return [self.fix_one(s) if x is None else x for s, x in zip(wanted, out)]

    def prolonged(self, wanted: list, tried: list[tuple[int, dict[int, int]]]) -> list[bool]:
        """Whether a read with these changes can be prolonged to the left, as far as extension() asks."""
        if not tried:
            return []
        first = np.array([wanted[i].codes[: self.k] for i, _ in tried])
        depth = np.zeros(len(tried), np.int64)
        for j, (_, changes) in enumerate(tried):
            for p, b in changes.items():
                first[j, p] = b
            depth[j] = min(self.config.max_extend - min(changes), self.k - 1) if changes else 0
        back = np.zeros(len(tried), np.uint64)
        for p in range(self.k - 1, -1, -1):
            back = back << np.uint64(2) | (3 - first[:, p])
        good, at = np.ones(len(tried), bool), np.flatnonzero(depth > 0)
        good[at] = self.solid.ahead(back[at], depth[at]) > 0
        return good.tolist()

    def even(self, s: Stretch) -> bool:
        depth = abs(s.end - s.before)
        return depth < 2000 and (self.tried_limit is None or 4 * depth <= self.tried_limit) and max(s.q) < 256 and min(s.q) > -256

    def changes(self, s: Stretch, path: np.ndarray) -> dict[int, int]:
        """The changed bases of a path given by window, in the order of the walk."""
        depth, k = abs(s.end - s.before), self.k
        own = s.codes[s.before + k : s.end + k] if s.step > 0 else s.codes[s.end : s.before][::-1]
        base = s.before + k if s.step > 0 else s.before - 1
        return (s.made or {}) | {base + s.step * e: int(path[e + 1]) for e in np.flatnonzero(path[1 : depth + 1] != own).tolist()}

    def fix(self, codes, q, before: int, end: int, step: int, boundary: int, trim: Trim, right: int | None):
        """Walk over one weak stretch and apply what is chosen; right is the last weak window between two regions."""
        try:
            paths = self.walk(codes, q, before, end, step, boundary, self.cap(right is not None), right is not None)
        except TooMany:
            paths = []
        paths = [p for p in paths if self.holds(codes, p, end, step, right)]
        if any(not p.changes for p in paths):
            return codes
        return self.applied(codes, self.choose(codes, q, paths, step, trim))

    def holds(self, codes, path: Path, end: int, step: int, right: int | None) -> bool:
        """Between regions: the windows over the right region stay solid. At an end: the read can be prolonged."""
        if not path.changes:
            return True
        if right is None:
            best = self.extension(codes, path, step)
            if best:
                self.reward(path, best)
            return best is not None
        last = max(path.changes)
        new = self.applied(codes, path.changes)
        fails = sum(not self.m(self.kmer(new, w)) for w in range(end, min(last, right, len(codes) - self.k) + 1))
        return fails <= self.allowed_fails()

    def substitutions(self, codes) -> list[dict[int, int]]:
        """Single changes that make the first window solid, by position and base."""
        good = self.solid.mutants(codes[: self.k])[0] > 0
        return [{int(p): int(b)} for p, b in np.argwhere(good)]

    def combinations(self, codes, positions: list[int]) -> list[dict[int, int]]:
        """All assignments of the positions that make the first window solid, the last position varying fastest."""
        f, r = (np.uint64(x) for x in self.kmer(codes, 0))
        fs, rs = np.array([f]), np.array([r])
        for p in positions:
            own, up, down = np.uint64(codes[p]), np.uint64(2 * (self.k - 1 - p)), np.uint64(2 * p)
            base = np.arange(4, dtype=np.uint64)
            fs = (fs[:, None] + ((base << up) - (own << up))[None, :]).ravel()
            rs = (rs[:, None] + ((own << down) - (base << down))[None, :]).ravel()
        out = []
        for i in np.flatnonzero(self.solid.of_many(fs, rs)).tolist():
            bases = [i >> 2 * (len(positions) - 1 - j) & 3 for j in range(len(positions))]
            out.append({p: b for p, b in zip(positions, bases) if b != codes[p]})
        return out

    def without_region(self, codes, q, trim: Trim):
        """Candidates for the first window, prolonged to the left, then over the whole read."""
        n, out = len(codes), []
        for changes in self.first_candidates(codes, q):
            if changes and self.extension(codes, Path(changes), -1) is None:
                continue
            new = self.applied(codes, changes)
            if n == self.k:
                out.append(Path(changes, float(self.m(self.kmer(new, 0))), 1.0))
                continue
            try:
                tails = self.walk(new, q, 0, n - self.k, 1, None, self.cap(False), False)
            except TooMany:
                continue
            for t in tails:
                path = Path(changes | t.changes, t.mass + self.m(self.kmer(new, 0)), t.weight + 1.0)
                if self.holds(new, t, n - self.k, 1, None):
                    out.append(path)
        if any(not p.changes for p in out):
            return codes
        return self.applied(codes, self.choose(codes, q, out, 1, trim))

    def reward(self, path: Path, best: float) -> None:
        pass

    def finish(self, bases: str, quals: str, trim: Trim, status: str) -> tuple[str, str, str]:
        return bases, quals, status


class ConsensusCorrector(PathCorrector):
    """Keeps what candidate paths agree on; qualities decide only by a clear margin; may trim."""

    def __init__(self, solid: SolidSet, config: Consensus | None = None, offset: int = 33, low: int = 0, extreme: int = 0):
        super().__init__(solid, config or Consensus(), offset, low, extreme)

    def too_many_unknown(self, unknown: int, n: int) -> bool:
        return unknown > int(n * self.config.max_n_ratio)

    def cap(self, bounded: bool) -> int | None:
        return self.config.max_paths

    def allowed_fails(self) -> int:
        return self.config.allowed_fails

    def free(self, q, p, w, boundary, bounded) -> bool:
        return q[p] <= self.extreme or w == boundary

    def free_many(self, q: np.ndarray, bounded: np.ndarray) -> np.ndarray:
        return q <= self.extreme

    def outcomes(self, walks: Walks) -> list:
        """By walk: changes of the paths that hold; None if it has to be done by itself."""
        held, kept = np.zeros(walks.n, np.int64), np.zeros((walks.n, self.config.max_paths + 1, walks.width), np.uint8)

        def leaf(r, paths, mass, doubt, gain):
            kept[r, held[r]] = paths[r]
            held[r] += 1

        over, alone, late = walks.walked(leaf)
        out = []
        for i, s in enumerate(walks.stretches):
            if late[i]:
                out.append(None)
            elif over[i]:
                out.append([])
            else:
                out.append([{}] if alone[i] else [self.changes(s, x) for x in kept[i, : held[i]]])
        return out

    def combined(self, s: Stretch, found: list[list[dict[int, int]]]) -> dict[int, int]:
        paths = [Path(x) for each in found for x in each]
        return {} if not all(x.changes for x in paths) else self.choose(s.codes, s.q, paths, s.step, s.trim)

    def most_trimmed(self, n: int) -> int:
        return max(0, min(int(n * self.config.max_trimming_rate), n - self.config.min_bases_after_trimming))

    def cut(self, trim: Trim, n: int, p: int) -> None:
        """Trim so that position p goes, from the 3' end if that is allowed, else from the 5' end."""
        if n - p <= self.most_trimmed(n):
            trim.three = max(trim.three, n - p)
        elif p + 1 <= self.most_trimmed(n):
            trim.five = max(trim.five, p + 1)

    def crowded(self, changes: dict[int, int], n: int) -> int | None:
        """A position where more than max_modification changes begin to fall within the check range: a likely indel."""
        at, most = sorted(changes), self.config.max_modification
        reach = max(1, int(n * self.config.check_range_ratio))
        return next((at[i] for i in range(len(at) - most) if at[i + most] - at[i] < reach), None)

    def choose(self, codes, q, paths: list[Path], step: int, trim: Trim) -> dict[int, int]:
        n = len(codes)
        if not paths:
            return {}
        costs = sorted(((sum(q[p] for p in x.changes), -i, x) for i, x in enumerate(paths)), key=lambda c: c[:2])
        best = costs[0][2].changes
        spot = self.crowded(best, n)
        if spot is not None:
            self.cut(trim, n, spot)
            return {}
        if len(paths) == 1 or costs[0][0] + self.config.min_qs_diff <= costs[1][0]:
            return best
        common = {p: b for p, b in best.items() if all(x.changes.get(p) == b for x in paths)}
        doubtful = {p for x in paths for p in x.changes if p not in common}
        if doubtful:
            self.cut(trim, n, min(doubtful) if step > 0 else max(doubtful))
        return {p: b for p, b in common.items() if trim.five <= p < n - trim.three}

    def first_candidates(self, codes, q) -> list[dict[int, int]]:
        k = self.k
        low = [p for p in range(k) if q[p] < self.low]
        worst = sorted(range(k), key=lambda p: q[p])[: self.config.max_low_qs_bases]
        own = [{}] if self.solid.of([int(x) for x in codes[:k]]) else []
        if not low:
            found = own or self.combinations(codes, worst) + self.substitutions(codes)
        elif len(low) <= self.config.max_low_qs_bases:
            found = self.combinations(codes, low) or own or self.substitutions(codes)
        else:
            found = self.combinations(codes, worst) + self.substitutions(codes) + own
        return list({tuple(sorted(x.items())): x for x in found}.values())

    def finish(self, bases: str, quals: str, trim: Trim, status: str) -> tuple[str, str, str]:
        n = len(bases)
        if self.config.trimming and 0 < trim.five + trim.three <= self.most_trimmed(n):
            return bases[trim.five : n - trim.three], quals[trim.five : n - trim.three], "trimmed"
        return bases, quals, status


class ScoredCorrector(PathCorrector):
    """Takes the path of the greatest mean multiplicity times probability that its changed bases were errors."""

    shave_ends_always = True

    def __init__(self, solid: SolidSet, config: Scored | None = None, offset: int = 33):
        config = config or Scored()
        super().__init__(solid, config, offset, config.qs_cutoff, config.qs_cutoff)
        self.partial, self.tried_limit = True, config.max_changes

    def too_many_unknown(self, unknown: int, n: int) -> bool:
        return unknown >= n * self.config.max_n_ratio

    def cap(self, bounded: bool) -> int | None:
        return None if bounded else self.config.max_paths

    def allowed_fails(self) -> int:
        return 0

    def free(self, q, p, w, boundary, bounded) -> bool:
        return not bounded and q[p] < self.low

    def free_many(self, q: np.ndarray, bounded: np.ndarray) -> np.ndarray:
        return (q < self.low) & ~bounded[:, None]

    def outcomes(self, walks: Walks) -> list:
        """By walk: (number of paths that hold, the best score if it is above the least, changes, whether a path has none); None if it has to be done by itself."""
        least = float(self.config.min_quality)
        held, top = np.zeros(walks.n, np.int64), np.full(walks.n, least)
        best = np.zeros((walks.n, walks.width), np.uint8)

        def leaf(r, paths, mass, doubt, gain):
            weight = np.where((gain > 0) & ~walks.whole[r], self.config.extension_weight, 0.0)
            score = (mass + gain * weight) / (walks.depth[r] + walks.whole[r] + weight) * doubt
            more = score > top[r]
            take = r[more | (held[r] == 0)]
            best[take] = paths[take]
            top[r[more]] = score[more]
            held[r] += 1

        _, alone, late = walks.walked(leaf)
        return [None if late[i] else (int(held[i]), float(top[i]), self.changes(s, best[i]) if held[i] and not alone[i] else {}, bool(alone[i])) for i, s in enumerate(walks.stretches)]

    def combined(self, s: Stretch, found: list[tuple[int, float, dict[int, int], bool]]) -> dict[int, int]:
        if any(alone for *_, alone in found):
            return {}
        best, top, one = {}, float(self.config.min_quality), sum(held for held, *_ in found) == 1
        for held, score, changes, _ in found:
            if held and (one or score > top):
                best, top = changes, score
        return best

    def reward(self, path: Path, best: float) -> None:
        path.mass += best * self.config.extension_weight
        path.weight += self.config.extension_weight

    def doubt(self, q, changes: dict[int, int]) -> float:
        return prod(10.0 ** (-q[p] / 10.0) for p in changes) if changes else 1.0

    def choose(self, codes, q, paths: list[Path], step: int, trim: Trim) -> dict[int, int]:
        if len(paths) == 1:
            return paths[0].changes
        best, top = {}, self.config.min_quality
        for x in paths:
            score = x.mass / x.weight * self.doubt(q, x.changes) if x.weight else 0.0
            if score > top:
                best, top = x.changes, score
        return best

    def first_candidates(self, codes, q) -> list[dict[int, int]]:
        c, k = self.config, self.k
        low = [p for p in range(k) if q[p] < self.low]
        order = sorted(range(k), key=lambda p: q[p])
        if 1 <= len(low) <= c.max_low_qs_bases:
            found = self.combinations(codes, low)[: c.max_first_paths + 3] or self.substitutions(codes)
        elif self.solid.of([int(x) for x in codes[:k]]):
            return [{}]
        elif not low:
            found = sorted(self.substitutions(codes), key=lambda x: order.index(next(iter(x))))
        else:
            found = self.combinations(codes, order[: c.max_low_qs_positions])
        if len(found) > c.max_first_candidates:
            found = sorted(found, key=lambda x: -self.doubt(q, x))[: c.max_first_candidates]
        return found


