"""Walks that meet more paths than are allowed, or try many bases."""

import random

import numpy as np
import pytest

from strandwise.config import Consensus, Scored
from strandwise.operators.kernels.lookup import SolidSet, encode
from strandwise.operators.kernels.paths import ConsensusCorrector, Path, ScoredCorrector, TooMany

K = 5


def solid_set(kmers: dict[str, int], k: int = K) -> SolidSet:
    packed = {}
    for x, n in kmers.items():
        rc = x[::-1].translate(str.maketrans("ACGT", "TGCA"))
        packed[min(int(y.translate(str.maketrans("ACGT", "0123")), 4) for y in (x, rc))] = n
    keys = sorted(packed)
    return SolidSet(np.array(keys, np.uint64), np.array([packed[x] for x in keys], np.uint8), k)


def every(k=K):
    return ["".join("ACGT"[i >> 2 * j & 3] for j in range(k)) for i in range(4**k)]


def test_scored_chooses_among_the_paths_found_before_the_cap():
    own = ScoredCorrector(solid_set({x: 9 for x in every()}))
    codes, q = encode("ACGTTGCATGCATTGACCAT"), [2] * 20
    paths = own.walk(codes, q, 0, 15, 1, None, own.cap(False), False)
    assert own.config.max_paths < len(paths) <= own.config.max_paths + 4
    with pytest.raises(TooMany):
        consensus = ConsensusCorrector(own.solid, Consensus(), 33, 5, 5)
        consensus.walk(codes, q, 0, 15, 1, None, consensus.cap(False), False)


def test_scored_corrects_an_end_with_more_paths_than_the_cap():
    kept = "ACGTTGCATGCA"
    end = "GGTCA"
    solid = {x: 1 for x in every()} | {(kept + end)[i : i + K]: 200 for i in range(len(kept) + len(end) - K + 1)}
    own = ScoredCorrector(solid_set(solid))
    codes = encode(kept + "A" * len(end)).copy()
    q = [40] * len(kept) + [2] * len(end)
    paths = own.walk(codes, q, len(kept) - K, len(codes) - K, 1, None, own.cap(False), False)
    assert len(paths) > own.config.max_paths
    own.choose = lambda codes, q, paths, step, trim: seen.append(len(paths)) or {}
    seen = []
    # a path without changes would leave the read alone: the read's own end isn't solid
    gone = solid_set({x: n for x, n in solid.items() if x not in ("AAAAA", "TTTTT")})
    own.solid = gone
    own.fix(codes, q, len(kept) - K, len(codes) - K, 1, 0, None, None)
    assert seen and seen[0] > own.config.max_paths


def test_max_changes_is_per_branch():
    solid = solid_set({x: 9 for x in every()})
    codes, q = encode("ACGTTGCATGCATTGACCAT"), [2] * 20
    none = ScoredCorrector(solid, Scored(max_changes=3)).walk(codes, q, 0, 15, 1, None, 100, False)
    some = ScoredCorrector(solid, Scored(max_changes=20)).walk(codes, q, 0, 15, 1, None, 10**9, False)
    assert not none and some


def brute(own, codes, q, before, end, boundary):
    out = []

    def go(w, kmer, path):
        if w == end:
            return out.append(path)
        p = w + 1 + K - 1
        b0 = int(codes[p])
        free = own.free(q, p, w + 1, boundary, False) or not own.m(own.rolled(kmer, b0, 1))
        for b in range(4) if free else (b0,):
            if m := own.m(nxt := own.rolled(kmer, b, 1)):
                go(w + 1, nxt, path.grown(p, None if b == b0 else b, m, 1.0))

    first = own.kmer(codes, before)
    for b in range(4):
        p = before + K
        if m := own.m(nxt := own.rolled(first, b, 1)):
            go(before + 1, nxt, Path().grown(p, None if b == codes[p] else b, m, 1.0))
    return out


@pytest.mark.parametrize("kind", ["scored", "consensus"])
def test_walk_finds_all_paths(kind):
    rng = random.Random(3)
    for share in (0.3, 0.4, 0.5):
        solid = solid_set({x: rng.randrange(2, 99) for x in every() if rng.random() < share})
        own = ScoredCorrector(solid) if kind == "scored" else ConsensusCorrector(solid, None, 33, 5, 5)
        codes = encode("".join(rng.choice("ACGT") for _ in range(22)))
        q = [rng.choice([2, 40]) for _ in codes]
        assert own.walk(codes, q, 0, 17, 1, None, 10**9, False) == brute(own, codes, q, 0, 17, None)


def test_many_dead_ends_lose_no_path():
    """2047 windows are tried for the one path: more than 400 for each path allowed."""
    k, start, tail = 11, "ACGTTGCATGC", "GTGTG"
    branches = ["".join("GT"[i >> j & 1] for j in range(10)) for i in range(1024)]
    strings = [start + x for x in branches] + [start + "T" * 10 + tail]
    own = ConsensusCorrector(solid_set({x[i : i + k]: 9 for x in strings for i in range(len(x) - k + 1)}, k), None, 33, 5, 5)
    codes, q = encode(start + "A" * 10 + tail), [40] * k + [2] * 15
    paths = own.walk(codes, q, 0, 15, 1, None, 2, False)
    assert [x.changes for x in paths] == [{p: 3 for p in range(11, 21)}]
