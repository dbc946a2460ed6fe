"""Walks of many reads at once against walks one by one."""

import random

import numpy as np
import pytest

from strandwise.config import Consensus, Scored
from strandwise.operators.kernels.lookup import SolidSet
from strandwise.operators.kernels.paths import ConsensusCorrector, ScoredCorrector


def solid_of(rng, k, share, genome):
    keys = {}
    for x in range(4**k) if k < 8 else ():
        if rng.random() < share:
            keys[x] = rng.randrange(2, 256)
    for i in range(len(genome) - k + 1):
        keys[sum("ACGT".index(c) << 2 * (k - 1 - j) for j, c in enumerate(genome[i : i + k]))] = rng.randrange(2, 256)
    canon = {}
    for x, n in keys.items():
        back = sum(3 - (x >> 2 * j & 3) << 2 * (k - 1 - j) for j in range(k))
        canon.setdefault(min(x, back), n)
    order = sorted(canon)
    return SolidSet(np.array(order, np.uint64), np.array([canon[x] for x in order], np.uint8), k)


def reads_of(rng, genome, many):
    for i in range(many):
        n = rng.choice([0, 3, 5, 14, 31, 60, 60, 60, 75])
        at = rng.randrange(len(genome) - n)
        bases = [c if rng.random() < 0.95 else rng.choice("ACGTNacgtn") for c in genome[at : at + n]]
        quals = [chr(33 + rng.choice([0, 1, 2, 5, 9, 12, 40])) for _ in bases]
        yield "".join(bases), "".join(quals) if i % 9 else "".join(quals[1:])


def compare(kind):
    rng, saw = random.Random(7), set()
    genome = "".join(rng.choice("ACGT") for _ in range(1500))
    for k, share in ((5, 0.3), (5, 0.7), (6, 0.45), (13, 0), (15, 0)):
        solid = solid_of(rng, k, share, genome)
        own = kind(solid)
        reads = list(reads_of(rng, genome, 120))
        want = [own.correct(*x) for x in reads]
        own.fix = own.without_region = lambda *a: pytest.fail("walked by itself") if len(a[0]) > k else a[0]
        assert own.correct_many(reads) == want
        saw |= {status for *_, status in want}
    return saw


def test_consensus_of_many_reads():
    saw = compare(lambda solid: ConsensusCorrector(solid, Consensus(min_bases_after_trimming=10), 33, 5, 1))
    assert {"corrected", "unchanged", "short", "unknown", "trimmed"} <= saw


def test_walks_given_up_are_walked_one_by_one(monkeypatch):
    from strandwise.operators.kernels import lanes

    rng = random.Random(1)
    genome = "".join(rng.choice("ACGT") for _ in range(500))
    solid, reads = solid_of(rng, 6, 0.4, genome), list(reads_of(rng, genome, 60))
    for own in (ConsensusCorrector(solid, Consensus(), 33, 5, 1), ScoredCorrector(solid, Scored(), 33)):
        want = own.correct_many(reads)
        monkeypatch.setattr(lanes, "STEPS", 3)
        assert own.correct_many(reads) == want
        monkeypatch.undo()


def test_reads_are_the_same_windows_by_strips(spark, tmp_path):
    from strandwise.plans import queries

    rng, wide = random.Random(2), queries.WIDTH * queries.STRIP
    sizes = [0, 1, 59, 60, 61, wide - 60, wide - 1, wide, wide + 1, 2 * wide - 1, 2 * wide, 2 * wide + 61]
    texts = ["".join(rng.choice("abcdxyz") for _ in range(n)) for n in sizes]
    rows = [*enumerate(texts), (99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["read_id"], r["bases"], r["quals"]) for r in queries.reads(spark, str(tmp_path)).collect())
    coded = lambda t, to: t.translate(str.maketrans(queries.LETTERS, to))
    cut = lambda t, i: t[i * 60 : i * 60 + 60]
    assert got == [(d * queries.WINDOWS + i, cut(coded(t, queries.BASES), i), cut(coded(t, queries.QUALS), i)) for d, t in enumerate(texts) for i in range(len(t) // 60 + 1)]


def test_scored_of_many_reads():
    saw = compare(lambda solid: ScoredCorrector(solid, Scored(), 33))
    assert {"corrected", "unchanged", "short"} <= saw


def test_scored_passes_reads_of_solid_windows_by():
    import pyarrow as pa

    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    own = ScoredCorrector(solid_of(rng, 11, 0, genome), Scored(), 33)
    whole, broken = genome[20:80], genome[20:50] + "ACGT"["ACGT".index(genome[50]) - 1] + genome[51:80]
    assert own.settled(pa.array([whole, broken, whole[:5], None])).tolist() == [True, False, False, False]
    assert own.correct(whole, "#" * 60) == (whole, "#" * 60, own.SETTLED)
