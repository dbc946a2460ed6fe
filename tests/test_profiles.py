"""Per-read judgements: by arrays and by joins alike, and against a plain loop; global order over ranges."""

import random

import pytest
from pyspark.sql import functions as F

from strandwise.operators import correction, order, profiles, regions, solid, spectrum
from strandwise.operators.kernels.batch import portions

import numpy as np


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module", params=[5, 13, 32])
def case(request, spark):
    k = request.param
    rng = random.Random(k)
    genome = "".join(rng.choice("ACGT") for _ in range(400)) + "A" * 60
    reads = []
    for _ in range(150):
        at = rng.randrange(len(genome) - 70)
        b = list(genome[at : at + rng.choice([0, 3, k - 1, k, 60, 70])])
        for _ in range(rng.choice([0, 0, 1, 2])):
            if b:
                b[rng.randrange(len(b))] = rng.choice("ACGTN")
        reads.append("".join(b))
    reads += ["", "a" * 70, "acgtn" * 12, "é" * 40, "A" * 300]
    rows = [(i, b) for i, b in enumerate(reads)] + [(999, None)]
    df = spark.createDataFrame(rows, "read_id long, bases string").withColumn("quals", F.col("bases")).repartition(3)
    trusted = solid.solid_kmers(spectrum.count_kmers(df, k, 2, True), 3)
    known = {r["kmer"]: r["m"] for r in trusted.collect()}
    return k, rows, df, trusted, known


def plain(bases, k, known):
    b = "".join(c if c in "ACGT" else "A" for c in (bases or "").upper())
    look = lambda x: known.get(min(x, rc(x)), 0)
    m = [look(b[i : i + k]) for i in range(len(b) - k + 1)]
    hits = [(w, o, x, look(b[w : w + o] + x + b[w + o + 1 : w + k])) for w, v in enumerate(m) if not v for o in range(k) for x in "ACGT" if x != b[w + o]]
    return b, m, [h for h in hits if h[3]]


@pytest.mark.parametrize("most", [1 << 30, 0])
def test_profile_votes_and_fixes(case, most):
    k, rows, df, trusted, known = case
    got = {r["read_id"]: r for r in profiles.profile(df, trusted, k, most).select("*", profiles.covered(k).alias("covered"), profiles.longest().alias("long"), profiles.gaps().alias("gaps")).collect()}
    polled = {r["read_id"]: r for r in profiles.votes(df, trusted, k, most).withColumn("top", profiles.most_votes()).collect()}
    mutated = sorted(tuple(r) for r in profiles.mutations(df, trusted, k, most).select("read_id", "pos", "o", "b", "m").collect())
    fixed = {r["read_id"]: (r["pos"], r["b"]) for r in profiles.unique_fixes(df, trusted, k, most).collect()}
    assert len(got) == len(polled) == len(rows)
    want_mutated, want_fixed = [], {}
    for i, bases in rows:
        b, m, hits = plain(bases, k, known)
        assert (got[i]["n"], got[i]["m"]) == (len(b), m)
        isles, run = [], None
        for w, v in enumerate([*m, 0]):
            run = (w if run is None else run) if v else (isles.append((run, w - 1)) if run is not None else None)
        assert [tuple(x) for x in got[i]["isles"]] == isles
        under = {p for l, r in isles for p in range(l, r + k)}
        assert got[i]["covered"] == len(under)
        assert (tuple(got[i]["long"]) if got[i]["long"] else None) == max(isles, key=lambda x: (x[1] - x[0], -x[0]), default=None)
        assert [tuple(x) for x in got[i]["gaps"]] == [(y[0], y[0] - x[1] - 1) for x, y in zip(isles, isles[1:])]
        want_mutated += [(i, *h) for h in hits]
        votes = {}
        for w, o, x, _ in hits:
            votes[w + o, x] = votes.get((w + o, x), 0) + 1
        assert [tuple(x) for x in polled[i]["votes"]] == [(*at, n) for at, n in sorted(votes.items())]
        top = max(votes.values(), default=None)
        best = [at for at, n in sorted(votes.items()) if n == top and n >= 3]
        assert polled[i]["top"] == top and [tuple(x) for x in polled[i]["won"]] == [at for at in best if sum(p == at[0] for p, _ in best) == 1]
        solids = {(w, o, x) for w, o, x, _ in hits}
        for p in range(len(b)) if len(b) >= 2 * k - 1 else ():
            s, e = min(p, len(b) - k), max(p - k + 1, 0)
            both = [x for x in "ACGT" if (s, p - s, x) in solids and (e, p - e, x) in solids]
            if p not in under and len(both) == 1:
                want_fixed[i] = (p, both[0])
                break
    assert mutated == sorted(want_mutated) and fixed == want_fixed


def test_islands_as_rows_equal_those_in_arrays(case):
    k, _, df, trusted, _ = case
    flat = regions.islands(solid.solid_windows(df, trusted, k))
    rows = profiles.profile(df, trusted, k).select("read_id", F.inline("isles"))
    assert sorted(map(tuple, flat.select("read_id", "l", "r").collect())) == sorted(map(tuple, rows.collect()))


def test_portions_hold_every_read_once():
    for sizes in ([], [0], [5], [0, 500, 3, 0, 70, 10_000, 1]):
        offsets = np.cumsum([0, *sizes])
        parts = list(portions(offsets, 5, 2000))
        assert [i for a, b in parts for i in range(a, b)] == list(range(len(sizes)))


def test_settled_reads_are_those_given_back(spark, case):
    from strandwise.config import Settings

    k, rows, _, trusted, _ = case
    own = correction.solid_set(trusted, k)
    import pyarrow as pa

    for name in ("conservative", "consensus", "scored"):
        kernel = correction.corrector(name, own, 1, Settings(k=k))
        for (_, bases), done in zip(rows, kernel.settled(pa.array([b for _, b in rows], pa.string()))):
            if done:
                assert kernel.correct(bases, "I" * len(bases)) == (bases, "I" * len(bases), kernel.SETTLED)


@pytest.mark.parametrize("n", [0, 1, 3_000_000])
def test_places_of_many_rows(spark, tmp_path, n):
    rows = spark.range(n).select(F.xxhash64("id").alias("key"), "id").repartition(7)
    out = order.numbered(rows, ["key"], str(tmp_path / "sorted"))
    assert out.columns == ["key", "id", "ordinal"]
    low = out.agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("d"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi")).first()
    assert tuple(low) == ((n, n, 0, n - 1) if n else (0, 0, None, None))
    if n:
        want = np.sort(np.array(rows.select("key").toArrow().column("key")))
        got = out.select("key", "ordinal").toArrow()
        placed = np.empty(n, np.int64)
        placed[np.array(got.column("ordinal"))] = np.array(got.column("key"))
        assert (placed == want).all()
    tied = spark.createDataFrame([(None,), (1,), (1,), (2,)], "key long")
    assert sorted(r["ordinal"] for r in order.numbered(tied, ["key"], str(tmp_path / "tied")).collect()) == [0, 1, 2, 3]
