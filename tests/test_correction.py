import random

import pytest

from strandwise.config import Settings
from strandwise.functions import kmers as fk
from strandwise.operators import correction, solid, spectrum
from strandwise.plans import pipeline

K = 15


def genome(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def simulated(spark):
    """Reads of a random genome at about 40 x, 1 % substitutions of low quality, and their true bases."""
    rng = random.Random(1)
    g, rows, truth = genome(rng, 3000), [], {}
    for i in range(1500):
        at = rng.randrange(len(g) - 80)
        true = g[at : at + 80]
        true = revcomp(true) if rng.random() < 0.5 else true
        bases, quals = list(true), [chr(33 + rng.randrange(32, 40)) for _ in true]
        for p in range(80):
            if rng.random() < 0.01:
                bases[p] = rng.choice([b for b in "ACGT" if b != true[p]])
                quals[p] = chr(33 + rng.randrange(2, 12))
        truth[i] = true
        rows.append((i, f"@r{i}", "".join(bases), "".join(quals)))
    rows.append((9000, "@short", "ACG", "III"))
    rows.append((9001, "@empty", "", ""))
    truth |= {9000: "ACG", 9001: ""}
    return spark.createDataFrame(rows, "read_id long, name string, bases string, quals string"), truth


@pytest.mark.parametrize("algorithm", ["conservative", "consensus", "scored"])
def test_errors_drop(spark, simulated, algorithm):
    from dataclasses import replace

    from strandwise.config import Consensus

    reads, truth = simulated
    settings = Settings(algorithms=(algorithm,), k=K, kmer_threshold=4, consensus=replace(Consensus(), trimming=False))
    before = {r["read_id"]: r["bases"] for r in reads.collect()}
    got = {r["read_id"]: r for r in pipeline.correct_reads(reads, settings)[algorithm].collect()}
    assert set(got) == set(truth)
    wrong = lambda x: sum(a != b for i in truth for a, b in zip(truth[i], x[i]))
    old, new = wrong(before), wrong({i: r["bases"] for i, r in got.items()})
    assert old > 800 and new < 0.25 * old, (old, new)
    assert all(len(r["bases"]) == len(r["quals"]) == len(truth[i]) for i, r in got.items())
    assert all(r["n_corrections"] == sum(a != b for a, b in zip(before[i], r["bases"])) for i, r in got.items())
    clean = [i for i in truth if before[i] == truth[i]]
    assert sum(got[i]["bases"] != truth[i] for i in clean) <= len(clean) // 100


def kernel(spark, reads, algorithm, k=K, threshold=3, **more):
    counts = spectrum.count_kmers(reads, k, 2)
    own = correction.solid_set(solid.solid_kmers(counts, threshold), k)
    return correction.corrector(algorithm, own, threshold, Settings(algorithms=(algorithm,), k=k, **more))


@pytest.mark.parametrize("algorithm", ["conservative", "consensus", "scored"])
@pytest.mark.parametrize("place", [0, 1, 20, 39, 40, 78, 79])
def test_single_error_with_deep_coverage(spark, algorithm, place):
    true = genome(random.Random(5), 80)
    reads = spark.createDataFrame([(i, true, "I" * 80) for i in range(40)], "read_id long, bases string, quals string")
    own = kernel(spark, reads, algorithm)
    bad = true[:place] + ("A" if true[place] != "A" else "C") + true[place + 1 :]
    fixed = own.correct(bad, "I" * place + "#" + "I" * (79 - place))[0]
    if K - 1 <= place <= 80 - K:
        assert fixed == true
    else:  # nearer to an end than a window other bases may be as good; but it gets no worse
        assert sum(a != b for a, b in zip(fixed, true)) <= 1
    assert own.correct(true, "I" * 80)[0] == true


def test_edge_reads(spark):
    true = genome(random.Random(6), 80)
    reads = spark.createDataFrame([(i, true, "I" * 80) for i in range(10)], "read_id long, bases string, quals string")
    for algorithm in ("conservative", "consensus", "scored"):
        own = kernel(spark, reads, algorithm)
        noise = genome(random.Random(8), 60)
        assert own.correct("ACG", "III")[0] == "ACG" and own.correct("", "")[0] == ""
        assert own.correct("N" * 60, "I" * 60)[0] == "N" * 60
        assert own.correct(noise, "I" * 60)[0] == noise
        assert own.correct(true[:40].lower(), "I" * 40)[0] == true[:40].lower()
        one_n = true[:30] + "N" + true[31:]
        assert own.correct(one_n, "I" * 30 + "#" + "I" * 49)[0] in (true, one_n)


def test_conservative_trim(spark):
    from strandwise.config import Conservative

    true = genome(random.Random(9), 60)
    reads = spark.createDataFrame([(i, true, "I" * 60) for i in range(10)], "read_id long, bases string, quals string")
    own = kernel(spark, reads, "conservative", conservative=Conservative(max_trim=30))
    tail = genome(random.Random(10), 12)
    assert own.correct(tail + true, "I" * 72) == (true, "I" * 60, "trimmed")


def test_solid_set_matches_join(spark, simulated):
    reads, _ = simulated
    trusted = solid.solid_kmers(spectrum.count_kmers(reads, K, 2), 4)
    own = correction.solid_set(trusted, K)
    from strandwise.operators.kernels.lookup import encode

    want = {}
    for r in solid.multiplicity(reads, trusted, K).collect():
        want.setdefault(r["read_id"], {})[r["pos"]] = r["m"]
    for r in reads.limit(50).collect():
        m = own.windows(encode(r["bases"]))
        assert m.tolist() == [want.get(r["read_id"], {})[i] for i in range(len(m))]
        assert [own.of(encode(r["bases"])[i : i + K]) for i in range(len(m))] == m.tolist()


def test_k32_roundtrip(spark):
    from pyspark.sql import functions as F

    kmers = ["T" * 32, "G" + "ACGT" * 7 + "ACG", "A" * 32]
    d = spark.createDataFrame([(x,) for x in kmers], "kmer string")
    got = d.select("kmer", fk.unpack_left(fk.pack_left("kmer"), 32).alias("back"), fk.pack_left("kmer").alias("p")).collect()
    assert all(r["kmer"] == r["back"] for r in got)
    assert {r["kmer"]: r["p"] for r in got}["T" * 32] == -1
    own = correction.solid_set(d.select(fk.canonical("kmer").alias("kmer"), F.lit(7).alias("m")), 32)
    from strandwise.operators.kernels.lookup import encode

    assert [own.of(encode(x)) for x in kmers] == [7, 7, 7] and own.of(encode("C" * 32)) == 0
