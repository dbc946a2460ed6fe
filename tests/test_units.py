import bz2
import gzip
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise import cli, config
from strandwise.functions import kmers as fk
from strandwise.operators import regions, spectrum, thresholds
from strandwise.plans import pipeline
from strandwise.sources import fastq
from strandwise.sources.merge import merge
from strandwise.streaming import counts as streaming


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def brute_counts(reads, k, n_as_a=False):
    out = {}
    for bases in reads:
        b = "".join(c if c in "ACGT" else "N" if c == "N" and not n_as_a else "A" for c in bases.upper())
        for i in range(len(b) - k + 1):
            w = b[i : i + k]
            if "N" not in w:
                out[min(w, rc(w))] = out.get(min(w, rc(w)), 0) + 1
    return out


@pytest.mark.parametrize("k", [2, 4, 7, 32])
@pytest.mark.parametrize("n_as_a", [False, True])
def test_counts_against_brute_force(spark, k, n_as_a):
    rng = random.Random(k)
    reads = ["".join(rng.choice("ACGTNacgtnRU") if rng.random() < 0.1 else rng.choice("ACGT") for _ in range(rng.choice([0, 1, k - 1, k, 40, 60]))) for _ in range(60)]
    reads += ["N" + "A" * 40, "A" * 20 + "N" + "C" * 40, "G" * 40 + "N", "ACGT" * 10]
    df = spark.createDataFrame([(i, b, "") for i, b in enumerate(reads)], "read_id long, bases string, quals string")
    got = {r["kmer"]: r["cnt"] for r in spectrum.count_kmers(df, k, 1, n_as_a).collect()}
    assert got == brute_counts(reads, k, n_as_a)


def test_strand_symmetry_and_saturation(spark):
    rng = random.Random(2)
    reads = ["".join(rng.choice("ACGT") for _ in range(50)) for _ in range(10)]
    count = lambda rs: {r["kmer"]: r["cnt"] for r in spectrum.count_kmers(spark.createDataFrame([(i, b) for i, b in enumerate(rs)], "read_id long, bases string"), 9, 1).collect()}
    assert count(reads) == count([rc(r) for r in reads])
    many = spark.createDataFrame([("A", 300), ("C", 255), ("G", 2)], "kmer string, cnt long")
    assert {r["bin"]: r["n"] for r in spectrum.kmer_histogram(many).collect() if r["n"]} == {255: 2, 2: 1}
    assert {r["cnt"] for r in spectrum.saturated(many).collect()} == {255, 2}


def test_functions(spark):
    d = spark.createDataFrame([("ACGTA",), ("acgnr",), ("TTTTT",)], "x string")
    r = d.select(fk.revcomp("x").alias("rc"), fk.normal("x").alias("n"), fk.roll_right("x", F.lit("G")).alias("right"), fk.roll_left("x", F.lit("G")).alias("left"), fk.pack("x").alias("p"), fk.count_ns("x").alias("ns"), fk.replace_ns("x").alias("a"), fk.gc("x").alias("gc"), fk.unpack(fk.pack("x"), 5).alias("u")).collect()
    assert (r[0]["rc"], r[0]["right"], r[0]["left"], r[0]["p"], r[0]["u"]) == ("TACGT", "CGTAG", "GACGT", 0b0001101100, "ACGTA")
    assert (r[1]["n"], r[1]["ns"], r[1]["a"], r[1]["gc"]) == ("ACGNA", 1, "acgAr", 2)
    assert r[2]["p"] == 2**10 - 1
    e = spark.createDataFrame([("!",), ("+",), ("I",)], "q string").select(fk.error_probability("q").alias("e")).collect()
    assert [round(x["e"], 6) for x in e] == [1.0, 0.1, 0.0001]
    assert [fk.clamp_k(k) for k in (1, 2, 32, 33)] == [2, 2, 32, 32]


histograms = st.lists(st.integers(0, 400), min_size=254, max_size=254) | st.lists(st.sampled_from([0, 0, 0, 50, 100, 500]), min_size=254, max_size=254)


def test_cutoffs_sql_equals_python(spark):
    rng = random.Random(4)
    some = [[0, 0] + [rng.choice([0, 0, 5, 99, 100, 101, 300, 1000]) if rng.random() < p else 0 for _ in range(254)] for p in (0.02, 0.1, 0.5, 1.0) for _ in range(12)]
    some += [[0, 0] + sorted((rng.randrange(500) for _ in range(254)), reverse=True), [0] * 256, [0, 0, 900, 500, 200, 120, 150, 400, 800, 400] + [0] * 246]
    d = spark.createDataFrame([(h, i, n) for h, bins in enumerate(some) for i, n in enumerate(bins)], "hid int, bin int, n long")
    got = {r["hid"]: (r["conservative"], r["consensus"], r["scored"]) for r in thresholds.kmer_cutoffs(d).collect()}
    for h, bins in enumerate(some):
        try:
            second = thresholds.consensus_cutoff(bins)
        except thresholds.NoCutoff:
            second = None
        assert got[h] == (thresholds.conservative_cutoff(bins), second, thresholds.scored_cutoff(bins)), h


@given(histograms)
@settings(max_examples=60, deadline=None)
def test_cutoff_properties(tail):
    h = [0, 0, *tail]
    scored = thresholds.scored_cutoff(h)
    assert 2 <= scored <= 255 and 2 <= thresholds.conservative_cutoff(h) <= 256
    try:
        assert thresholds.consensus_cutoff(h) == scored
    except thresholds.NoCutoff:
        pass


@pytest.mark.parametrize("codes,want", [(range(33, 74), 33), (range(64, 105), 64), (range(40, 90), None), (range(20, 60), None), (range(60, 74), 33), (range(75, 80), 64)])
def test_quality_offset(spark, codes, want):
    h = [1 if i in codes else 0 for i in range(127)]
    row = thresholds.quality_cutoff_table(spark.createDataFrame([(i, n) for i, n in enumerate(h)], "bin int, n long")).first()
    if want is None:
        with pytest.raises(thresholds.NoCutoff):
            thresholds.quality_offset(h)
    else:
        assert thresholds.quality_offset(h) == want
        low, lowest = thresholds.quality_cutoffs(h, want)
        assert (row["cutoff"], row["extreme_cutoff"]) == (low, lowest)
    assert row["qs_offset"] == want


def test_islands_and_coverage(spark):
    rng = random.Random(7)
    rows = [(r, p) for r in range(20) for p in range(50) if rng.random() < 0.6]
    d = spark.createDataFrame(rows, "read_id long, pos long")
    isles = regions.islands(d)
    covered = {r["read_id"]: r["covered"] for r in regions.coverage(isles, 6).collect()}
    want = {}
    for r, p in rows:
        want.setdefault(r, set()).update(range(p, p + 6))
    assert covered == {r: len(s) for r, s in want.items()}


RECORDS = [(f"@r{i} {'x' * (i % 9)}" if i % 11 else "@a", "ACGT" * (i % 13), ("@+I#" * (i % 13))) for i in range(3000)]


def fastq_text(plus=b"+", end=b"\n", last=True):
    text = b"".join(b"%s%s%s%s%s%s%s%s" % (n.encode(), end, b.encode(), end, plus if i % 2 else b"+", end, q.encode(), end) for i, (n, b, q) in enumerate(RECORDS))
    return text if last else text[: -len(end)]


@pytest.mark.parametrize("n", [1, 3, 50])
@pytest.mark.parametrize("variant", ["plain", "crlf", "named", "no_end"])
def test_fastq_partitions(spark, tmp_path, n, variant):
    path = tmp_path / "x.fastq"
    path.write_bytes({"plain": fastq_text(), "crlf": fastq_text(end=b"\r\n"), "named": fastq_text(b"+name"), "no_end": fastq_text(last=False)}[variant])
    df = fastq.read(spark, str(path), n)
    got = [(r["name"], r["bases"], r["quals"]) for r in df.orderBy("read_id").collect()]
    assert got == RECORDS
    assert df.rdd.getNumPartitions() <= max(n, 1)


def test_fastq_compressed_pairs_and_errors(spark, tmp_path):
    for name, pack in (("a.fastq.gz", gzip.compress), ("b.fastq.bz2", bz2.compress)):
        (tmp_path / name).write_bytes(pack(fastq_text()))
        assert fastq.read(spark, str(tmp_path / name)).count() == len(RECORDS)
    (tmp_path / "l.fastq").write_bytes(fastq_text())
    (tmp_path / "r.fastq").write_bytes(fastq_text(b"+longer"))
    pairs = fastq.read_pairs(spark, str(tmp_path / "l.fastq"), str(tmp_path / "r.fastq"), 7)
    got = pairs.orderBy("pair_id").collect()
    assert [r["pair_id"] for r in got] == list(range(len(RECORDS))) and all(r["left"] == r["right"] for r in got)
    (tmp_path / "s.fastq").write_bytes(b"@x\nACGT\n+\nIIII\n")
    with pytest.raises(fastq.FormatError):
        fastq.read_pairs(spark, str(tmp_path / "l.fastq"), str(tmp_path / "s.fastq"))
    (tmp_path / "bad.fasta").write_bytes(b">x\nACGT\n")
    (tmp_path / "bad.txt").write_bytes(b"hello\n")
    (tmp_path / "cut.fastq").write_bytes(b"@x\nACGT\n+\n")
    for name in ("bad.fasta", "bad.txt", "cut.fastq"):
        with pytest.raises(Exception, match="FASTA|neither|no bases"):
            fastq.read(spark, str(tmp_path / name)).count()
    (tmp_path / "none.fastq").write_bytes(b"")
    assert fastq.read(spark, str(tmp_path / "none.fastq")).count() == 0


def test_write_and_merge_keep_order(spark, tmp_path):
    path = tmp_path / "x.fastq"
    path.write_bytes(fastq_text())
    fastq.write(fastq.read(spark, str(path), 9).repartition(5), str(tmp_path / "parts"))
    assert merge(spark, str(tmp_path / "parts"), str(tmp_path / "one.fastq"), delete=True) >= 1
    assert (tmp_path / "one.fastq").read_bytes() == fastq_text() and not (tmp_path / "parts").exists()


def test_run_and_command_line(spark, tmp_path, capsys):
    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(1500))
    for name in ("a.fq", "b.fq"):
        with open(tmp_path / name, "w") as f:
            for i in range(800):
                at = rng.randrange(1400)
                b = list(genome[at : at + 100])
                if i % 3 == 0:
                    b[rng.randrange(20, 80)] = rng.choice("ACGT")
                f.write(f"@{name}{i}\n{''.join(b)}\n+\n{chr(rng.randrange(40, 74)) * 100}\n")
    (tmp_path / "c.properties").write_text("# settings\nALGORITHMS=all\nK=17\nconservative.MAX_ERRORS=3\nconsensus.trimming=false\n")
    assert cli.main(["correct", "-p", str(tmp_path / "a.fq"), str(tmp_path / "b.fq"), "-o", str(tmp_path), "-c", str(tmp_path / "c.properties"), "-m", "-sc", "1"]) == 0
    root = tmp_path / pipeline.ROOT
    lines = (root / "histo.kmer").read_text().splitlines()
    assert len(lines) == 256 and lines[0] == "0:0" and lines[1] == "1:0"
    assert len((root / "histo.qs").read_text().splitlines()) == 127
    from strandwise.operators import solid

    back = solid.read_csv(spark, str(root / "solidkmers.csv"), 17, 5)
    assert back.count() > 1000 and back.where("m < 5").count() == 0 and all(len(r["kmer"]) == 17 for r in back.limit(5).collect())
    assert pipeline.read_histogram(spark, str(root / "histo.kmer")).count() == 256
    made = [x for x in ("CONSERVATIVE", "CONSENSUS", "SCORED") if (tmp_path / f"a.fq.{x}").exists()]
    assert "CONSERVATIVE" in made and "SCORED" in made
    for x in made:
        names = (tmp_path / f"b.fq.{x}").read_text().splitlines()[::4]
        assert names == [f"@b.fq{i}" for i in range(800)]
    assert cli.main(["merge", "-i", str(root / "output1" / "SCORED"), "-o", str(tmp_path / "again.fq")]) == 0
    assert (tmp_path / "again.fq").read_bytes() == (tmp_path / "a.fq.SCORED").read_bytes()


def test_settings(tmp_path):
    assert config.load(k=1).k == 2 and config.load(k=99).k == 32 and config.load(algorithms=("ALL",)).algorithms == config.ALGORITHMS
    for bad in ({"algorithms": ("x",)}, {"kmer_threshold": 1}):
        with pytest.raises(ValueError):
            config.load(**bad)
    for text in ("nothing\n", "no_such=1\n", "scored.subst_base=N\n", "consensus.trimming=maybe\n", "scored.max_n_ratio=2\n"):
        (tmp_path / "x").write_text(text)
        with pytest.raises(ValueError):
            config.load(str(tmp_path / "x"))


def test_streaming_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(30)), "") for i in range(60)], "read_id long, bases string, quals string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    got = streaming.drain(streaming.count_stream(streaming.read_stream(spark, str(tmp_path / "in")), 4), "drained", str(tmp_path / "state"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spectrum.count_kmers(df, 4, 1).collect()))
