import bz2
import gzip

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandwise.config import Conservative, Settings
from strandwise.functions import kmers as fk
from strandwise.operators import correction
from strandwise.operators.kernels.conservative import Corrector
from strandwise.operators.kernels.lookup import SolidSet
from strandwise.plans import pipeline
from strandwise.session import SETTINGS, configured
from strandwise.sources import fastq


def test_an_algorithm_of_ones_own(spark):
    with pytest.raises(ValueError):
        correction.corrector("strict", None, 1, Settings())
    with pytest.raises(TypeError):
        correction.Algorithm()
    own = SolidSet(np.array([0], np.uint64), np.array([9], np.uint8), 4)
    correction.algorithm("Strict")(lambda solid, threshold, settings, offset, cutoffs: Corrector(solid, threshold, Conservative(max_errors=1)))
    try:
        kernel, held = correction.corrector("STRICT", own, 1, Settings()), []
        assert isinstance(kernel, correction.Algorithm) and kernel.config.max_errors == 1
        reads = spark.createDataFrame([(1, "AAAAAAAAA", "I" * 9), (2, None, None), (3, "", ""), (4, "AAAACAAAA", "I" * 9)], "read_id long, bases string, quals string")
        got = [tuple(r) for r in correction.correct(reads, kernel, held).select("read_id", "bases", "n_corrections", "status").orderBy("read_id").collect()]
        assert got == [(1, "AAAAAAAAA", 0, "clean"), (2, "", 0, "short"), (3, "", 0, "short"), (4, "AAAAAAAAA", 1, "corrected")] and len(held) == 1
    finally:
        del correction.REGISTRY["strict"]
    assert set(correction.REGISTRY) == {"conservative", "consensus", "scored"}


def test_session_settings():
    class Builder(dict):
        def config(self, key, value):
            self[key] = value
            return self

    made = configured(Builder())
    assert made.items() <= SETTINGS.items() and "spark.serializer" in made


def test_input_codec_is_used_again(spark, tmp_path):
    reads = "".join(f"@r{i}\n{'ACGTTGCAAC' * 4}\n+\n{'I' * 40}\n" for i in range(50)).encode()
    for name, pack, kind in (("x.fq.gz", gzip.compress, "gzip"), ("y.fq.bz2", bz2.compress, "bzip2"), ("z.fq", bytes, None)):
        path = tmp_path / name
        path.write_bytes(pack(reads))
        assert fastq.codec_name(str(path)) == kind and fastq.first_record(str(path)) == len(b"@r0\n") + 41 + 2 + 41
        pipeline.run(spark, [str(path)], str(tmp_path), Settings(k=9, kmer_threshold=2), str(tmp_path))
        merged = next(tmp_path.glob(f"{name}.CONSERVATIVE*"))
        back = fastq.read(spark, str(merged)).orderBy("read_id").select("name", "bases").collect()
        assert [tuple(r) for r in back] == [(f"@r{i}", "ACGTTGCAAC" * 4) for i in range(50)]
    (tmp_path / "none.fq").write_bytes(b"")
    assert fastq.first_record(str(tmp_path / "none.fq")) == 0
    with pytest.raises(fastq.FormatError):
        fastq.check_mates(str(tmp_path / "x.fq.gz"), str(tmp_path / "z.fq"), 1, 1)


def test_hashes_and_helpers(spark):
    def mixed(x):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * factor % 2**64
        return x ^ x >> 33

    values = [0, 1, -1, 2**63 - 1, -(2**63), 123456789, -987654321012345]
    d = spark.createDataFrame([(v,) for v in values], "v long")
    signed = lambda x, bits: x - 2**bits if x >= 2 ** (bits - 1) else x
    for r in d.select("v", fk.mixed("v").alias("m"), fk.folded("v").alias("f")).collect():
        u = r["v"] % 2**64
        assert r["m"] == signed(mixed(u), 64) and r["f"] == signed((u ^ u >> 32) % 2**32, 32)
    assert fk.register(spark) == list(fk.HELPERS)
    assert tuple(spark.sql("SELECT kmer_revcomp('ACCT'), kmer_canonical('TTTT'), kmer_pack('ACGT'), phred_error('+')").first()) == ("AGGT", "AAAA", 27, 0.1)
    n = spark.createDataFrame([(0, 3), (1, 3), (3, 3), (4, 3)], "a long, b long")
    assert [r[0] for r in n.select(fk.ceil_div("a", "b")).collect()] == [0, 1, 1, 2]
    assert n.select(fk.mebibytes(F.lit(3 << 20))).first()[0] == 3.0
