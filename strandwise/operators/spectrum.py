"""k-mer windows, counts and histograms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions import kmers as fk

from .kernels import batch as kernel

QS_BINS, KMER_BINS, MIN_COUNT, MAX_COUNT = 127, 256, 2, 255


def raw_windows(reads: DataFrame, k: int, n_as_a: bool = False) -> DataFrame:
    """(read_id, pos, kmer): all k-length windows of normalised bases; reads shorter than k have none."""
    clean = reads.select("read_id", fk.normal("bases", n_as_a).alias("bases"))
    placed = clean.select("read_id", "bases", F.explode(fk.window_positions("bases", k)).alias("pos"))
    return placed.select("read_id", "pos", F.substr("bases", (F.col("pos") + 1).cast("int"), F.lit(k)).alias("kmer"))


def windows(reads: DataFrame, k: int, n_as_a: bool = False) -> DataFrame:
    """raw_windows without N (or with N as A), plus the canonical k-mer."""
    w = raw_windows(reads, k, n_as_a)
    w = w if n_as_a else w.where(F.instr("kmer", "N") == 0)
    return w.withColumn("canon", fk.canonical("kmer"))


def mates(pairs: DataFrame) -> DataFrame:
    """Both mates of every pair as reads."""
    left = pairs.select(F.col("pair_id").alias("read_id"), "left.bases", "left.quals")
    return left.unionByName(pairs.select(F.col("pair_id").alias("read_id"), "right.bases", "right.quals"))


def packed_counts(reads: DataFrame, k: int, n_as_a: bool = False) -> DataFrame:
    """(p, cnt): canonical k-mers packed into a BIGINT, right-aligned.

    Each Arrow batch is counted by itself, so that a k-mer of which a batch is full leaves it as one
    row; partial sums follow before the one shuffle, of 16 bytes a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield kernel.partial_counts(b.column(0), k, n_as_a)

    return reads.select("bases").mapInArrow(run, "p long, n long").groupBy("p").agg(F.sum("n").alias("cnt"))


def letters(p: Column | str, k: int) -> Column:
    """The k-mer of a right-aligned packed value."""
    return fk.unpack(p, k) if k < 32 else fk.unpack_left(p, k)


def count_kmers(reads: DataFrame, k: int, least: int = MIN_COUNT, n_as_a: bool = False) -> DataFrame:
    """(kmer, cnt) of canonical k-mers seen at least `least` times; letters are made for these only."""
    counts = packed_counts(reads, k, n_as_a)
    counts = counts.where(F.col("cnt") >= least) if least > 1 else counts
    return counts.select(letters("p", k).alias("kmer"), "cnt")


def saturated(counts: DataFrame, most: int = MAX_COUNT) -> DataFrame:
    return counts.withColumn("cnt", F.least("cnt", F.lit(most).cast("bigint")))


def dense(histogram: DataFrame, bins: int) -> DataFrame:
    """All bins 0 .. bins - 1 of (bin, n), 0 where there is none. At most `bins` rows on either side."""
    every = histogram.sparkSession.range(0, bins, 1, 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(histogram, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def kmer_histogram(counts: DataFrame, bins: int = KMER_BINS) -> DataFrame:
    """Number of distinct k-mers by multiplicity, the last bin for that and more."""
    h = counts.groupBy(F.least("cnt", F.lit(bins - 1).cast("bigint")).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return dense(h, bins)


def qs_histogram(reads: DataFrame, bins: int = QS_BINS) -> DataFrame:
    """Number of quality characters by code, of all characters whatever the bases' length."""
    q = reads.where(F.length("quals") > 0).select(F.explode(F.split("quals", "")).alias("q"))
    h = q.where("q <> ''").groupBy("q").agg(F.count("*").alias("n")).select(F.ascii("q").alias("bin"), "n")
    return dense(h, bins)


def totals(histogram: DataFrame, threshold: int) -> DataFrame:
    """counted: the sum of all bins; solid: from the threshold on."""
    return histogram.agg(F.sum("n").cast("bigint").alias("counted"), F.coalesce(F.sum(F.when(F.col("bin") >= threshold, F.col("n"))), F.lit(0)).cast("bigint").alias("solid"))
