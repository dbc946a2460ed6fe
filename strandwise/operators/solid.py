"""The solid (trusted) k-mer set: filtering, text form, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import kmers as fk

from .spectrum import MAX_COUNT, raw_windows


def solid_kmers(counts: DataFrame, threshold: int, most: int = MAX_COUNT) -> DataFrame:
    """(kmer, m): counts from the threshold on, saturated."""
    return counts.where(F.col("cnt") >= threshold).select("kmer", F.least("cnt", F.lit(most)).cast("int").alias("m"))


def csv_lines(solid: DataFrame) -> DataFrame:
    """'packed,count' lines, packed as a signed left-aligned decimal."""
    return solid.select(F.concat_ws(",", fk.pack_left("kmer").cast("string"), F.col("m").cast("string")).alias("value"))


def count_lines(counts: DataFrame) -> DataFrame:
    """'packed,count' lines of all counted k-mers, the counts whole."""
    return counts.select(F.concat_ws(",", fk.pack_left("kmer").cast("string"), F.col("cnt").cast("string")).alias("value"))


def read_counts(spark: SparkSession, path: str, k: int) -> DataFrame:
    rows = spark.read.schema("packed BIGINT, cnt BIGINT").csv(path)
    return rows.select(fk.unpack_left("packed", k).alias("kmer"), "cnt")


def read_csv(spark: SparkSession, path: str, k: int, threshold: int = 0) -> DataFrame:
    """The solid set from such lines, k-mers of at least `threshold`."""
    rows = spark.read.schema("packed BIGINT, m INT").csv(path)
    return rows.where(F.col("m") >= threshold).select(fk.unpack_left("packed", k).alias("kmer"), "m")


def refiltered(solid: DataFrame, threshold: int) -> DataFrame:
    return solid.where(F.col("m") >= threshold)


def multiplicity(reads: DataFrame, solid: DataFrame, k: int, n_as_a: bool = True) -> DataFrame:
    """(read_id, pos, kmer, m) of every window, m = 0 where neither strand is solid: one look-up of the canonical form.

    A left join on the canonical k-mer: Spark broadcasts the solid set while it is below its size
    threshold and sorts and merges beyond it.
    """
    w = raw_windows(reads, k, n_as_a).withColumn("canon", fk.canonical("kmer"))
    return w.join(solid.withColumnRenamed("kmer", "canon"), "canon", "left").select("read_id", "pos", "kmer", F.coalesce("m", F.lit(0)).alias("m"))


def weak_windows(reads: DataFrame, solid: DataFrame, k: int) -> DataFrame:
    w = raw_windows(reads, k, True).withColumn("canon", fk.canonical("kmer"))
    return w.join(solid.select(F.col("kmer").alias("canon")), "canon", "left_anti").select("read_id", "pos", "kmer")


def solid_windows(reads: DataFrame, solid: DataFrame, k: int) -> DataFrame:
    w = raw_windows(reads, k, True).withColumn("canon", fk.canonical("kmer"))
    return w.join(solid.select(F.col("kmer").alias("canon")), "canon", "left_semi").select("read_id", "pos", "kmer")
