"""A whole correction run: scan, histograms, cutoffs, solid set, correction, ordered output."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.config import Settings
from strandwise.operators import correction, solid, spectrum, thresholds
from strandwise.sources import fastq
from strandwise.sources.merge import merge

ROOT = "strandwise-output"


class Timers(dict):
    @contextmanager
    def phase(self, name: str):
        start = time.perf_counter()
        try:
            yield
        finally:
            self[name] = self.get(name, 0.0) + time.perf_counter() - start


def _bins(h: DataFrame) -> list[int]:
    return [r["n"] for r in h.orderBy("bin").collect()]


def choose(settings: Settings, kmer_hist: list[int], qs_hist: list[int] | None, reads: DataFrame) -> tuple[dict, dict[str, str]]:
    """({algorithm: (threshold, offset, cutoffs)} by ascending threshold, {disabled algorithm: why})."""
    chosen, disabled = {}, {}
    for name in settings.algorithms:
        try:
            offset, cuts = 33, (0, 0)
            if name == "consensus":
                offset = thresholds.quality_offset(qs_hist)
                cuts = thresholds.quality_cutoffs(qs_hist, offset, settings.consensus.qs_cutoff_ratio, settings.consensus.qs_extreme_ratio)
            elif name == "scored":
                offset = thresholds.scanned_offset(reads).first()["qs_offset"]
            cut = {
                "conservative": thresholds.conservative_cutoff, "consensus": lambda h: thresholds.consensus_cutoff(h, settings.consensus.max_kmer_threshold),
                "scored": lambda h: thresholds.scored_cutoff(h, settings.scored.max_kmer_threshold),
            }[name]
            chosen[name] = (settings.kmer_threshold or cut(kmer_hist), offset, cuts)
        except thresholds.NoCutoff as why:
            disabled[name] = str(why)
    if not chosen:
        raise thresholds.NoCutoff("; ".join(f"{k}: {v}" for k, v in disabled.items()))
    return dict(sorted(chosen.items(), key=lambda x: x[1][0])), disabled


def correct_reads(reads: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """{algorithm: corrected reads} for a table of reads; every algorithm starts from the reads as they are."""
    n_as_a = settings.algorithms == ("conservative",)
    counts = spectrum.count_kmers(reads, settings.k, settings.kmer_threshold or spectrum.MIN_COUNT, n_as_a)
    kmer_hist = _bins(spectrum.kmer_histogram(counts))
    qs_hist = _bins(spectrum.qs_histogram(reads)) if "consensus" in settings.algorithms else None
    chosen, _ = choose(settings, kmer_hist, qs_hist, reads)
    out = {}
    for name, (threshold, offset, cuts) in chosen.items():
        own = correction.solid_set(solid.solid_kmers(counts, threshold), settings.k, settings.max_solid_bytes)
        out[name] = correction.correct(reads, correction.corrector(name, own, threshold, settings, offset, cuts))
    return out


def run(spark: SparkSession, inputs: list[str], output: str, settings: Settings, merged: str | None = None) -> dict:
    """Correct one FASTQ file, or two of mates; returns what was chosen, counted and how long phases took.

    Writes <output>/strandwise-output/: histo.qs, histo.kmer, solidkmers.csv and output1/<ALGORITHM>
    (output2 for the second file), replacing what is there, compressed as the input is unless the
    settings say how ("none": not); with `merged`, also <merged>/<file>.<ALGORITHM>.
    """
    timers, base = Timers(), f"{output.rstrip('/')}/{ROOT}"
    with timers.phase("scan"):
        files = [fastq.read(spark, p, settings.partitions).persist() for p in inputs]
        if len(files) == 2:
            fastq.check_mates(*inputs, *(f.count() for f in files))
        reads = files[0] if len(files) == 1 else files[0].unionByName(files[1])
    n_as_a = settings.algorithms == ("conservative",)
    qs_hist = None
    if "consensus" in settings.algorithms:
        with timers.phase("quality histogram"):
            qs = spectrum.qs_histogram(reads).persist()
            qs_hist = _bins(qs)
            write_histogram(qs, f"{base}/histo.qs")
    with timers.phase("k-mer counting"):
        counts = spectrum.count_kmers(reads, settings.k, settings.kmer_threshold or spectrum.MIN_COUNT, n_as_a).persist()
        hist = spectrum.kmer_histogram(counts).persist()
        kmer_hist = _bins(hist)
        write_histogram(hist, f"{base}/histo.kmer")
    with timers.phase("analysis"):
        chosen, disabled = choose(settings, kmer_hist, qs_hist, files[0])
    lowest = min(t for t, _, _ in chosen.values())
    with timers.phase("solid k-mers"):
        trusted = solid.solid_kmers(counts, lowest)
        _text(spark, solid.csv_lines(trusted), f"{base}/solidkmers.csv")
    report = {"algorithms": {}, "disabled": disabled, "counted": sum(kmer_hist)}
    for name, (threshold, offset, cuts) in chosen.items():
        with timers.phase("load solid k-mers"):
            kernel = correction.corrector(name, correction.solid_set(solid.refiltered(trusted, threshold), settings.k, settings.max_solid_bytes), threshold, settings, offset, cuts)
        for i, (path, part) in enumerate(zip(inputs, files), 1):
            target, compression, held = f"{base}/output{i}/{name.upper()}", settings.compression or fastq.codec_name(path), []
            with timers.phase("correction"):
                fastq.write(correction.correct(part, kernel, held), target, settings.keep_order, compression)
            for broadcast in held:
                broadcast.unpersist()
            if merged:
                with timers.phase("merge"):
                    ending = {"gzip": ".gz", "bzip2": ".bz2"}.get(compression, "")
                    merge(spark, target, f"{merged.rstrip('/')}/{path.rstrip('/').rsplit('/', 1)[-1]}.{name.upper()}{ending}")
        report["algorithms"][name] = {"threshold": threshold, "qs_offset": offset, "qs_cutoffs": cuts, "solid": sum(kmer_hist[threshold:])}
    for cached in (*files, counts, hist):
        cached.unpersist()
    return report | {"seconds": dict(timers)}


def _text(spark: SparkSession, lines: DataFrame, target: str) -> None:
    lines.write.mode("overwrite").text(f"{target}.parts")
    merge(spark, f"{target}.parts", target, delete=True)


def write_histogram(histogram: DataFrame, target: str) -> None:
    """bin:count lines of a histogram, in order of the bins."""
    rows = histogram.orderBy("bin").select(F.concat_ws(":", "bin", "n").alias("value")).coalesce(1)
    _text(histogram.sparkSession, rows, target)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", ":").schema("bin INT, n BIGINT").csv(path)
