"""k-mer counting over a stream of reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandwise.operators import spectrum
from strandwise.operators.kernels import batch as kernel
from strandwise.operators.kernels.lookup import SPREAD

#: Parts that k-mers are dealt to, by the top bits of a product; k-mers counted at a time.
PART_BITS, MOST = 8, 1 << 22


def read_stream(spark: SparkSession, folder: str, schema: str = "read_id BIGINT, bases STRING, quals STRING", files_per_trigger: int = 1) -> DataFrame:
    """Reads from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def count_stream(reads: DataFrame, k: int, least: int = 1, n_as_a: bool = False) -> DataFrame:
    """The running counts of canonical k-mers; the keyed sums are the state, partial sums run before the shuffle.

    Every distinct k-mer stays in the state, and drain() brings all counts to the driver: for as many as fit there.
    """
    return spectrum.count_kmers(reads, k, least, n_as_a)


def drain(counts: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Process all that is there and return the final counts as a table."""
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.table(name)


def packed(values: np.ndarray) -> bytes:
    """Integers that are 0 or more as zstd of their byte planes, in as few bytes each as the largest needs."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << 8 * w)
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(pa.decompress(data[1:], size * width, codec="zstd", asbytes=True), np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    p, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(p, kind="stable")
    p, n = p[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.empty(0, np.int64)
    return p[first], np.add.reduceat(n, first) if len(p) else n


class Sums:
    """Sums of counts by key, merged whenever twice as many wait as were left by the last merge, MOST at least."""

    def __init__(self):
        self.keys, self.counts, self.size, self.next = [], [], 0, MOST

    def add(self, p: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(p)
        self.counts.append(n)
        self.size += len(p)
        if self.size >= self.next:
            p, n = summed(self.keys, self.counts)
            self.keys, self.counts, self.size, self.next = [p], [n], len(p), max(MOST, 2 * len(p))

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(self.keys, self.counts) if self.keys else (np.empty(0, np.uint64), np.empty(0, np.int64))


def blocks(reads: DataFrame, k: int, n_as_a: bool = False) -> DataFrame:
    """(part, size, kmers, counts): canonical k-mers counted within a task, some millions at a time, as gaps and counts of each part.

    No state is kept between batches of a stream: sums of blocks are the counts, in whatever batches they came.
    """

    def rows(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        p, n = summed(keys, counts)
        part = ((p * SPREAD) >> np.uint64(64 - PART_BITS)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        p, n, edges = p[order], n[order], np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << PART_BITS))]).tolist()
        cut = [(i, b - a, packed(np.diff(p[a:b], prepend=np.uint64(0))), packed(n[a:b])) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in cut], t) for i, t in enumerate(kinds)], ["part", "size", "kmers", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        for b in batches:
            part = kernel.partial_counts(b.column(0), k, n_as_a)
            keys.append(part.column(0).to_numpy().view(np.uint64))
            counts.append(part.column(1).to_numpy())
            size += part.num_rows
            if size >= MOST:
                yield rows(keys, counts)
                keys, counts, size = [], [], 0
        if size:
            yield rows(keys, counts)

    return reads.select("bases").mapInArrow(run, "part int, size long, kmers binary, counts binary")


def merged(dealt: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(kmer, cnt) of blocks(): each part is summed by one task, in which only the distinct k-mers of one part stay."""

    def rows(sums: Sums) -> Iterator[pa.RecordBatch]:
        p, n = sums.all()
        p, n = p[n >= least], n[n >= least]
        for i in range(0, len(p), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(p[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], ["p", "cnt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, Sums()
        for b in batches:
            for part, size, kmers, counts in zip(*(c.to_pylist() for c in b.columns)):
                if part != now:
                    yield from rows(sums)
                    now, sums = part, Sums()
                sums.add(np.cumsum(unpacked(kmers, size), dtype=np.uint64), unpacked(counts, size).astype(np.int64))
        yield from rows(sums)

    counts = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(run, "p long, cnt long")
    return counts.select(spectrum.letters("p", k).alias("kmer"), "cnt")


def drained_counts(reads: DataFrame, k: int, least: int, folder: str, n_as_a: bool = False) -> DataFrame:
    """(kmer, cnt) over all that is there of a stream; blocks are appended to files as batches come, each batch once."""
    query = blocks(reads, k, n_as_a).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/blocks")
    query.awaitTermination()
    schema = "part int, size long, kmers binary, counts binary"
    return merged(reads.sparkSession.read.schema(schema).parquet(f"{folder}/blocks"), k, least)
