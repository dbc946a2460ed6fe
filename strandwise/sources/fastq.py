"""FASTQ as a Spark data source, single reads and pairs, and as a text sink."""

from __future__ import annotations

import bz2
import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strandwise.functions import kmers as fk

READ = "read_id bigint, name string, bases string, quals string"
CHUNK, ROWS, SMALLEST = 8 << 20, 20_000, 1 << 20
CODECS = {".gz": gzip.open, ".bz2": bz2.open}


class FormatError(ValueError):
    """The input isn't FASTQ."""


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pa.fs.LocalFileSystem(), path


def files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, or of the files in the folder, by name; those that begin with _ or . don't count."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pa.fs.FileType.File:
        return [(path, info.size)]
    found = sorted((f for f in fs.get_file_info(pa.fs.FileSelector(at)) if f.is_file and f.base_name[0] not in "_."), key=lambda f: f.path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    return [(head + f.path, f.size) for f in found]


def codec(path: str):
    return next((f for end, f in CODECS.items() if path.endswith(end)), None)


def codec_name(path: str) -> str | None:
    """'gzip' or 'bzip2' by the ending of the file's name (of a folder, its first file's), as text writers call it."""
    found = files(path)
    return next((name for end, name in ((".gz", "gzip"), (".bz2", "bzip2")) if found and found[0][0].endswith(end)), None)


def first_record(path: str) -> int:
    """Bytes of the first record, line ends included: what one read takes; 0 for an empty file."""
    where = files(path)[0][0]
    fs, at = opened(where)
    unpack = codec(where)
    with fs.open_input_stream(at, compression=None) as raw:
        stream = unpack(raw) if unpack else raw
        row = next(records(stream, 0, None, where), None)
    return sum(len(x) for x in row[1:]) + 5 if row else 0


def sniff(path: str) -> str:
    """'fastq' or 'fasta' by the first byte of the file; compressed ones are read that far too."""
    fs, at = opened(path)
    with fs.open_input_stream(at, compression=None) as raw:
        stream = codec(path)(raw) if codec(path) else raw
        first = stream.read(1)
    if first == b">":
        return "fasta"
    if first in (b"@", b""):
        return "fastq"
    raise FormatError(f"{path} begins with {first!r}, neither @ nor >")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def numbered_lines(stream, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) from a stream that stands at offset `at`."""
    rest = b""
    while chunk := stream.read(CHUNK):
        lines = (rest + chunk).split(b"\n")
        rest = lines.pop()
        for line in lines:
            yield at, line
            at += len(line) + 1
    if rest:
        yield at, rest


def records(stream, start: int, end: int | None, name: str) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Records that begin at offsets start <= o < end; the stream stands at max(0, start - 1).

    From the middle of a file the first record is found as a line that begins with @, whose next but
    one begins with + and whose next is as long as the fourth. A quality line may begin with @, but
    then the next but one is a line of bases.
    """
    lines = numbered_lines(stream, max(0, start - 1))
    window: list[tuple[int, bytes]] = []
    if start > 0:
        next(lines, None)  # what is left of the line before, or its end alone
        for item in lines:
            window.append(item)
            if len(window) == 4:
                (_, a), (_, b), (_, c), (_, d) = window
                if a[:1] == b"@" and c[:1] == b"+" and len(b.rstrip(b"\r")) == len(d.rstrip(b"\r")):
                    break
                window.pop(0)
        else:
            return
    while True:
        while len(window) < 4:
            item = next(lines, None)
            if item is None:
                if any(x[1].strip() for x in window):
                    raise FormatError(f"{name}: a record at offset {window[0][0]} has no bases or no qualities")
                return
            if window or item[1].strip():
                window.append(item)
        at, head = window[0]
        if end is not None and at >= end:
            return
        bases, plus, quals = (x[1].rstrip(b"\r") for x in window[1:])
        if head[:1] != b"@" or plus[:1] != b"+" or len(bases) != len(quals):
            raise FormatError(f"{name}: no record at offset {at}")
        yield at, head.rstrip(b"\r"), bases, quals
        window = []


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("fastq: no path")
        self.wanted = int(options.get("numpartitions", options.get("numPartitions", 0)) or 0)
        self.split = int(options.get("splitbytes", options.get("splitBytes", 0)) or 128 << 20)

    def partitions(self) -> list[Range]:
        found = files(self.path)
        out = []
        for path, size in found:
            if sniff(path) == "fasta":
                raise FormatError(f"{path} is FASTA; only FASTQ has qualities")
            n = 1 if codec(path) else max(1, min(-(-size // SMALLEST) if not self.wanted else size or 1, self.wanted or -(-size // self.split)))
            step = -(-size // n) or 1
            out += [Range(path, s, min(size, s + step)) for s in range(0, size, step)] if n > 1 else [Range(path, 0, -1)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, at = opened(partition.path)
        unpack = codec(partition.path)
        if unpack:
            stream = unpack(fs.open_input_stream(at, compression=None))
        else:
            stream = fs.open_input_file(at)
            stream.seek(max(0, partition.start - 1))
        with stream:
            rows = records(stream, partition.start, None if partition.end < 0 else partition.end, partition.path)
            columns: tuple[list, ...] = ([], [], [], [])
            for row in rows:
                for c, x in zip(columns, row):
                    c.append(x)
                if len(columns[0]) == ROWS:
                    yield batch(columns)
                    columns = ([], [], [], [])
            if columns[0]:
                yield batch(columns)


def batch(columns) -> pa.RecordBatch:
    ids, *texts = columns
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.binary()).cast(pa.string()) for x in texts)], ["read_id", "name", "bases", "quals"])


class FastqSource(DataSource):
    """read_id (offset of the record), name (its whole first line), bases, quals.

    Options: numPartitions, splitBytes. A plain file is read in byte ranges, a .gz or .bz2 file by one
    task. Names of any length, '+name' separators, CRLF and a last line without end are accepted.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> FastqReader:
        return FastqReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def read(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("fastq")
    return (reader.option("numPartitions", partitions) if partitions else reader).load(path)


def ordinals(reads: DataFrame) -> DataFrame:
    """reads plus ordinal, their number in partition order; only one count per partition is on the driver.

    For reads as read() gives them, whose partitions are byte ranges and the same in every job. Where
    rows were dealt by ranges drawn at run time, operators.order.numbered() counts them.
    """
    tagged = reads.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    sizes = {r["_p"]: r["n"] for r in tagged.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return reads.withColumn("ordinal", F.lit(0).cast("bigint"))
    starts, total = [0] * (max(sizes) + 1), 0
    for p in range(len(starts)):
        starts[p], total = total, total + sizes.get(p, 0)
    base = F.get(F.array(*(F.lit(x).cast("bigint") for x in starts)), F.col("_p"))
    return tagged.withColumn("ordinal", base + (F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33))).drop("_p", "_m")


def check_mates(left: str, right: str, n: int, m: int) -> None:
    """FormatError unless both files are compressed or neither, and hold n = m records."""
    if bool(codec_name(left)) != bool(codec_name(right)):
        raise FormatError("either both files are compressed or neither")
    if n != m:
        raise FormatError(f"{left} has {n} records, {right} {m}")


def read_pairs(spark: SparkSession, left: str, right: str, partitions: int | None = None) -> DataFrame:
    """pair_id, left, right: record i of one file with record i of the other; both need as many records."""
    a, b = (ordinals(read(spark, p, partitions)).select("ordinal", F.struct("name", "bases", "quals").alias(s), F.col("read_id").alias(f"at_{s}")) for p, s in ((left, "left"), (right, "right")))
    check_mates(left, right, a.count(), b.count())
    return a.join(b, "ordinal").select(F.col("ordinal").alias("pair_id"), "left", "right")


def write(reads: DataFrame, path: str, keep_order: bool = True, compression: str | None = None, key: str = "read_id") -> None:
    """Four-line records as text parts; with keep_order the parts, by name, hold the reads by ascending key, else only ranges of it."""
    ranges = reads.repartitionByRange(key)
    ordered = ranges.sortWithinPartitions(key) if keep_order else ranges
    text = ordered.select(fk.fastq_text("name", "bases", "quals").alias("value"))
    text.write.mode("overwrite").option("compression", compression or "none").text(path)
