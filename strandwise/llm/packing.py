"""Best-fit packing of documents into fixed-length sequences, planned on the histogram of lengths."""

from __future__ import annotations

import functools
import math
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import lean, remembers, stage, table

SEQUENCE = 2048
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """text -> ids as little-endian unsigned 32-bit bytes, as the tokenizers library gives them.

    The tokenizer splits at white space first, so a run of other characters always has the same ids.
    In texts of plain characters (ASCII, Latin-1 letters: those that the normaliser only lower-cases)
    the pieces of a run go to the library's model directly, and the ids of pieces and runs are
    remembered; other texts go through the library whole. That a vocabulary is of this kind is tried
    at the start, on PROBES and on every pair of plain characters; if any id differs, all its texts go
    through the library whole.
    """

    PROBES = ["It's we'll I'm they've you'd he'd we're 'tis rock'n'roll O'Neill's", "a1b22 3.14 10'000 x_y-z e.g. (a) [b] {c} #1 $2 50%", "Éàü ÑANDÚ straße ÀÉÎ öÖ x×y ÷", " lead  two\ttab\n\nlines \r\n end ", "supercalifragilisticexpialidocious ANTIDISESTABLISHMENT", "!!! ... --- ;;; a--b c,,d", ""]

    PLAIN = re.compile(r"[\n\r\t -~À-ÖØ-öø-ÿ]*")
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
    #: Byte-level vocabularies write a byte as the Latin-1 character, or, where that isn't printable, one from 256 on.
    SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}

    def __init__(self, path: str, most: int = 700_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.runs: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.direct = True
        plain = "".join(map(chr, [9, 10, 13, *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
        pairs = [" ".join(x + y for y in plain if "<|" != x + y) for x in plain]
        self.direct = all(a == self.whole(x) for probes in (self.PROBES, pairs) for x, a in zip(probes, self.batch(probes)))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, p: str) -> bytes:
        shown = p if p.isascii() else p.encode().decode("latin-1").translate(self.SHOWN)
        ids = array("I", [t.id for t in self.model.tokenize(shown)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def learn(self, runs: list[str]) -> None:
        """Remember the runs' ids."""
        split = list(map(self.PIECE.findall, runs))
        new = set().union(*split).difference(self.pieces)
        self.pieces.update((p, self.piece(p)) for p in new)
        known = self.pieces.__getitem__
        self.runs.update(zip(runs, [b"".join(map(known, ps)) for ps in split]))

    def batch(self, texts: list[str | None]) -> list[bytes]:
        for known in (self.runs, self.pieces):
            if len(known) > self.most:
                known.clear()
        plain = [self.direct and x is not None and "<|" not in x and self.PLAIN.fullmatch(x) is not None for x in texts]
        runs = [x.lower().split() if p else () for x, p in zip(texts, plain)]
        if new := set().union(*runs).difference(self.runs):
            self.learn(list(new))
        ids = self.runs.__getitem__
        return [b"".join(map(ids, rs)) if p else self.whole(x or "") for x, p, rs in zip(texts, plain, runs)]


@functools.cache
def encoder(path: str) -> Encoder:
    """The process's encoder; Python workers serve many tasks and keep what they have learned."""
    return Encoder(path)


remembers("packing", encoder.cache_clear)


def pieces(docs: DataFrame, length: int = SEQUENCE, path: str | None = None, keep_ids: bool = False, end: int = 0) -> DataFrame:
    """Every document's ids and the id `end`, cut into pieces of at most `length`.

    Returns the other columns of docs (but those that have one of these names), then piece, start, length, ids_crc32 and, with keep_ids, ids
    (little-endian unsigned 32-bit). Null text is empty: one piece, of the id `end` alone. Repeated rows
    are documents of their own; an empty table has no pieces.
    """
    path = path or vocabulary_path()
    others = [c for c in docs.columns if c not in ("text", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")]
    tail = np.array([end], "<u4").tobytes()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                place, piece, start, size, crc, ids = [], [], [], [], [], []
                for i, data in enumerate(own.batch(batch.column(len(others)).to_pylist())):
                    data += tail
                    for p, s in enumerate(range(0, len(data), 4 * length)):
                        part = data[s : s + 4 * length]
                        place.append(i)
                        piece.append(p)
                        start.append(s // 4)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        ids.append(part if keep_ids else None)
                kept = [batch.column(c).take(pa.array(place, pa.int32())) for c in range(len(others))]
                more = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())] + [pa.array(ids, pa.binary())] * keep_ids
                yield pa.RecordBatch.from_arrays(kept + more, [*others, "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    schema = f"{fields}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(*others, "text").mapInArrow(lean("packing", run), schema)


def plan(histogram: dict[int, int], length: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: rows (length, first rank, count, first sequence, offset).

    The items of a length with ranks first rank .. first rank + count - 1 go, one each, to the
    sequences first sequence, first sequence + 1, ... at that offset. Sequences that are filled alike
    are a group of consecutive numbers; a length's items go to the groups with the least room that
    suffices, of which only the last is split, and what is left opens new sequences. So the work
    depends on the number of different lengths and groups, not on the number of items.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    open_: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]  # by room left: (first sequence, count)
    free = 0
    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0

        def fill(first: int, count: int, room: int) -> int:
            """Put as many items as fit into each of the group's sequences, in turn; how many sequences got some."""
            nonlocal left, rank
            each, touched = room // size, 0
            for n, per in ((min(count, left // each), each), (1, left % each if left // each < count else 0)):
                if n and per:
                    for k in range(per):
                        rows.append((size, rank, n, first + touched, length - room + k * size))
                        rank += n
                    left -= n * per
                    open_[room - per * size].append((first + touched, n))
                    touched += n
            return touched

        for room in range(size, length):
            if not left:
                break
            groups, open_[room] = open_[room], []
            for first, count in groups:
                touched = fill(first, count, room) if left else 0
                if touched < count:
                    open_[room].append((first + touched, count - touched))
        free += fill(free, left, length) if left else 0
    return rows


def packed(cut: DataFrame, length: int = SEQUENCE, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to (staged) pieces.

    Only the histogram of lengths, at most `length` rows, and the plan made from it are on the driver.
    The plan, which is broadcast, has a row for each place of a length in a group of sequences filled
    alike: fewer than length squared, whatever the number of pieces, and in practice a few thousand.
    Ranks within a length: a prefix sum within hashed buckets plus one over the buckets, so that a
    length which a third of all pieces have is still spread.
    """
    spark = cut.sparkSession
    buckets = max(1, math.isqrt(cut.count()) // 4)
    cut = cut.withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    counts = stage(cut.groupBy("length", "_b").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram, length)
    by_length: dict[int, list] = {}
    for size, rank, _, first, offset in rows:
        by_length.setdefault(size, []).append((rank, first, offset))
    lookup = spark.sparkContext.broadcast({size: tuple(np.array(x, np.int64) for x in zip(*sorted(r))) for size, r in by_length.items()})
    before = F.sum("n").over(W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    bases = counts.select("length", "_b", F.coalesce(before, F.lit(0)).alias("_base"))
    ranked = cut.withColumn("_r", F.row_number().over(W.partitionBy("length", "_b").orderBy(*key)) - 1).join(bases, ["length", "_b"])
    ranked = ranked.select(*[c for c in cut.columns if c != "_b"], (F.col("_base") + F.col("_r")).alias("_rank"))
    at = ranked.columns.index("length")
    names = [c for c in ranked.columns if c != "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = batch.column(at).to_numpy(zero_copy_only=False), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                starts, firsts, offsets = lookup.value[int(size)]
                place = np.searchsorted(starts, ranks[own], "right") - 1
                sequence[own], offset[own] = firsts[place] + ranks[own] - starts[place], offsets[place]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(lean("packing", run), f"{fields}, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of documents.

    Null and empty texts are one piece, of the id 0 alone. Very long texts are cut, none is left out.
    Repeated rows and null doc_ids are documents of their own. An empty table gives no rows. Other
    columns aren't read.
    """
    cut = stage(pieces(table(spark, sf_dir, "documents").select("doc_id", "text")), "pieces")
    return packed(cut)
