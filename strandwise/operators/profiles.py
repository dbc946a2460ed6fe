"""What a solid k-mer set says of every read, one row a read: multiplicities, islands, votes and fixes.

A solid set of at most `most_bytes` (9 bytes a k-mer, counted first) goes to the executors as sorted
arrays, and every read is judged where it lies: no shuffle. A larger set meets the windows in joins,
whose skewed keys Spark's adaptive execution splits. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import correction, regions, solid as solids, votes as ballots
from .kernels import batch as kernel
from .kernels.lookup import SolidSet

MOST_BYTES = 512 << 20


def by_size(solid: DataFrame, k: int, most_bytes: int, arrays: Callable[[SolidSet], DataFrame], join: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """arrays(the set) if the set is small enough for a broadcast, else join(its table)."""
    kept = solid.persist(StorageLevel.MEMORY_AND_DISK)
    if kept.count() * 9 > most_bytes:
        return join(kept)
    own = correction.solid_set(kept, k, most_bytes)
    kept.unpersist()
    return arrays(own)


def _rows(reads: DataFrame, solid: SolidSet, kind, schema: str) -> DataFrame:
    """Rows (read_id, ...) of a kernel that yields arrays, the first of which says which read of the batch."""
    shared = reads.sparkSession.sparkContext.broadcast(solid)
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int32() if x.endswith("int") else pa.int64() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for read, *columns in kind(batch.column(1), shared.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(read)), *(pa.array(c).cast(t) for c, t in zip(columns, types[1:]))], names)

    return reads.select(F.col("read_id").cast("long").alias("read_id"), "bases").mapInArrow(run, schema)


def profile(reads: DataFrame, solid: DataFrame, k: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(read_id, n, m, isles) for every read: its bases, the multiplicity of each window (0: not solid), and the runs (l, r) of solid windows."""

    def arrays(own: SolidSet) -> DataFrame:
        shared = reads.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), *kernel.profile(batch.column(1), shared.value)], ["read_id", "n", "m", "isles"])

        return reads.select(F.col("read_id").cast("long").alias("read_id"), "bases").mapInArrow(run, "read_id long, n long, m array<int>, isles array<struct<l:long,r:long>>")

    def join(table: DataFrame) -> DataFrame:
        met = solids.multiplicity(reads, table, k).groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_w"))
        sized = reads.select(F.col("read_id").cast("long").alias("read_id"), F.coalesce(F.length("bases"), F.lit(0)).cast("long").alias("n")).join(met, "read_id", "left")
        m = F.coalesce(F.transform("_w", lambda w: w["m"]), F.array().cast("array<int>"))
        edge = lambda step: F.filter(F.transform("_m", lambda x, i: F.when((x > 0) & (F.coalesce(F.get("_m", i + step), F.lit(0)) == 0), i.cast("long"))), lambda i: i.isNotNull())
        out = sized.select("read_id", "n", m.alias("_m")).select("read_id", "n", "_m", edge(-1).alias("_l"), edge(1).alias("_r"))
        return out.select("read_id", "n", F.col("_m").alias("m"), F.zip_with("_l", "_r", lambda a, b: F.struct(a.alias("l"), b.alias("r"))).alias("isles"))

    return by_size(solid, k, most_bytes, arrays, join)


def mutations(reads: DataFrame, solid: DataFrame, k: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(read_id, pos, o, b, m): other bases at offset o of a weak window that make it solid."""
    return by_size(
        solid, k, most_bytes, lambda own: _rows(reads, own, kernel.mutations, "read_id long, pos long, o int, b string, m int"), lambda table: ballots.mutations(solids.weak_windows(reads, table, k), table, k)
    )


BALLOTS = "array<struct<pos:long,b:string,votes:long>>"


WON = "array<struct<pos:long,b:string>>"


def votes(reads: DataFrame, solid: DataFrame, k: int, most_bytes: int = MOST_BYTES, least: int = ballots.MIN_VOTES) -> DataFrame:
    """(read_id, bases, votes, won) for every read.

    votes: by position and base, how many windows would be solid with that base there. won: (pos, b)
    of positions where exactly one base has the read's most votes, at least `least`.
    """

    def arrays(own: SolidSet) -> DataFrame:
        shared = reads.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *kernel.vote_lists(batch.column(1), shared.value, least)], ["read_id", "bases", "votes", "won"])

        return reads.select(F.col("read_id").cast("long").alias("read_id"), "bases").mapInArrow(run, f"read_id long, bases string, votes {BALLOTS}, won {WON}")

    def join(table: DataFrame) -> DataFrame:
        flat = ballots.votes(ballots.mutations(solids.weak_windows(reads, table, k), table, k))
        each = flat.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("pos", "b", "votes"))).alias("votes"))
        best = ballots.winners(flat, least).groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("pos", "b"))).alias("won"))
        both = reads.select("read_id", "bases").join(each.join(best, "read_id", "left"), "read_id", "left")
        return both.withColumns({"votes": F.coalesce("votes", F.array().cast(BALLOTS)), "won": F.coalesce("won", F.array().cast(WON))})

    return by_size(solid, k, most_bytes, arrays, join)


def unique_fixes(reads: DataFrame, solid: DataFrame, k: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(read_id, pos, b): the first base under no solid window whose two end windows share exactly one solid change, in reads of 2k - 1 and more."""

    def join(table: DataFrame) -> DataFrame:
        isles = regions.islands(solids.solid_windows(reads, table, k))
        under = isles.select("read_id", F.explode(F.sequence("l", F.col("r") + k - 1)).alias("pos")).distinct()
        return ballots.unique_fixes(reads, under, ballots.mutations(solids.weak_windows(reads, table, k), table, k), k)

    return by_size(solid, k, most_bytes, lambda own: _rows(reads, own, kernel.unique_fixes, "read_id long, pos long, b string"), join)


# --- what follows from the islands of a read, as expressions over profile()'s columns


def longest(isles: Column | str = "isles") -> Column:
    """The first of the longest islands (l, r); null without any."""
    best = F.array_max(F.transform(isles, lambda x: F.struct((x["r"] - x["l"]).alias("size"), (-x["l"]).alias("at"))))
    return F.when(best.isNotNull(), F.struct((-best["at"]).alias("l"), (best["size"] - best["at"]).alias("r")))


def covered(k: int, isles: str = "isles") -> Column:
    """Bases under at least one solid window."""

    def own(x, i):
        before = F.get(F.col(isles), i - 1)["r"] + k
        return x["r"] + k - F.greatest(x["l"], F.coalesce(before, x["l"]))

    return F.aggregate(F.transform(isles, own), F.lit(0).cast("long"), lambda a, x: a + x)


def gaps(isles: str = "isles") -> Column:
    """(l, gap) of every island but the first: window positions between it and the one before."""
    each = F.transform(isles, lambda x, i: F.struct(x["l"].alias("l"), (x["l"] - F.get(F.col(isles), i - 1)["r"] - 1).alias("gap")))
    return F.filter(each, lambda x: x["gap"].isNotNull())


# --- what follows from the votes on a read, as expressions over votes()'s columns


def most_votes(each: Column | str = "votes") -> Column:
    return F.array_max(F.transform(each, lambda x: x["votes"]))


def applied(fixes: Column | str, bases: str = "bases") -> Column:
    """The bases with all fixes (pos, b) applied."""
    return F.aggregate(fixes, F.col(bases), lambda s, f: F.overlay(s, f["b"], (f["pos"] + 1).cast("int"), F.lit(1)))
