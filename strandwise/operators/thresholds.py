"""Solidity and quality cutoffs from histograms: as windows over the bins, and in Python over a list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bins of fewer k-mers than this aren't taken for the valley.
PLATEAU = 100


class NoCutoff(ValueError):
    """The histogram doesn't let this algorithm run."""


def kmer_cutoffs(h: DataFrame, most: int = 255) -> DataFrame:
    """(hid, conservative, consensus, scored) from dense histograms (hid, bin, n); at most 256 rows per hid.

    consensus: the bin before the first rise from bin 3 to 254, else null. scored: the same from bin 3
    on, else 2. conservative: the deepest bin between the first rise and the peak.
    """
    g = h.where("bin >= 2").withColumn("pn", F.lag("n").over(W.partitionBy("hid").orderBy("bin")))
    last = g.groupBy("hid").agg(F.coalesce(F.max(F.when((F.col("bin") >= 3) & (F.col("n") != 0), F.col("bin"))), F.lit(2)).alias("last"))
    g = g.join(last, "hid")
    rise = g.groupBy("hid", "last").agg(F.min(F.when((F.col("bin") >= 3) & (F.col("bin") < F.col("last")) & (F.col("n") > F.col("pn")), F.col("bin"))).alias("v"))
    rise = rise.select("hid", F.coalesce("v", F.greatest("last", F.lit(3))).alias("v"))
    g = g.join(rise, "hid")
    inside = (F.col("bin") == F.col("v")) | ((F.col("bin") > F.col("v")) & (F.col("bin") < F.col("last")))
    peak = g.where(inside).groupBy("hid").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("p"))
    valley = (F.col("bin") == F.col("v")) | ((F.col("bin") > F.col("v")) & (F.col("bin") < F.col("p")) & (F.col("n") >= PLATEAU))
    t1 = g.join(peak, "hid").where(valley).groupBy("hid").agg(F.min_by("bin", F.struct("n", "bin")).alias("conservative"))
    up = F.col("n") > F.col("pn")
    t23 = g.groupBy("hid").agg((F.min(F.when(F.col("bin").between(3, 254) & up, F.col("bin"))) - 1).alias("consensus"), F.coalesce(F.min(F.when((F.col("bin") >= 3) & up, F.col("bin"))) - 1, F.lit(2)).alias("scored"))
    return t1.join(t23, "hid").select("hid", "conservative", F.when(F.col("consensus").isNotNull(), F.least("consensus", F.lit(most))).alias("consensus"), F.least("scored", F.lit(most)).alias("scored"))


def conservative_cutoff(h: list[int]) -> int:
    last = max((i for i in range(3, len(h)) if h[i]), default=2)
    valley = next((i for i in range(3, last) if h[i] > h[i - 1]), max(last, 3))
    inside = range(valley, max(last, valley + 1))
    peak = max(inside, key=lambda i: (h[i] if i < len(h) else 0, -i))
    best = valley
    for i in range(valley + 1, peak):
        if h[i] >= PLATEAU and h[i] < h[best]:
            best = i
    return best


def consensus_cutoff(h: list[int], most: int = 255) -> int:
    rise = next((i for i in range(3, 255) if h[i] > h[i - 1]), None)
    if rise is None:
        raise NoCutoff("the multiplicity histogram never rises")
    return min(rise - 1, most)


def scored_cutoff(h: list[int], most: int = 255) -> int:
    return min(next((i - 1 for i in range(3, 256) if h[i] > h[i - 1]), 2), most)


def quality_offset(h: list[int]) -> int:
    """33 or 64 from the smallest and largest quality code that occurs; NoCutoff where they contradict each other."""
    used = [i for i, n in enumerate(h) if n]
    if not used or used[0] < 33:
        raise NoCutoff("no quality codes" if not used else f"quality code {used[0]} is below 33")
    low, high = used[0], used[-1]
    if low <= 58:
        if high > 74:
            raise NoCutoff(f"quality codes {low} to {high} fit no offset")
        return 33
    return 33 if low <= 74 and high <= 74 else 64


def quality_cutoffs(h: list[int], offset: int, ratio: float = 0.05, extreme: float = 0.01) -> tuple[int, int]:
    """The qualities up to which a share `ratio` (and `extreme`) of all characters lies."""
    total, run, low, lowest = sum(h), 0, None, None
    for i, n in enumerate(h):
        run += n
        if lowest is None and run >= extreme * total and run:
            lowest = i - offset
        if low is None and run >= ratio * total and run:
            low = i - offset
    return low or 0, lowest or 0


def quality_cutoff_table(h: DataFrame, ratio: float = 0.05, extreme: float = 0.01) -> DataFrame:
    """One row: offset (null if contradictory), cutoff, extreme_cutoff, both less the offset."""
    share = F.sum("n").over(W.orderBy("bin")) / F.sum("n").over(W.partitionBy())
    s = h.withColumn("share", share).agg(
        F.min(F.when(F.col("n") > 0, F.col("bin"))).alias("lo"), F.max(F.when(F.col("n") > 0, F.col("bin"))).alias("hi"),
        F.min(F.when(F.col("share") >= ratio, F.col("bin"))).alias("c"), F.min(F.when(F.col("share") >= extreme, F.col("bin"))).alias("x"),
    )
    low = (F.col("lo") >= 33) & ((F.col("lo") <= 58) & (F.col("hi") <= 74) | F.col("lo").between(59, 74) & (F.col("hi") <= 74))
    offset = F.when(low, 33).when((F.col("lo") >= 33) & (F.col("lo") > 58), 64)
    return s.withColumn("qs_offset", offset).select("qs_offset", (F.col("c") - F.col("qs_offset")).alias("cutoff"), (F.col("x") - F.col("qs_offset")).alias("extreme_cutoff"))


def scanned_offset(reads: DataFrame) -> DataFrame:
    """One row (qs_offset): by the first decisive character in read order, above 99: 64, below 38: 33; else 33."""
    c = reads.select("read_id", F.posexplode(F.split("quals", ""))).select("read_id", "pos", F.ascii("col").alias("code")).where("code > 0")
    sign = F.when(F.col("code") > 99, 64).when(F.col("code") < 38, 33)
    first = c.withColumn("sign", sign).where("sign is not null").agg(F.min_by("sign", F.struct("read_id", "pos")).alias("s"))
    return first.select(F.coalesce("s", F.lit(33)).alias("qs_offset"))
