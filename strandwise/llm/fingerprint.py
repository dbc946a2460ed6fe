"""Document fingerprints: bottom-k sketches of word shingle hashes, mergeable across parts of a text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import GAP, free, fresh, table

K, SHINGLE = 128, 5
LAST = 2**63 - 1


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """64-bit hashes of all `width`-word shingles; a shorter text is one shingle, a text without words none."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")
    roll = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
    several = lambda w: F.when(F.size(w) >= width, roll(w)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>"))
    return F.element_at(F.transform(F.array(words), several), 1)


def sketch(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def fingerprint(text: Column, k: int = K, width: int = SHINGLE) -> Column:
    """The sketch of a whole text; empty for null, empty and wordless texts. Equal texts have equal sketches."""
    return sketch(shingle_hashes(text, width), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union, from two sketches of the same k."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A or B|, 0 to 1; two empty sets resemble each other fully."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    place = (F.element_at(a, k).cast("double") + float(2**63)) / float(2**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A|, 0 to 1; the empty set is contained fully."""
    r, n = resemblance(a, b, k), distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * n / distinct_count(a, k)))


#: Bounds are rows (key, first characters of the tie-breaker), compared in this order.
BOUNDS = "array<struct<k:bigint,t:string>>"


def bounds_column(bounds: list[tuple[int, str]]) -> Column:
    return F.from_json(F.lit(json.dumps([{"k": k, "t": t} for k, t in bounds])), BOUNDS)


def bucket_of(row: Column, bounds: list[tuple[int, str]], fan: int = 32) -> Column:
    """Number of bounds at or below row (k, t), found in levels of `fan` comparisons."""
    if not bounds:
        return F.lit(0)
    levels = [bounds]
    while len(levels[-1]) > fan:
        levels.append(levels[-1][fan - 1 :: fan])
    at = F.lit(0)
    for level in reversed(levels):
        part = F.slice(bounds_column(level), at * fan + 1, fan)
        at = at * fan + F.size(F.filter(part, lambda x: x <= row))
    return at


def with_next(docs: DataFrame, key: str, order: list[str], carried: list[str], per_bucket: int = 64, buckets: int = 16384, most_rows: int = 100_000) -> DataFrame:
    """Add next_<c> for each carried column: its value in the next row ascending by key (after the last: the first).

    Rows with equal keys follow each other by the columns in `order`; null keys come last. Keys alone
    are sorted first, in ranges that are written; of each range every so many rows one is a bound: `per_bucket`,
    more so that there are about `buckets`, but never more than `most_rows`, so that beyond that the
    buckets grow in number with the rows and not in size. A bound is the key and the first 64
    characters of the first column of `order`, so rows without key, or with one key, are split too.
    The rows are then dealt to buckets; the first of a bucket also goes to the bucket before, so each
    bucket finds all successors by itself. The driver holds the bounds, a hundred-thousandth of the rows.
    An empty table has no next rows.
    """
    names = docs.columns
    k, t, b, to, at, x = (free(c, names) for c in ("_key", "_tie", "_bucket", "_to", "_at", "_copy"))
    tie = F.coalesce(F.substr(F.col(order[0]).cast("string"), F.lit(1), F.lit(64)), F.lit("")) if order else F.lit("")
    keyed = docs.withColumns({k: F.coalesce(F.col(key).cast("long"), F.lit(LAST)), t: tie})
    folder = fresh(docs.sparkSession, "keys")
    keyed.select(F.col(k).alias("k"), F.col(t).alias("t")).repartitionByRange("k", "t").sortWithinPartitions("k", "t").write.parquet(folder)
    sorted_keys = docs.sparkSession.read.schema("k bigint, t string").parquet(folder)
    n = sorted_keys.count()
    every = max(per_bucket, min(-(-n // buckets), most_rows))
    firsts = sorted({(r["k"], r["t"]) for r in sorted_keys.where(F.col("_metadata.row_index") % every == 0).select("k", "t").collect()})
    row = F.struct(F.col(k).alias("k"), F.col(t).alias("t"))
    start = F.get(bounds_column(firsts), F.col(b)) == row
    here = F.struct(F.col(b).alias("b"), F.lit(0).alias("x"))
    before = F.struct(F.pmod(F.col(b) - 1, F.lit(max(1, len(firsts)))).alias("b"), F.lit(1).alias("x"))
    dealt = keyed.withColumn(b, bucket_of(row, firsts[1:])).withColumn(to, F.when(start, F.array(here, before)).otherwise(F.array(here)))
    dealt = dealt.drop(b, t).withColumn(at, F.explode(to)).withColumns({b: F.col(at)["b"], x: F.col(at)["x"]}).drop(to, at)
    after = W.partitionBy(b).orderBy(x, k, *order)
    return dealt.withColumns({f"next_{c}": F.lead(c).over(after) for c in carried}).where(F.col(x) == 0).drop(b, x, k)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of documents.

    Null texts are empty; two texts without words are fully alike. Very long texts count whole. Rows
    with one doc_id follow each other by text, rows without come last; repeated rows are rows of their
    own. The only row of a table is its own next. An empty table gives no rows. Other columns aren't read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("fp", fingerprint(F.col("text")))
    near = with_next(docs, "doc_id", ["text"], ["text", "fp"])
    n = F.char_length("text")
    near = near.withColumn("n_chars", n.cast("long")).withColumn("_cut", F.floor(n / 4).cast("int"))
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - F.col("_cut")), F.substr("next_text", F.lit(1), F.col("_cut")))
    near = near.withColumn("edited", edited).withColumn("edited_fp", fingerprint(F.col("edited")))
    shown = lambda c: F.array_join(F.transform(c, F.hex), ",")
    return near.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown("fp").alias("fingerprint"), shown("edited_fp").alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp")).alias("near_edited"), resemblance(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
