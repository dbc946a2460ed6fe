"""Labelled rows for the classifiers: which may teach, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) leaves 0 here are held out from all learning.
FOLDS = 5
#: Labels with more values than this are put into as many bins.
GRADES = 128


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, data, y, weight) of at most `most` labelled rows that may teach, spread evenly over the values of the label.

    data is the text as bytes; weight is how many labelled rows of its value a row stands for.

    Which rows is decided by a hash of doc_id, so reruns agree. A doc_id with several labels has the
    largest; fractions stay. Beyond GRADES values, y is the mean of a bin of values next to each other,
    of about as many rows each. The sample's ids, at most `most`, are the only thing broadcast.
    """
    y = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.max(column).cast("double").alias("y")).where("y is not null and not isnan(y)")
    sizes = y.groupBy("y").agg(F.count("*").alias("n")).limit(GRADES + 1).collect()
    if len(sizes) > GRADES:
        borders = sorted(set(y.agg(F.percentile_approx("y", [i / GRADES for i in range(1, GRADES)], F.lit(10_000))).first()[0]))
        y = y.withColumn("_bin", sum((F.col("y") > b).cast("int") for b in borders))
        means = y.groupBy("_bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).collect()
        y = y.withColumn("y", F.element_at(F.create_map(*(F.lit(x) for r in means for x in (r["_bin"], r["y"]))), F.col("_bin"))).drop("_bin")
        sizes = means
    each = max(1, most // max(1, len(sizes)))
    chosen = y.withColumn("_order", F.xxhash64(F.lit(column), "doc_id"))
    # of large values only hashes among which there are about 4 * each rows: the window's first ones are the same
    few = [(r["y"], min(2**63 - 1, int(-(2**63) + 2**64 * (4 * each + 64) / r["n"]))) for r in sizes if r["n"] > 4 * each + 64]
    for value, top in few:
        chosen = chosen.where((F.col("y") != value) | (F.col("_order") <= top))
    rank = F.row_number().over(Window.partitionBy("y").orderBy("_order", "doc_id"))
    stands = [x for r in sizes for x in (F.lit(float(r["y"])), F.lit(max(1.0, r["n"] / each)))]
    weight = F.element_at(F.create_map(*stands), F.col("y")) if stands else F.lit(1.0)
    chosen = chosen.withColumn("_rank", rank).where(F.col("_rank") <= each).select("doc_id", "y", weight.alias("weight"))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("data"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "data", "y", "weight")
