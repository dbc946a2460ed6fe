"""Global order without a global sort: ranges, sorted and written once, and places counted over their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def numbered(rows: DataFrame, key: list[str], folder: str) -> DataFrame:
    """rows plus ordinal, 0 to n - 1 ascending by key; rows with equal keys follow each other in any order.

    One shuffle by range. A plan run twice may draw other ranges, so the sorted ranges are written to
    `folder`, which all executors see, before they are counted; a row's ordinal is its place in its
    file plus the rows of the files before, and stays the same whoever reads it, or reads it again.
    The only window has one row a file.
    """
    rows.repartitionByRange(*key).sortWithinPartitions(*key).write.parquet(folder)
    spark = rows.sparkSession
    staged = spark.read.schema(rows.schema).parquet(folder).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    part = [F.regexp_extract("_file", r"^part-(\d+)", 1).cast("int"), F.regexp_extract("_file", r"-c(\d+)\.", 1).cast("int"), F.col("_file")]
    files = staged.groupBy("_file").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy(*part).rowsBetween(W.unboundedPreceding, -1))
    bases = files.select("_file", F.coalesce(before, F.lit(0)).alias("_base"))
    return staged.join(bases, "_file").select(*rows.columns, (F.col("_base") + F.col("_row")).alias("ordinal"))
