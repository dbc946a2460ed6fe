"""Settings of the sessions that the command line starts; those the launcher or the cluster gives come first."""

from __future__ import annotations

from pyspark import SparkConf
from pyspark.sql import SparkSession

SETTINGS = {
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.shuffle.compress": "true",
    "spark.rdd.compress": "true",
    "spark.broadcast.compress": "true",
    "spark.speculation": "false",
    # the solid set comes to the driver after a check of its size
    "spark.driver.maxResultSize": "0",
    "spark.hadoop.mapreduce.fileoutputcommitter.algorithm.version": "2",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """The builder with SETTINGS, but for those that are set already."""
    given = SparkConf()
    for key, value in SETTINGS.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    return builder
