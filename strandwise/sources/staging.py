"""Where intermediate tables go: a folder that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir; without one the warehouse, or (local masters only) a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        base = "file://" + tempfile.mkdtemp() if master == "local" or master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/strandwise-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
