"""Joining part files into one, on whatever file system Spark reaches."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _order(name: str) -> tuple:
    """Numbers in names compare as numbers."""
    return tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", name) if x)


def merge(spark: SparkSession, folder: str, target: str, delete: bool = False, replication: int | None = None) -> int:
    """Concatenate the folder's non-empty part files, in order of their names, into target; returns how many.

    A single part is renamed if the folder may go. An existing target is replaced.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    source, goal = path(folder), path(target)
    fs, to = source.getFileSystem(conf), goal.getFileSystem(conf)
    if not fs.exists(source):
        raise FileNotFoundError(folder)
    parts = sorted((s for s in fs.listStatus(source) if s.isFile() and s.getLen() > 0 and s.getPath().getName()[0] not in "_."), key=lambda s: _order(s.getPath().getName()))
    to.delete(goal, False)
    if goal.getParent() is not None:
        to.mkdirs(goal.getParent())
    if len(parts) == 1 and delete and fs.getUri().equals(to.getUri()):
        fs.rename(parts[0].getPath(), goal)
    else:
        out = to.create(goal, True)
        try:
            for part in parts:
                stream = fs.open(part.getPath())
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
                finally:
                    stream.close()
        finally:
            out.close()
    if replication:
        to.setReplication(goal, replication)
    if delete:
        fs.delete(source, True)
    return len(parts)
