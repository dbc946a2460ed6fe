"""Helpers that the corpus operators share: reading tables, staging results, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words: the six ASCII characters that bytes.split() takes.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or (local masters only) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        base = "file://" + tempfile.mkdtemp(prefix="strandwise-")
        spark.sparkContext.setCheckpointDir(base)
        return base
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_strandwise"


def fresh(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there and lost executors lose nothing."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete what stage() wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def free(name: str, taken) -> str:
    """name, or name with as many underscores behind it as make it none of `taken`, whatever the case of letters."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


#: What the operators remember in a Python worker between tasks: name -> how to forget it.
_remembered: dict[str, Callable[[], object]] = {}


def remembers(name: str, forget: Callable[[], object]) -> None:
    _remembered[name] = forget


def lean(name: str, run: Callable) -> Callable:
    """run, for mapInArrow, in a worker that serves many operators: it forgets first what others than `name` remember.

    At a task's end freed memory goes back to the system, so that a waiting worker doesn't hold it.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other, forget in _remembered.items():
            if other != name:
                forget()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) edges -> (node, component) by union-find over all batches of a task."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = top(root.setdefault(u, u)), top(root.setdefault(v, v))
            if u != v:
                root[max(u, v)] = min(u, v)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, few: int = 100_000) -> DataFrame:
    """Connected components of the undirected edges (a, b) of longs.

    Alternating large-star and small-star rounds join every node's neighbours to the node's smallest
    neighbour. A hub's neighbours meet its smallest one in a join on the hub, one row on the other
    side, whose skewed keys adaptive execution splits; they are never gathered in a list. A round's
    result is staged, and rounds go on to the fixed point. As soon as no more than `few` edges are
    left, one task of that bounded size finishes them with the same result.
    Returns (node, component) for every node that has an edge; component is the smallest node
    reachable. Rows where a = b or one is null count as no edge.
    """
    look = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    pairs = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    current = stage(pairs, "edges")
    now, before = look(current), None
    while now != before:
        if now[0] <= few:
            return stage(current.coalesce(1).mapInArrow(joined, "node long, component long"), "components")
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every u has only smaller neighbours v here
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u")
        after = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, current = current, stage(after, "edges")
        unstage(old)
        now, before = look(current), now
    stars = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stage(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), "components")
