"""Command line: python -m strandwise.cli correct|merge ..."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from strandwise import config
from strandwise.session import configured
from strandwise.plans import pipeline
from strandwise.sources.merge import merge


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandwise", description="k-mer spectrum correction of short reads on Spark")
    top.add_argument("-v", "--version", action="version", version="strandwise 0.1")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("correct", help="correct a FASTQ file, or two files of mates")
    source = c.add_mutually_exclusive_group(required=True)
    source.add_argument("-s", "--single", metavar="FILE")
    source.add_argument("-p", "--paired", nargs=2, metavar="FILE")
    c.add_argument("-o", "--output", default=".", help="folder for the results")
    c.add_argument("-c", "--config", help="file of KEY=value settings")
    c.add_argument("-k", "--kmer", type=int, help="k-mer length, 2 to 32")
    c.add_argument("-a", "--algorithms", help="conservative, consensus, scored or all, comma-separated")
    c.add_argument("-sc", "--splits-per-core", type=int, default=8)
    c.add_argument("-m", "--merge", nargs="?", const="", metavar="FOLDER", help="also write one file per input and algorithm, into FOLDER or the output folder")
    m = sub.add_parser("merge", help="join the part files of a folder")
    m.add_argument("-i", "--input", required=True)
    m.add_argument("-o", "--output", required=True)
    m.add_argument("-d", "--delete", action="store_true", help="delete the parts afterwards")
    m.add_argument("-r", "--replication", type=int)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = configured(SparkSession.builder.appName("strandwise")).getOrCreate()
    if args.command == "merge":
        print(merge(spark, args.input, args.output, args.delete, args.replication), "parts")
        return 0
    cores = spark.sparkContext.defaultParallelism
    per_core = args.splits_per_core if args.splits_per_core >= 1 else 8
    names = tuple(x.strip() for x in args.algorithms.split(",")) if args.algorithms else None
    settings = config.load(args.config, k=args.kmer, algorithms=names, partitions=cores * per_core)
    inputs = [args.single] if args.single else args.paired
    output = os.path.abspath(args.output) if "://" not in args.output else args.output
    target = None if args.merge is None else args.merge or output
    print(json.dumps({"settings": str(settings)} | pipeline.run(spark, inputs, output, settings, target), indent=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
