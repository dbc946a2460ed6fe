"""Mixing sources to target weights: fixed-length blocks, drawn slots, pseudorandom index permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandwise.operators.order import numbered

from .shared import GAP, free, fresh, stage, table

WEIGHTS, FACTOR, BLOCK, SHARDS, SEED, ROUNDS = (1, 2, 3), 3, 64, 64, 17, 16
BEFORE = (W.unboundedPreceding, -1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, GAP), "")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, factor: int = FACTOR) -> DataFrame:
    """One row per source: skey, source, source_size, weight, target.

    Sources in code point order, null last, weigh weights[0], weights[1], ..., repeating, and share the
    sum of all sizes. No target exceeds factor times its source's size; the excess is shared again by
    weight. So a target is least(cap, level * weight), and the level rises to its fixed point in
    rounds: what the sources below their caps must take, over their weights. A round sums up over the
    sources and gives the driver two numbers; ranks come from written ranges. No task holds all sources.
    """
    s = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    s = numbered(s.withColumn("_none", F.col("source").isNull()), ["_none", "source"], fresh(sized.sparkSession, "ranks"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("ordinal") % len(weights)).cast("int") + 1)
    s = stage(s.select("skey", "source", "source_size", weight.alias("weight"), (F.col("source_size") * factor).cast("double").alias("cap")), "sources")
    level, total = 0.0, s.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = F.col("weight") * F.lit(level) > F.col("cap")
        caps, share = s.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        after = (total - caps) / share if share else level
        if after <= level:
            break
        level = after
    return s.select("skey", "source", "source_size", "weight", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def permuted(j: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 chosen by key: swap-or-not rounds, each an involution on any n."""

    def step(x, i):
        other = F.pmod(F.pmod(F.xxhash64(key, i), n) + n - x, n)
        return F.when(F.xxhash64(key, i, F.greatest(x, other)) % 2 == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), j, step)


def placed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, skey, size, hash (of the text), start: where each document's words begin in its source's word sequence.

    Null, empty and wordless texts have size 0; repeated rows and null ids have places of their own; an
    empty table has none. The order within a source is by hashed bucket, then doc_id. A prefix sum runs in about sqrt(n)
    buckets per source and one over the buckets, so that no task holds a source. Both tables are staged.
    """
    skey = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    sized = stage(docs.select("doc_id", "source", skey.alias("skey"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("hash")), "sizes")
    buckets = max(1, math.isqrt(sized.count()))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
    inner = F.coalesce(F.sum("size").over(W.partitionBy("skey", "bucket").orderBy("doc_id", "size", "hash").rowsBetween(*BEFORE)), F.lit(0))
    totals = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("total"))
    base = F.coalesce(F.sum("total").over(W.partitionBy("skey").orderBy("bucket").rowsBetween(*BEFORE)), F.lit(0))
    bases = totals.select("skey", "bucket", base.alias("base"))
    out = sized.withColumn("inner", inner).join(bases, ["skey", "bucket"])
    return stage(out.select("doc_id", "source", "skey", "size", "hash", (F.col("base") + F.col("inner")).alias("start")), "placed")


def draws(targets: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(skey, n, shard, n_slots, first): how many of a source's slots each output shard draws, and the first of them.

    A source of n blocks has as many slots as bring its words nearest its target: whole rounds of all
    its blocks, then a partial round. Each slot draws its shard at random, so the counts of a source
    are multinomial over the shards, and the sources' counts in a shard multinomial given its size,
    while every source's total stays what its target asks for. The counts decide which slots there are.
    """
    n = F.ceil(F.col("source_size") / block)
    whole = F.floor(F.col("target") / F.col("source_size"))
    s = targets.where("source_size > 0").withColumns({"n": n, "whole": whole})
    extra = F.least("n", F.round((F.col("target") - F.col("whole") * F.col("source_size")) / block).cast("long"))
    s = s.withColumn("slots", F.col("whole") * F.col("n") + extra).where("slots > 0").select("skey", "n", "slots")
    drawn = spread(s.withColumn("_from", F.lit(0).cast("long")), "slots", ["skey", "n"], "draw")
    drawn = drawn.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "skey", "draw"), F.lit(shards)).cast("int"))
    counts = stage(drawn.groupBy("skey", "n", "shard").agg(F.count("*").alias("n_slots")), "draws")
    before = F.sum("n_slots").over(W.partitionBy("skey").orderBy("shard").rowsBetween(*BEFORE))
    return counts.withColumn("first", F.coalesce(before, F.lit(0)))


def spread(rows: DataFrame, count: str, keep: list[str], name: str, span: int = 1024) -> DataFrame:
    """keep, name: each row `count` times, with name running from _from on; in portions, dealt to all tasks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, ({count} - 1) div {span})"))).repartition(parts, *keep, "_chunk")
    return cut.withColumn(name, F.explode(F.expr(f"sequence(_from + _chunk * {span}, _from + least({count}, (_chunk + 1) * {span}) - 1)"))).select(*keep, name)


def mix(places: DataFrame, targets: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: one row for each piece of a document in a drawn block.

    Returns shard, skey, slot, block, doc_id, start, size, hash, from_word, n_words. A source is cut into
    blocks of `block` words. The shards' drawn counts (draws()) make its slots: a shard's are consecutive.
    Slot j of a round takes the block at place j of that round's permutation, hence no block is taken
    twice in a round and no document more often than rounds. Slots meet pieces by (source, block index).
    """
    slots = spread(draws(targets, block, shards, seed).withColumnRenamed("first", "_from"), "n_slots", ["skey", "n", "shard"], "slot")
    slots = slots.withColumn("_key", F.xxhash64(F.lit(seed), "skey", F.expr("slot div n")))
    slots = slots.select("skey", "slot", "shard", permuted(F.col("slot") % F.col("n"), F.col("n"), F.col("_key")).alias("block"))
    inside = places.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    left = F.greatest(F.col("block") * block, "start")
    right = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    pieces = inside.select("skey", "block", "doc_id", "start", "size", "hash", (left - F.col("start")).alias("from_word"), (right - left).alias("n_words"))
    # the counts look small to the planner, but the slots made from them grow with the corpus: never broadcast
    return slots.hint("merge").join(pieces, ["skey", "block"]).select("shard", "skey", "slot", "block", "doc_id", "start", "size", "hash", "from_word", "n_words")


def mixed_documents(docs: DataFrame, block: int = 2048, seed: int = SEED) -> DataFrame:
    """The mix as documents: one row, with the columns of docs, for each piece of a document that a slot takes.

    A piece that is a whole document keeps its text as it is; others are their words joined by spaces.
    n_chars is that of the new text. Documents without words are in no block and fall away. Repeated
    rows have each their own places. Columns of any name stay as they are; an empty table gives none.
    """
    columns = docs.columns
    places = placed(docs)
    drawn = mix(places, source_targets(places), block, SHARDS, seed)
    skey, id_, hash_, size, at, n = (free(f"_mix_{x}", columns) for x in ("skey", "id", "hash", "size", "from", "n"))
    keys = {skey: F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), id_: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), hash_: F.xxhash64("text"), size: word_count(F.col("text"))}
    own = docs.withColumns(keys).dropDuplicates(list(keys))  # equal rows have each its own places in the mix
    place = drawn.select(F.col("skey").alias(skey), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(id_), F.col("hash").alias(hash_), F.col("size").alias(size), F.col("from_word").alias(at), F.col("n_words").alias(n))
    taken = own.join(place, list(keys))
    words = F.array_remove(F.split("text", GAP), "")
    piece = F.when(F.col(n) == F.col(size), F.col("text")).otherwise(F.concat_ws(" ", F.slice(words, (F.col(at) + 1).cast("int"), F.col(n).cast("int"))))
    return taken.withColumn("text", piece).withColumn("n_chars", F.char_length("text").cast("long")).select(*(F.col(f"`{c}`") for c in columns))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, weight, shards (those that draw words of it) for every row of documents.

    Null, empty and wordless texts have size 0 and nothing taken; very long ones span many blocks. A
    null source is a source of its own, the last. Repeated rows and rows without id have each their own
    place. An empty table gives no rows. Other columns aren't read.
    """
    places = placed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    targets = source_targets(places)
    taken = mix(places, targets).groupBy("skey", "start").agg(F.sum("n_words").alias("taken"), F.sort_array(F.collect_set("shard")).alias("shards"))
    keyed = places.withColumn("_at", F.when(F.col("size") > 0, F.col("start"))).drop("source")
    out = keyed.join(targets, "skey").join(taken.withColumnRenamed("start", "_at"), ["skey", "_at"], "left")
    shards = F.coalesce("shards", F.array().cast("array<int>"))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "weight", shards.alias("shards"))
