"""MinHash near-dedup: a multi-index Hamming join of signatures, confirmed on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import MapType, VariantType

from .shared import LOWER, UPPER, WORD, components, free, lean, stage, table
from .shingles import MinHash, mixed, overlap, shingle_set, unpacked

#: 64 slots in 8 chunks: two signatures that differ in at most 15 of these agree, but for one slot, in some chunk.
KEYED, CHUNKS, PERCENT = 64, 8, 85
#: All slots, and the signature-distance threshold: at 85 % likeness 38 slots differ, and more than FAR for less than one pair in 10^9.
SLOTS, FAR = 256, 76
#: A tile of a key holds two blocks of about TILE members, fewer if their sets are large: about WEIGHT shingles a block.
TILE, WEIGHT, ROUNDS = 512, 1 << 20, 1
#: What a pair at exactly the wanted likeness may be missed by: no shared key, or more than `far` slots that differ. And the most keys a text may have.
UNKEYED, PRUNED, KEYS = 2e-4, 1e-9, 72
#: A text that this many pairs need is sent to as many more places.
FAN = 256


def layout(percent: int) -> tuple[int, int, int]:
    """(keyed, chunks, far) for a likeness of percent: by the binomial, few pairs of that likeness are missed.

    The widest chunks (they meet the fewest strangers) that need at most KEYS slots in all.
    """
    same = percent / 100
    for each in range(KEYS, 0, -1):
        miss = 1 - same**each - each * (1 - same) * same ** (each - 1)
        chunks = 1 if miss <= UNKEYED else math.ceil(math.log(UNKEYED) / math.log(miss)) if miss < 1 else KEYS + 1
        if each * chunks <= KEYS:
            break
    tail, far = 1.0, -1
    while tail > PRUNED and far < SLOTS:
        far += 1
        tail -= math.comb(SLOTS, far) * (1 - same) ** far * same ** (SLOTS - far)
    return each * chunks, chunks, far


def signatures(docs: DataFrame, slots: int = SLOTS, keyed: int = KEYED) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set), sig for every text; the last two null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(slots, keyed)
        for batch in batches:
            ns, digests, sigs = [], [], []
            for data in batch.column(1):
                own = shingle_set(data.as_py())
                ns.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sigs.append(minhash(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary")).mapInArrow(lean("near_dedup", run), "doc_id long, n_shingles long, digest binary, sig binary")


def chunk_keys(classes: DataFrame, keyed: int = KEYED, chunks: int = CHUNKS) -> DataFrame:
    """(key, slot, doc_id): a key for each chunk and each slot left out of it, which is one allowed error."""
    each = keyed // chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(5)
        odd = rng.integers(0, 2**63, keyed, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salts = rng.integers(0, 2**63, keyed, dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            terms = mixed((unpacked(batch.column(1).to_pylist(), keyed)[0].astype(np.uint64) + np.uint64(1)) * odd)
            for c in range(chunks):
                part = terms[:, c * each : (c + 1) * each]
                whole = part.sum(1, dtype=np.uint64)
                for omit in range(each):
                    slot = c * each + omit
                    key = mixed(whole - part[:, omit] + salts[slot])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), slot, np.int32)), ids], ["key", "slot", "doc_id"])

    return classes.select("doc_id", "sig").mapInArrow(lean("near_dedup", run), "key long, slot int, doc_id long")


def within(pairs: DataFrame, classes: DataFrame, far: int = FAR, keyed: int = KEYED) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most `far` slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (x, xs), (y, ys) = (unpacked(batch.column(i).to_pylist(), keyed) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x != y).sum(1) + (xs != ys).sum(1) <= far))

    sig = lambda c: classes.select(F.col("doc_id").alias(c), F.col("sig").alias(f"sig_{c}"))
    return pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(lean("near_dedup", run), "a long, b long")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, data_a, data_b) of (staged) pairs; a text that many pairs need is copied to several keys, which its pairs share out by hash.

    Which texts are such hubs is found, and the pairs dealt, before any text moves; the other pairs
    don't wait for it.
    """
    dealt, copies = pairs, {}
    for side, other in (("a", "b"), ("b", "a")):
        hubs = pairs.groupBy(side).agg(F.ceil(F.count("*") / FAN).cast("int").alias("_fan")).where("_fan > 1")
        dealt = dealt.join(hubs, side, "left").withColumn(f"_salt_{side}", F.pmod(F.xxhash64(other), F.coalesce("_fan", F.lit(1))).cast("int")).drop("_fan")
        own = texts.select(F.col("doc_id").alias(side), F.col("data").alias(f"data_{side}")).join(hubs, side, "left")
        copies[side] = own.withColumn(f"_salt_{side}", F.explode(F.expr("sequence(0, coalesce(_fan, 1) - 1)"))).drop("_fan")
    for side in ("a", "b"):
        dealt = dealt.join(copies[side], [side, f"_salt_{side}"])
    return dealt.select("a", "b", "data_a", "data_b")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose whole shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3)):
                tb = tb.as_py()
                if tb != last:
                    last, last_set = tb, shingle_set(tb)
                own = shingle_set(ta.as_py())
                both = overlap(own, last_set)
                keep.append(bool(both) and 100 * both >= percent * (len(own) + len(last_set) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return with_texts(pairs, texts).mapInArrow(lean("near_dedup", run), "a long, b long")


def open_links(members: DataFrame, classes: DataFrame, texts: DataFrame, tile: int = TILE, far: int = FAR, keyed: int = KEYED, chunks: int = CHUNKS, percent: int = PERCENT) -> DataFrame:
    """Confirmed links (a, b) that join different components in the same key; members: key, slot, doc_id, component.

    A key's members are dealt into blocks by hash, of about TILE members or WEIGHT shingles, and every
    two blocks meet in a task of their own, so that the size of a task doesn't grow with the key's. Signatures give the near pairs; one that
    shares several keys counts in the first only, which both signatures tell. Pairs stay lists inside
    their tile: the texts of those concerned join the tile, where pairs not yet connected there are
    confirmed. So no more rows leave a tile than it has members.
    """
    each = keyed // chunks
    known = members.join(classes.select("doc_id", "sig", "n_shingles"), "doc_id")
    sizes = known.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / tile, F.sum("n_shingles") / WEIGHT)).cast("int").alias("_k"))
    m = known.drop("n_shingles").join(sizes, "key")
    m = m.withColumn("_own", F.pmod(F.xxhash64("doc_id"), F.col("_k")).cast("int"))
    m = m.withColumn("_other", F.explode(F.expr("sequence(0, _k - 1)")))
    m = m.select("key", "slot", "doc_id", "component", "sig", "_own", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))

    def near(key, batch):
        own, i, j = batch.column("_own").to_numpy(), key[1].as_py(), key[2].as_py()
        slot = batch.column("slot")[0].as_py()
        ids, comp = batch.column("doc_id").to_numpy(), batch.column("component").to_numpy()
        wide, rest = unpacked(batch.column("sig").to_pylist(), keyed)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found, concerned = {}, np.zeros(len(ids), bool)
        for x in left:
            y = right[(ids[right] > ids[x]) if i == j else np.ones(len(right), bool)]
            y = y[comp[y] != comp[x]]
            if not len(y):
                continue
            differ = wide[y] != wide[x]
            close = differ.sum(1) + (rest[y] != rest[x]).sum(1) <= far
            y, differ = y[close], differ[close].reshape(-1, chunks, each)
            errors = differ.sum(2)
            chunk = (errors <= 1).argmax(1)
            every = np.arange(len(y))
            omit = np.where(errors[every, chunk] == 1, differ[every, chunk].argmax(1), 0)
            y = y[chunk * each + omit == slot]
            if len(y):
                found[x] = ids[y]
                concerned[x] = concerned[y] = True
        rows = np.flatnonzero(concerned)
        partners = pa.array([found.get(x, np.empty(0, np.int64)) for x in rows], pa.list_(pa.int64()))
        return pa.table({"key": pa.array(np.full(len(rows), key[0].as_py())), "i": pa.array(np.full(len(rows), i, np.int32)), "j": pa.array(np.full(len(rows), j, np.int32)), "doc_id": pa.array(ids[rows]), "component": pa.array(comp[rows]), "partners": partners})

    def confirm(key, batch):
        ids, comp = batch.column("doc_id").to_pylist(), batch.column("component").to_pylist()
        sets = {i: shingle_set(x.as_py()) for i, x in zip(ids, batch.column("data"))}
        root = dict(zip(ids, comp)) | {c: c for c in comp}

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        a, b = [], []
        for x, partners in zip(ids, batch.column("partners").to_pylist()):
            for y in partners:
                if top(x) != top(y) and 100 * (n := overlap(sets[x], sets[y])) >= percent * (len(sets[x]) + len(sets[y]) - n):
                    root[top(x)] = top(y)
                    a.append(max(x, y))
                    b.append(min(x, y))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    tiles = m.groupBy("key", "i", "j").applyInArrow(near, "key long, i int, j int, doc_id long, component long, partners array<long>")
    return tiles.join(texts, "doc_id").groupBy("key", "i", "j").applyInArrow(confirm, "a long, b long")


def near_groups(docs: DataFrame, rounds: int = ROUNDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, digest, component_id for every row of docs (doc_id, text); links are of percent likeness or more.

    Texts with equal sets of shingles are one class, represented by its smallest doc_id, however many
    copies there are. Class signatures meet on chunk keys. In some rounds every member of a key is
    compared to one of them, another in each round, if their components differ. Then the members that
    are still in different components are compared with each other, so that no link between
    components is lost though pairs within one are never listed.
    Null and empty texts and null ids link with nothing; rows that share a doc_id are one node.
    """
    docs = docs.select("doc_id", "text")
    keyed, chunks, far = layout(percent)
    sigs = stage(signatures(docs, keyed=keyed), "signatures")
    classes = sigs.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = stage(classes, "classes")

    keys = chunk_keys(classes, keyed, chunks)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = stage(keys.join(shared, "key"), "members")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("data"))
    texts = stage(texts.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")

    held, tested, groups = members.withColumn("component", F.col("doc_id")), None, None
    for n in range(rounds):
        # in every key that joins several components, compare its members to one of them
        pivot = F.min_by("doc_id", F.xxhash64(F.lit(n), "doc_id")).alias("b")
        pivots = held.groupBy("key").agg(pivot, F.min_by("component", F.xxhash64(F.lit(n), "doc_id")).alias("of"))
        pairs = held.join(pivots, "key").where("component <> of").select(F.greatest("doc_id", "b").alias("a"), F.least("doc_id", "b").alias("b")).distinct()
        pairs = stage(within(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), classes, far, keyed), "pairs")
        links = confirmed(pairs, texts, percent)
        tested = pairs if tested is None else tested.unionByName(pairs)
        edges = links if groups is None else links.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
        groups = components(edges)
        held = members.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        several = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        held = stage(held.join(several, "key", "left_semi"), "open")

    final = components(open_links(held, classes, texts, far=far, keyed=keyed, chunks=chunks, percent=percent).unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    final = final.withColumnRenamed("node", "_rep").withColumnRenamed("component", "_least")
    by_class = classes.select("digest", F.col("doc_id").alias("_rep")).join(final, "_rep", "left").select("digest", F.coalesce("_least", "_rep").alias("_group"))
    return sigs.drop("sig").join(by_class, "digest", "left").select("doc_id", "n_shingles", "digest", F.coalesce("_group", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is their group's smallest; rows with a null doc_id all stay.

    Of rows equal in doc_id and text one stays, the first by the other columns. Rows that share a
    doc_id but not the text are one node: they stay or go together.
    """
    groups = near_groups(docs, percent=percent)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    others = [f.name for f in docs.schema if f.name not in ("doc_id", "text") and not isinstance(f.dataType, (MapType, VariantType))]
    place = free("_place", docs.columns)
    first = F.row_number().over(W.partitionBy("doc_id", "text").orderBy(*(F.col(f"`{c}`") for c in others) or [F.lit(0)]))
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn(place, first).where(F.col(place) == 1)
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of documents; links are of 85 % likeness or more.

    Null, empty and wordless texts have n_shingles 0 and link with nothing; fewer words than five are
    one shingle. Very long texts count whole. Repeated rows and rows that share a doc_id are one node,
    and each is returned. A null doc_id links with nothing and has a null component. An empty table
    gives no rows. Other columns aren't read.
    """
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= {PERCENT} * (na + nb - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.a = s.doc_id
"""
