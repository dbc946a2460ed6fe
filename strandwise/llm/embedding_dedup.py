"""Embedding near-dedup: int8 tile products with error bounds, doubtful pairs again in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, lean, stage, table

THRESHOLD, TILE = 0.93, 1024


def units(vectors: pa.ListArray) -> np.ndarray:
    """The vectors, all of one length, as rows of norm 1."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    flat = flat / np.abs(flat).max(1)[:, None]  # so that squares neither vanish nor overflow
    return flat / np.sqrt(np.square(flat).sum(1))[:, None]


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, error): unit rows as integers of -127..127 times scale, and the norm of what is lost."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None])
    error = np.sqrt(np.square(unit - q * scale[:, None]).sum(1)) + 1e-12
    return q.astype(np.int8), scale, error


def judged(a: tuple, b: tuple, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sure) of the pairs of quantised rows that may have a cosine >= threshold (same: b is a; each pair once, i < j).

    |u.v - su sv qu.qv| <= eu + (1 + eu) ev, since u = su qu + eu-part and both are unit vectors; sure
    pairs are above the threshold by more than that, and those below it by more aren't returned.
    """
    (qa, sa, ea), (qb, sb, eb) = a, b
    exact = np.float32 if qa.shape[1] * 127 * 127 < 2**24 else np.float64  # integers up to 2^24 are exact in float32
    wide = qb.astype(exact).T.copy()
    none = np.empty(0, np.int64)
    rows, cols, sure = [none], [none], [np.empty(0, bool)]
    for at in range(0, len(qa), 256):
        part = slice(at, at + 256)
        near = (qa[part].astype(exact) @ wide).astype(float) * sa[part, None] * sb[None, :]
        slack = ea[part, None] + (1 + ea[part, None]) * eb[None, :] + 1e-9
        maybe = near + slack >= threshold
        if same:
            maybe &= np.arange(at, at + len(maybe))[:, None] < np.arange(len(qb))[None, :]
        i, j = np.nonzero(maybe)
        rows.append(i + at)
        cols.append(j)
        sure.append((near - slack)[i, j] >= threshold)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(sure)


def alike(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows x of a and rows y of b, unit vectors, have a cosine >= threshold in double precision."""
    out = np.empty(len(x), bool)
    for k in range(0, len(x), 1 << 16):
        part = slice(k, k + (1 << 16))
        out[part] = np.einsum("ij,ij->i", a[x[part]], b[y[part]]) >= threshold
    return out


def linked(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of unit rows with cosine >= threshold: by int8 products, doubtful ones again in double precision."""
    x, y, sure = judged(quantised(a), quantised(b), threshold, same)
    sure[~sure] = alike(a, b, x[~sure], y[~sure], threshold)
    return x[sure], y[sure]


def least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node index reachable over the edges (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def coded(classes: DataFrame) -> DataFrame:
    """classes without embedding, plus code (one signed byte a component), scale and error."""
    others = [c for c in classes.columns if c != "embedding"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.select(*others).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, scale, error = [b""] * batch.num_rows, np.empty(batch.num_rows), np.empty(batch.num_rows)
            dims = batch.column(others.index("dim")).to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                q, scale[rows], error[rows] = quantised(units(batch.column(len(others)).take(pa.array(rows))))
                for i, x in zip(rows, q):
                    code[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(code, pa.binary()), pa.array(scale), pa.array(error)], [*others, "code", "scale", "error"])

    return classes.select(*others, "embedding").mapInArrow(lean("embedding_dedup", run), f"{fields}, code binary, scale double, error double")


def stars(rep: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links, least) for each class from links (x, y) between classes: how many vectors it is linked to, and the smallest rep reachable."""
    links = np.bincount(x, m[y], len(rep)) + np.bincount(y, m[x], len(rep))
    order = np.argsort(rep, kind="stable")
    rank = np.empty(len(rep), np.int64)
    rank[order] = np.arange(len(rep))
    return links.astype(np.int64), rep[order][least_reachable(len(rep), rank[x], rank[y])][rank]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id for rows (vec_id, embedding, label); linked only within a label.

    Equal vectors of a label are one class with a multiplicity. Classes of a label are dealt into
    blocks of about `tile` by hash, and every two blocks meet in a task as int8 codes with an error
    bound for each vector. The bounds settle most pairs; of a pair they leave open the first class
    lists the second's place in the tile, so that no more rows leave a tile than it has classes. Only the classes of open
    pairs then join their full vectors, tile by tile, and are compared in double precision. A tile
    gives, for each class with links, how many vectors it is linked to and the smallest class
    reachable there; components follow from those stars. Every pair of a label is looked at, so the
    work grows with the square of a label, spread over its tiles; a block's codes are sent once for
    each block of the label, a byte a component.

    Null, empty, zero and non-finite vectors, null labels and null ids link with nothing. Vectors of
    different lengths aren't compared. Rows that share a vec_id are one node of the components.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    fine = "embedding is not null and label is not null and vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    v = stage(v.withColumn("digest", F.when(F.expr(f"coalesce({fine}, false)"), F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.col("embedding").cast("string")), 256))), "vectors")
    classes = v.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    classes = stage(classes.withColumn("dim", F.size("embedding")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("_k"))
    c = stage(coded(classes), "codes").join(sizes, ["label", "dim"]).withColumn("_own", F.pmod(F.xxhash64("digest"), F.col("_k")).cast("int"))
    c = c.withColumn("_other", F.explode(F.expr("sequence(0, _k - 1)")))
    c = c.select("label", "dim", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "digest", "rep", "m", "code", "scale", "error")

    def compare(key, rows):
        own, i, j = rows.column("_own").to_numpy(), key[2].as_py(), key[3].as_py()
        rows = rows.take(pa.array(np.lexsort((rows.column("rep").to_numpy(), own != i))))
        own, rep, m, scale, error = (rows.column(x).to_numpy() for x in ("_own", "rep", "m", "scale", "error"))
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(len(rep), -1)
        cut = len(own) if i == j else int((own == i).sum())
        left, right = ((code[p], scale[p], error[p]) for p in (slice(0, cut), slice(0 if i == j else cut, None)))
        x, y, sure = judged(left, right, threshold, i == j)
        y = y if i == j else y + cut
        links, least = stars(rep, m, x[sure], y[sure])
        doubt = np.zeros(len(rep), bool)
        doubt[x[~sure]] = doubt[y[~sure]] = True
        hit = np.flatnonzero((links > 0) | doubt)
        partners = np.split(y[~sure].astype(np.int32), np.searchsorted(x[~sure], hit)[1:]) if len(hit) else []
        same = lambda name: pa.array([key[("label", "dim", "i", "j").index(name)].as_py()] * len(hit), rows.column(name).type)
        return pa.table({
            **{n: same(n) for n in ("label", "dim", "i", "j")}, "digest": rows.column("digest").take(pa.array(hit)), "rep": rep[hit], "m": m[hit], "links": links[hit], "least": least[hit],
            "doubt": pa.array(doubt[hit]), "at": hit.astype(np.int32), "partners": pa.array(list(partners), pa.list_(pa.int32())),
        })

    def settle(key, rows):
        rep, m, unit = rows.column("rep").to_numpy(), rows.column("m").to_numpy(), units(rows.column("embedding").combine_chunks())
        place, partners = rows.column("at").to_numpy(), rows.column("partners").combine_chunks()
        order = np.argsort(place)
        x = np.repeat(np.arange(len(rep)), partners.value_lengths().to_numpy())
        y = order[np.searchsorted(place[order], partners.flatten().to_numpy())]
        ok = alike(unit, unit, x, y, threshold)
        links, least = stars(rep, m, x[ok], y[ok])
        hit = np.flatnonzero(links)
        return pa.table({"digest": rows.column("digest").take(pa.array(hit)), "rep": rep[hit], "links": links[hit], "least": least[hit]})

    types = {f.name: f.dataType.simpleString() for f in c.schema}
    fields = f"label {types['label']}, dim int, i int, j int, digest string, rep long, m long, links long, least long, doubt boolean, at int, partners array<int>"
    first = stage(c.groupBy("label", "dim", "i", "j").applyInArrow(compare, fields), "compared")
    open_ = first.where("doubt").select("label", "dim", "i", "j", "digest", "rep", "m", "at", "partners").join(classes.select("digest", "embedding"), "digest")
    settled = open_.groupBy("label", "dim", "i", "j").applyInArrow(settle, "digest string, rep long, links long, least long")
    found = stage(first.where("links > 0").select("digest", "rep", "links", "least").unionByName(settled), "found")
    groups = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")).unionByName(v.where("digest is not null").join(classes.select("digest", "rep"), "digest").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    each = classes.select("digest", "m").join(links, "digest", "left").select("digest", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = v.select("vec_id", "digest").join(each, "digest", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings, links by a cosine of 0.93 or more within a label.

    Null, empty, zero and non-finite vectors, and rows without label or id, have no links. Equal
    vectors link with each other like any; repeated rows count as vectors of their own. An empty table
    gives no rows. Other columns aren't read.
    """
    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
