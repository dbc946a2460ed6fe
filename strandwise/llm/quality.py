"""Quality classifier: ordinal cumulative-link regression on graded ratings, hashed-text features."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .shared import lean, table
from .toxicity import Lookup, sigmoid

BUCKETS, SAMPLE = 1 << 18, 8000
CAPITAL, SMALL, DIGIT, MARK = (bytes(x) for x in (range(65, 91), range(97, 123), range(48, 58), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
SHAPE = bytes.maketrans(CAPITAL + SMALL + DIGIT, b"A" * 26 + b"a" * 26 + b"0" * 10)
RUN = re.compile(rb"(.)\1+", re.S)
HIGH = re.compile(rb"[\x80-\xff]+")
#: Words of more than LONG bytes count as pieces of up to 24 bytes, cut between characters.
LONG = 64
PIECE = re.compile(rb".{1,21}[\x80-\xbf]{0,3}", re.S)


def bucket(name: bytes) -> int:
    return xxhash.xxh3_64_intdigest(name) % BUCKETS


def word_buckets(word: bytes) -> tuple[int, ...]:
    """The word in small letters, its shape (Aa0 runs and marks), and its marks alone."""
    small = word.lower()
    shape = RUN.sub(rb"\1", HIGH.sub(b"a", word.translate(SHAPE)))
    return bucket(b"w" + small), bucket(b"s" + shape), bucket(b"m" + RUN.sub(rb"\1", HIGH.sub(b"", word.translate(None, CAPITAL + SMALL + DIGIT))))


def pieces(words: list[bytes]) -> list[bytes]:
    """The words, those of more than LONG bytes as pieces that all count."""
    if not words or len(max(words, key=len)) <= LONG:
        return words
    return [p for w in words for p in (PIECE.findall(w) if len(w) > LONG else (w,))]


def text_buckets(data: bytes, words: list[bytes]) -> list[int]:
    """Binned figures of the whole text: capitals, digits, marks, repeated words and lines, word length, size."""
    n, size = len(words), max(1, len(data))
    lines = [x for x in data.split(b"\n") if x]
    figures = {
        b"capital": (size - len(data.translate(None, CAPITAL))) / size, b"digit": (size - len(data.translate(None, DIGIT))) / size, b"mark": (size - len(data.translate(None, MARK))) / size,
        b"new": len(set(words)) / max(1, n), b"line": len(set(lines)) / max(1, len(lines)), b"width": min(1.0, size / max(1, n) / 20), b"size": min(1.0, np.log1p(n) / 12),
    }
    return [bucket(b"f%s%d" % (k, int(v * 20 + 1e-9))) for k, v in figures.items()]


class Model:
    """P(grade > k) = sigmoid(x . w - cut[k]): one weight vector for all grades, ascending cuts between them."""

    def __init__(self, grades, w, cuts):
        self.grades, self.w, self.cuts = list(grades), np.asarray(w, np.float32), np.asarray(cuts, float)

    def __getstate__(self):
        at = np.flatnonzero(self.w)
        return self.grades, at, self.w[at], self.cuts

    def __setstate__(self, state):
        self.grades, at, values, self.cuts = state
        self.w = np.zeros(BUCKETS, np.float32)
        self.w[at] = values

    def tails(self, score: np.ndarray) -> np.ndarray:
        return sigmoid(np.asarray(score)[:, None] - self.cuts[None, :])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-6, weight: np.ndarray | None = None) -> Model:
    """Maximum likelihood of the cumulative logit model by Adam; rows are (buckets, values) of each document.

    weight: how many rows each one stands for (all the same, if not given).

    The cuts are the first one plus running sums of exponentials, hence always in order.
    """
    grades = sorted(set(y.tolist()))
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(BUCKETS), [])
    rank = np.searchsorted(grades, y)
    ids, index = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    k = len(grades) - 1
    mass = np.ones(len(rows)) if weight is None else np.asarray(weight, float)
    mass = mass / mass.sum()
    share = np.clip([mass[rank > i].sum() for i in range(k)], 1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    theta = np.concatenate([np.zeros(len(ids)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    every = np.arange(len(rows))
    for step in range(1, steps + 1):
        w, gaps = theta[: len(ids)], np.exp(theta[len(ids) + 1 :])
        cuts = theta[len(ids)] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(row, w[index] * value, len(rows))
        above = np.concatenate([np.ones((len(rows), 1)), sigmoid(score[:, None] - cuts[None, :]), np.zeros((len(rows), 1))], 1)
        slope = above * (1 - above)
        p = np.maximum(above[every, rank] - above[every, rank + 1], 1e-12)
        by_score = -(slope[every, rank] - slope[every, rank + 1]) / p * mass
        by_cut = np.zeros(k + 2)
        np.add.at(by_cut, rank, slope[every, rank] / p * mass)
        np.add.at(by_cut, rank + 1, -slope[every, rank + 1] / p * mass)
        by_cut = by_cut[1:-1]
        g = np.concatenate([np.bincount(index, by_score[row] * value, len(ids)) + decay * w, [by_cut.sum()], np.cumsum(by_cut[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w = np.zeros(BUCKETS)
    w[ids] = theta[: len(ids)]
    cuts = theta[len(ids)] + np.concatenate([[0], np.cumsum(np.exp(theta[len(ids) + 1 :]))])
    return Model(grades, w, cuts)


def vector(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A document as (buckets, values): the share of its words (or their pieces) with each word bucket, and 1 for each figure."""
    words = data.split()
    parts = pieces(words)
    own = np.array([b for w in parts for b in word_buckets(w)], np.int64)
    ids, n = np.unique(own, return_counts=True)
    figures = np.array(text_buckets(data, words), np.int64)
    return np.concatenate([ids, figures]), np.concatenate([n / max(1, len(parts)), np.ones(len(figures))])


def trained(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = SAMPLE) -> Model:
    """A model from at most `most` labelled rows outside the held-out fold; the driver gets their hashed features.

    The sample is even over the grades; each row weighs as many rows as it stands for, so that
    probabilities are those of the labelled rows and not of the sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [vector(x.as_py() or b"") for x in batch.column(1)]
            columns = [pa.array([a.astype("<i4").tobytes() for a, _ in both], pa.binary()), pa.array([b.astype("<f4").tobytes() for _, b in both], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2), batch.column(3)], ["doc_id", "ids", "values", "y", "weight"])

    chosen = sample(docs, labels, column, most).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = sorted(chosen.mapInArrow(lean("quality", run), "doc_id long, ids binary, values binary, y double, weight double").collect())
    vectors = [(np.frombuffer(bytes(r["ids"]), "<i4").astype(np.int64), np.frombuffer(bytes(r["values"]), "<f4").astype(float)) for r in rows]
    return fit(vectors, np.array([r["y"] for r in rows]), weight=np.array([r["weight"] for r in rows]))


class Scorer:
    """Scores of texts under a model; remembers words."""

    def __init__(self, model: Model):
        self.model = model
        self.words = Lookup(lambda w: float(model.w[list(word_buckets(w))].sum()))
        self.figures = Lookup(lambda b: float(model.w[b]))

    def tails(self, texts: pa.Array) -> np.ndarray:
        score = np.empty(len(texts))
        for i, x in enumerate(texts):
            data = (x.as_py() or "").encode("utf-8", "replace")
            words = data.split()
            parts = pieces(words)
            score[i] = sum(map(self.words.__getitem__, parts)) / max(1, len(parts)) + sum(map(self.figures.__getitem__, text_buckets(data, words)))
        return self.model.tails(score)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus expected_grade and tails (for each grade but the lowest, the probability of it or better).

    These replace columns of the same names; every row, repeated ones too, has its own. Null text counts as empty: no words, only the figures of
    an empty text.
    """
    docs = docs.drop("expected_grade", "tails")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        grades = scorer.model.grades
        steps = np.diff(grades)
        for batch in batches:
            tails = scorer.tails(batch.column(at))
            expected = grades[0] + tails @ steps if len(steps) else np.full(len(tails), float(grades[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(list(tails), pa.list_(pa.float64()))], [*batch.schema.names, "expected_grade", "tails"])

    return docs.mapInArrow(lean("quality", run), f"{fields}, expected_grade double, tails array<double>")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, columns unchanged, whose probability of more than the lowest grade is `least` or more (all, if the model knows but one grade)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            tails = scorer.tails(batch.column(at))
            yield batch.filter(pa.array(tails[:, 0] >= least)) if tails.shape[1] else batch

    return docs.mapInArrow(lean("quality", run), docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, expected_grade, p_above_lowest, kept for every row of documents.

    Null, empty and wordless texts are graded by the figures of an empty text. Very long texts, and
    words of any length, count whole. Repeated rows get the same grade; a null doc_id isn't held out; a
    probability of exactly one half is kept. Without labels, or with one grade, every row is kept. An
    empty table gives no rows. Other columns aren't read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = grade(docs, trained(docs, table(spark, sf_dir, "labels")))
    tail = F.coalesce(F.get("tails", F.lit(0)), F.lit(1.0))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", tail.alias("p_above_lowest"), (tail >= 0.5).alias("kept"))
