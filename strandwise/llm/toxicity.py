"""Toxicity: a two-state linear-chain conditional random field over words, marginals summed up per document.

Documents are labelled, tokens aren't: a clean document's tokens are all labelled 0, a toxic one's
have at least one 1. The field is taught by the likelihood of these constraints, which forward and
backward passes give exactly.
"""

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

WORD = re.compile(r"[^\W\d_]+")
BUCKETS, SAMPLE = 1 << 22, 8000
#: Beginnings and endings of words that are features beside the word itself, by their numbers of letters.
STARTS, ENDS = (4, 5, 6), (4, 5)
WIDTH = 1 + len(STARTS) + len(ENDS)
#: Features that fewer documents have don't count; sequences are taught in segments of so many words; steps, decay of weights, learning rate.
LEAST, SEGMENT, STEPS, DECAY, RATE = 3, 128, 60, 3e-4, 0.1
#: Tokens whose slopes are computed together; all count in every step.
PORTION = 1 << 19


def bucket(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")) % BUCKETS


def features(word: str) -> list[int]:
    """WIDTH buckets: the word in small letters, its beginnings and endings; -1 where the word is no longer than these."""
    w = word.lower()
    parts = ["w" + w] + ["s" + w[:n] if len(w) > n else "" for n in STARTS] + ["e" + w[-n:] if len(w) > n else "" for n in ENDS]
    return [bucket(x) if x else -1 for x in parts]


class Lookup(dict):
    """word -> value, forgotten when there are too many words."""

    def __init__(self, value, most: int = 200_000):
        self.value, self.most = value, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.value(word)
        return out


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where token t of each sequence stands when tokens are sorted by t, then by falling length.

    Returns (order of sequences, first place of each t, number of sequences with a token t).
    """
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), "right")
    return order, np.concatenate([[0], np.cumsum(alive)]), alive


def log_ratios(score: np.ndarray, first: np.ndarray, alive: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log ratios (state 1 against 0) of a batch laid out by layout().

    score: the log potential of state 1 against state 0 at each token; t: 2 x 2 log transitions.
    """
    e = np.exp(t)
    forward, backward = np.empty_like(score), np.zeros_like(score)
    carry = score[: alive[0]] if len(alive) else score
    if len(alive):
        forward[: alive[0]] = carry
    for k in range(1, len(alive)):
        n, at = alive[k], first[k]
        odds = np.exp(np.clip(carry[:n], -30, 30))
        carry = score[at : at + n] + np.log((e[0, 1] + e[1, 1] * odds) / (e[0, 0] + e[1, 0] * odds))
        forward[at : at + n] = carry
    for k in range(len(alive) - 2, -1, -1):
        n, at = alive[k + 1], first[k]
        ahead = first[k + 1]
        odds = np.exp(np.clip(score[ahead : ahead + n] + backward[ahead : ahead + n], -30, 30))
        backward[at : at + n] = np.log((e[1, 0] + e[1, 1] * odds) / (e[0, 0] + e[0, 1] * odds))
    return forward, backward


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def marginals(scores: list[np.ndarray], t: np.ndarray) -> list[np.ndarray]:
    """P(toxic) for every token of every sequence."""
    lengths = np.array([len(s) for s in scores], np.int64)
    order, first, alive = layout(lengths)
    if not len(alive):
        return scores
    flat = np.empty(int(first[-1]))
    places = []
    for rank, i in enumerate(order):
        place = first[: lengths[i]] + rank
        flat[place] = scores[i]
        places.append(place)
    forward, backward = log_ratios(flat, first, alive, t)
    p = sigmoid(forward + backward)
    out: list[np.ndarray] = [np.empty(0)] * len(scores)
    for i, place in zip(order, places):
        out[i] = p[place]
    return out


def summary(p: np.ndarray) -> tuple[float, float, float]:
    """A document's marginals in three numbers: the log odds of its most toxic word, the logs of the expected number of toxic words and of all."""
    top = float(np.clip(p.max(initial=1e-6), 1e-6, 1 - 1e-6))
    return float(np.log(top / (1 - top))), float(np.log(p.sum() + 1e-3)), float(np.log(len(p) + 10.0))


class Tagger:
    """Weights of features, transitions, and the logistic step from a document's marginals to its score."""

    def __init__(self, buckets, weights, bias, transitions, calibration):
        self.weights = dict(zip(map(int, buckets), map(float, weights)))
        self.bias, self.transitions, self.calibration = float(bias), np.asarray(transitions, float), np.asarray(calibration, float)

    def score_of(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word)) + self.bias

    def document_score(self, p: np.ndarray) -> float:
        return float(sigmoid(self.calibration @ np.array([1.0, *summary(p)])))


def without_copies(docs: list[np.ndarray], bands: int = 8, rows: int = 3, least: float = 0.6) -> list[int]:
    """Indices of the documents that aren't near copies (by their sets of words) of an earlier one: copies are one witness.

    Banded minima of the sets give candidates, the sets themselves decide.
    """
    rng = np.random.default_rng(3)
    a = rng.integers(1, 2**32, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    first: dict[tuple, int] = {}
    sets, out = {}, []
    for i, d in enumerate(docs):
        own = np.unique(d)
        if not len(own):
            continue
        minima = ((own.astype(np.uint64) + np.uint64(1)) * a[:, None] >> np.uint64(8)).min(1).reshape(bands, rows)
        keys = [(band, *key) for band, key in enumerate(minima.tolist())]
        met = {first[k] for k in keys if k in first}
        if not any(2 * least * (len(own) + len(sets[j])) / (1 + least) <= 2 * len(np.intersect1d(own, sets[j], assume_unique=True)) for j in met):
            out.append(i)
            sets[i] = own
            for k in keys:
                first.setdefault(k, i)
    return out


class Constrained:
    """Likelihood of document labels and its slopes, for tokens in segments laid out by layout().

    owner: the document of each segment; y: 1 for documents with at least one toxic token, else 0.
    Segments of a document are sequences of their own, so P(no toxic token) is a product over them.
    """

    def __init__(self, lengths: np.ndarray, owner: np.ndarray, y: np.ndarray):
        self.order, self.first, self.alive = layout(lengths)
        self.y, self.docs = y, len(y)
        later = range(1, len(self.alive))
        none = [np.empty(0, np.int64)]
        self.ahead = np.concatenate([np.arange(self.first[k], self.first[k] + self.alive[k]) for k in later] or none).astype(np.int32)
        self.back = np.concatenate([np.arange(self.first[k - 1], self.first[k - 1] + self.alive[k]) for k in later] or none).astype(np.int32)
        self.owner = np.concatenate([owner[self.order[:n]] for n in self.alive] or none).astype(np.int32)

    def places(self) -> list[np.ndarray]:
        """Where the tokens of each segment stand, in the segments' own order."""
        starts, out = self.first, [None] * len(self.order)
        deep = np.searchsorted(-self.alive, -np.arange(1, len(self.order) + 1), "right")  # tokens of the segment of that rank
        for rank, i in enumerate(self.order):
            out[i] = starts[: deep[rank]] + rank
        return out

    def __call__(self, score: np.ndarray, t: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log likelihood of each document's label, slope of -weight * log likelihood by each token's score, and by the transitions).

        Of a toxic document, expectations given at least one toxic token are those without condition
        less what all-clean adds, over P(at least one).
        """
        f, b = log_ratios(score, self.first, self.alive, t)
        p = sigmoid(f + b)
        n = self.alive[0] if len(self.alive) else 0
        step = np.empty_like(score)  # log P(token clean | those before it clean)
        step[:n] = -np.logaddexp(0, score[:n] + b[:n])
        step[self.ahead] = -np.logaddexp(0, t[0, 1] - t[0, 0] + score[self.ahead] + b[self.ahead])
        clean = np.minimum(np.bincount(self.owner, step, self.docs), -1e-9)
        p0 = np.exp(clean)
        some = -np.expm1(clean)
        odds = p0 / some
        by_doc = np.where(self.y == 1, -odds, 1.0) * weight
        slope = p * by_doc[self.owner]
        left, right = f[self.back], score[self.ahead] + b[self.ahead]
        joint = np.stack([np.zeros_like(left) + t[0, 0], right + t[0, 1], left + t[1, 0], left + right + t[1, 1]])
        joint = np.exp(joint - joint.max(0, initial=-np.inf))
        joint /= joint.sum(0)
        whose = self.owner[self.ahead]
        pairs = (joint * by_doc[whose]).sum(1)
        pairs[0] += (np.where(self.y == 1, odds, -1.0) * weight)[whose].sum()
        return np.where(self.y == 1, np.log(some), clean), slope, pairs.reshape(2, 2)


def fit(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, steps: int = STEPS) -> Tagger:
    """Maximise the likelihood of the document labels, toxic and clean ones of equal weight in sum; then fit the document step.

    docs: (which word each token is, the words' 64-bit hashes, the words' features) of each document.
    Near copies count once. Adam over the whole sample; the words' features are summed up once a step
    for each different word.
    """
    if not len(docs) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)  # nothing to tell apart: every document gets the labels' share
        return Tagger([], [], -4.0, np.zeros((2, 2)), [np.log(share / (1 - share)), 0, 0, 0])
    alone = without_copies([d[1].view(np.uint64) >> np.uint64(32) for d in docs])
    docs, y = [docs[i] for i in alone], y[alone]  # those left have words
    if not len(docs) or y.min() == y.max():
        return fit([], y)
    _, rows, inverse = np.unique(np.concatenate([d[1] for d in docs]), return_index=True, return_inverse=True)
    word_features = np.concatenate([d[2] for d in docs])[rows]
    starts = np.cumsum([0, *(len(d[1]) for d in docs)])
    own = [inverse[a:b] for a, b in zip(starts, starts[1:])]
    ids = [o[d[0]] for o, d in zip(own, docs)]

    known, column = np.unique(word_features, return_inverse=True)
    column = column.reshape(word_features.shape)
    seen = np.zeros(len(known), np.int64)
    for o in own:
        seen[np.unique(column[o])] += 1
    used = (seen >= LEAST) & (known >= 0)
    row, slot = np.nonzero(used[column])
    column = column[row, slot]

    portions = []  # (which documents, their likelihood, which word each token is), of about PORTION tokens
    ends = np.cumsum([len(d) for d in ids])
    for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ends // PORTION)) + 1):
        segments = [(i, ids[k][a : a + SEGMENT]) for i, k in enumerate(part) for a in range(0, len(ids[k]), SEGMENT)]
        constrained = Constrained(np.array([len(x) for _, x in segments], np.int64), np.array([i for i, _ in segments], np.int64), y[part])
        tokens = np.empty(sum(len(x) for _, x in segments), np.int32)
        for place, (_, x) in zip(constrained.places(), segments):
            tokens[place] = x
        portions.append((part, constrained, tokens))

    n, share = len(known), y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    theta = np.concatenate([np.zeros(n), [-4.0], np.zeros(4)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        of_word, by_word, rest = np.bincount(row, theta[column], len(rows)) + theta[n], np.zeros(len(rows)), np.zeros(5)
        for part, constrained, tokens in portions:
            _, slope, pairs = constrained(of_word[tokens], theta[n + 1 :].reshape(2, 2), weight[part])
            by_word += np.bincount(tokens, slope, len(rows))
            rest += [slope.sum(), *pairs.ravel()]
        g = np.concatenate([np.bincount(column, by_word[row], n), rest]) / len(y)
        g[:n] += DECAY * theta[:n]
        g[n + 1 :] += 1e-3 * theta[n + 1 :]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    w, bias, t = theta[:n], theta[n], theta[n + 1 :].reshape(2, 2)
    tagger = Tagger(known[used], w[used], bias, t, np.zeros(4))
    by_word = np.bincount(row, w[column], len(rows)) + bias
    x = np.array([(1.0, *summary(p)) for part, _, _ in portions for p in marginals([by_word[ids[k]] for k in part], t)])
    mean, spread = x[:, 1:].mean(0), x[:, 1:].std(0) + 1e-6
    z = np.concatenate([x[:, :1], (x[:, 1:] - mean) / spread], 1)
    c = np.zeros(4)
    for _ in range(50):
        p = sigmoid(z @ c)
        h = (z * (weight * p * (1 - p))[:, None]).T @ z / len(y) + 1e-3 * np.eye(4)
        c -= np.linalg.solve(h, z.T @ (weight * (p - y)) / len(y) + 1e-3 * c)
    tagger.calibration = np.array([c[0] - (c[1:] * mean / spread).sum(), *(c[1:] / spread)])
    return tagger


def encoded(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text for fit(): which of its different words each word is, these words' 64-bit hashes, and their features."""
    place: dict[str, int] = {}
    index = np.array([place.setdefault(w.lower(), len(place)) for w in WORD.findall(text)], "<i4")
    hashes = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in place], "<u8").view("<i8")
    return index, hashes, np.array([features(w) for w in place], "<i4").reshape(len(place), WIDTH)


def trained(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Tagger:
    """A tagger from at most `most` labelled rows outside the held-out fold; only hashed words of these reach the driver.

    Null and empty texts have no words and teach nothing; repeated rows and near copies count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [encoded((x.as_py() or b"").decode("utf-8", "replace")) for x in batch.column(1)]
            columns = [pa.array([p[i].tobytes() for p in parts], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2)], ["doc_id", "tokens", "words", "features", "y"])

    chosen = sample(docs, labels.where("toxic in (0, 1)"), "toxic", most).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("y", F.col("y").cast("int"))
    rows = chosen.mapInArrow(lean("toxicity", run), "doc_id long, tokens binary, words binary, features binary, y int").toArrow()
    rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "tokens", "words", "y")]).combine_chunks()
    read = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
    parts = zip(*(rows.column(c) for c in ("tokens", "words", "features")))
    return fit([(read(a, "<i4"), read(b, "<i8"), read(c, "<i4").reshape(-1, WIDTH)) for a, b, c in parts], rows.column("y").to_numpy().astype(float))


def tag(docs: DataFrame, tagger: Tagger, threshold: float = 0.5, together: int = 2048) -> DataFrame:
    """The columns of docs but text, then score and spans (start, end, p): words with a marginal of `threshold` or more.

    Every row is tagged, repeated ones alike; a word at exactly the threshold is in. An empty table
    gives no rows. Offsets are code points of the whole text. A null or empty text has no words: no span and the
    score of a document without toxic words. score and spans replace columns of these names.
    """
    others = [c for c in docs.columns if c not in ("text", "score", "spans")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = Lookup(model.score_of)
        for whole in batches:
            for at in range(0, whole.num_rows, together):
                batch = whole.slice(at, together)
                texts = [x or "" for x in batch.column(len(others)).to_pylist()]
                scores = [np.array([known[w] for w in WORD.findall(x)]) for x in texts]
                score, spans = [], []
                for text, p in zip(texts, marginals(scores, model.transitions)):
                    score.append(model.document_score(p))
                    bad = p >= threshold
                    spans.append([{"start": m.start(), "end": m.end(), "p": float(q)} for m, q, b in zip(WORD.finditer(text), p, bad) if b] if bad.any() else [])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(score, pa.float64()), pa.array(spans, kind)], [*others, "score", "spans"])

    return docs.select(*others, "text").mapInArrow(lean("toxicity", run), f"{fields}, score double, spans array<struct<start:long,end:long,p:double>>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans for every row of documents.

    Null, empty and wordless texts have no span and the score of a document without toxic words. Very
    long texts are tagged whole. Repeated rows get the same score; a null doc_id isn't held out. Without
    labels, or with one value of them, every score is the labels' share. An empty table gives no rows.
    Other columns aren't read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tag(docs, trained(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
