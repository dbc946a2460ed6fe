"""Rows that stress the operators: shared ids, clashing columns, hot keys, draws; and the pipeline's whole run by hand."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandwise.llm import embedding_dedup, fingerprint, labelled, mixing, near_dedup, packing, pii, quality, toxicity, url_filter
from test_free import best_fit, labelled_texts, links_by_hand, sets_of
from test_pipeline import corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


# --- mixing


def test_shards_draw_their_counts(spark):
    d = spark.createDataFrame([(i, "w " * 640, f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    places = mixing.placed(d)
    targets = mixing.source_targets(places)
    counts = mixing.draws(targets, 64, 8).collect()
    slots = Counter()
    for r in counts:
        slots[r["skey"]] += r["n_slots"]
    want = {r["skey"]: round(r["target"] / 64) for r in targets.collect()}
    assert all(abs(slots[s] - n) <= 1 for s, n in want.items()) and len(counts) == 24
    for s in slots:  # multinomial over 8 shards: chi-square of 7 degrees of freedom
        own = [r["n_slots"] for r in counts if r["skey"] == s]
        assert 0.3 < sum((x - slots[s] / 8) ** 2 / (slots[s] / 8) for x in own) < 30 and len(set(own)) > 1
    mix = mixing.mix(places, targets, 64, 8).select("skey", "shard", "slot", "block").distinct().collect()
    assert Counter((r["skey"], r["shard"]) for r in mix) == {(r["skey"], r["shard"]): r["n_slots"] for r in counts}
    assert len({(r["skey"], r["slot"]) for r in mix}) == len(mix)
    blocks = Counter((r["skey"], r["block"]) for r in mix)
    assert max(blocks.values()) <= 3


def test_mixing_shows_the_shards_of_a_document(spark, tables, docs, empty):
    tables(mixing, documents=docs)
    for r in mixing.op1_mixing(spark, "").collect():
        assert bool(r["shards"]) == (r["taken"] > 0) and r["shards"] == sorted(set(r["shards"]))
    tables(mixing, documents=empty)
    assert mixing.op1_mixing(spark, "").count() == 0


def test_mixed_documents_keep_columns_of_any_name(spark, docs):
    odd = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ("_mix_id", "_MIX_hash", "_mix_from_", "bucket", "skey")})
    out = mixing.mixed_documents(odd, block=50)
    assert out.columns == odd.columns and out.count() > 0
    assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in ("_mix_id", "_MIX_hash", "_mix_from_", "bucket", "skey"))


# --- fingerprints


def test_next_of_equal_and_missing_keys(spark):
    rows = [(None, f"{i:03d}" + "x" * 70) for i in range(150)] + [(7, f"{i:03d}") for i in range(150)] + [(i, "a") for i in range(20)] + [(None, "same")] * 30
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame([(k, t, t) for k, t in rows], "doc_id long, text string, _key string").repartition(5)
    got = fingerprint.with_next(d, "doc_id", ["text"], ["text"], per_bucket=8).collect()
    order = sorted((k is None, k or 0, t) for k, t in rows)
    want = Counter((None if n else k, t, order[(i + 1) % len(order)][2]) for i, (n, k, t) in enumerate(order))
    assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in got) == want and all(r["_key"] == r["text"] for r in got)
    few = fingerprint.with_next(d, "doc_id", ["text"], ["text"], per_bucket=8, buckets=1, most_rows=16).collect()
    assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in few) == want


def test_fingerprints_of_nothing(spark, tables, empty):
    tables(fingerprint, documents=empty)
    assert fingerprint.op2_fingerprint(spark, "").count() == 0


# --- embeddings


def test_links_about_the_threshold_and_shared_ids(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    base /= np.sqrt(base @ base)
    rows = []
    for i in range(60):  # cosines to the first all about 0.93, far inside the codes' error
        side = rng.normal(size=16)
        side -= (side @ base) * base
        side /= np.sqrt(side @ side)
        c = 0.93 + (i - 30) * 1e-5
        rows.append((i, (c * base + np.sqrt(1 - c * c) * side).tolist(), 1))
    rows += [(100, base.tolist(), 1), (100, (-base).tolist(), 1), (101, (base * 3).tolist(), 1), (3, rows[5][1], 2), (102, rows[5][1], 2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = links_by_hand([r for r in d.collect() if r["vec_id"] not in (100, 3)])
    some = d.where("vec_id not in (100, 3)")
    for tile in (8, 1024):
        out = embedding_dedup.near_vectors(some, tile=tile).withColumn("kept", F.col("vec_id") == F.col("component_id"))
        assert sorted((tuple(r) for r in out.collect()), key=repr) == want
        both = embedding_dedup.near_vectors(d, tile=tile).collect()
        assert len(both) == len(rows)
        one = {r["component_id"] for r in both if r["vec_id"] == 100}
        assert len(one) == 1 and next(iter(one)) <= 100


# --- near copies


def test_rows_that_share_an_id_stay_or_go_by_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (1, a), (2, a), (3, c), (3, c + " more"), (None, a), (None, a)]
    out = [(r["doc_id"], r["text"]) for r in near_dedup.deduplicated(frame(spark, rows)).collect()]
    assert sorted(out, key=repr) == sorted([(1, a), (1, b), (3, c), (3, c + " more"), (None, a), (None, a)], key=repr)
    odd = frame(spark, rows).withColumn("_place", F.lit(9))
    assert near_dedup.deduplicated(odd).columns == odd.columns and {r["_place"] for r in near_dedup.deduplicated(odd).collect()} == {9}


def test_hub_texts_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "FAN", 4)
    texts = spark.createDataFrame([(i, f"t{i}".encode()) for i in range(40)], "doc_id long, data binary")
    pairs = [(i, 0) for i in range(1, 30)] + [(39, i) for i in range(20)]
    out = near_dedup.with_texts(spark.createDataFrame(pairs, "a long, b long"), texts)
    assert sorted((r["a"], r["b"], bytes(r["data_a"]), bytes(r["data_b"])) for r in out.collect()) == sorted((a, b, b"t%d" % a, b"t%d" % b) for a, b in pairs)


def test_small_tiles_lose_no_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "WEIGHT", 200)
    rng = random.Random(6)
    rows = []
    for f in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(180)]  # two members: 166 shingles alike of 186
        for m in range(6):
            own = words.copy()
            own[10 * m + 5] = f"x{m}"
            rows.append((100 * f + m, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(frame(spark, rows), rounds=1).collect()}
    assert all(got[i] == i // 100 * 100 for i, _ in rows)


def test_recall_at_the_threshold(spark):
    """Pairs whose likeness is just what is asked for: the signatures' distance threshold and keys find all of 300."""
    rng = random.Random(8)
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(10**7)}" for _ in range(404)]
        other = words.copy()
        for at in (50, 120, 190, 260, 330, 390):  # 6 words of 400 shingles: 370 alike of 430, 86 %
            other[at] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(frame(spark, rows)).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(300)) >= 299


# --- toxicity


def test_constraints_by_enumeration():
    rng = np.random.default_rng(5)
    t = rng.normal(size=(2, 2))
    docs = [[rng.normal(size=n) for n in sizes] for sizes in ((1,), (3,), (2, 3), (4, 1), (5,))]
    y, weight = np.array([0.0, 1, 1, 0, 1]), np.array([1.0, 2, 0.5, 1, 3])
    lengths = np.array([len(s) for d in docs for s in d])
    owner = np.array([i for i, d in enumerate(docs) for _ in d])
    c = toxicity.Constrained(lengths, owner, y)
    segments = [s for d in docs for s in d]
    flat = np.empty(lengths.sum())
    for place, s in zip(c.places(), segments):
        flat[place] = s

    def plain(segments, t):
        out = []
        for i, label in enumerate(y):
            clean = 1.0
            for s in (s for s, o in zip(segments, owner) if o == i):
                total = sum(np.exp(sum(x * b for x, b in zip(s, bits)) + sum(t[p, q] for p, q in zip(bits, bits[1:]))) for bits in itertools.product((0, 1), repeat=len(s)))
                clean *= np.exp(t[0, 0] * (len(s) - 1)) / total
            out.append(np.log(1 - clean) if label else np.log(clean))
        return np.array(out)

    found, slope, pairs = c(flat, t, weight)
    assert np.allclose(found, plain(segments, t))
    loss = lambda s, t: -(weight * plain(s, t)).sum()
    for k, (place, s) in enumerate(zip(c.places(), segments)):
        for j in range(len(s)):
            up, down = ([x.copy() for x in segments] for _ in range(2))
            up[k][j] += 1e-5
            down[k][j] -= 1e-5
            assert abs((loss(up, t) - loss(down, t)) / 2e-5 - slope[place[j]]) < 1e-5
    for a, b in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[a, b] = 1e-5
        assert abs((loss(segments, t + step) - loss(segments, t - step)) / 2e-5 - pairs[a, b]) < 1e-5


def test_beginnings_of_words_teach(spark):
    rng = random.Random(9)
    part = lambda: "".join(rng.choice(["ba", "ku", "re", "to", "mi", "la"]) for _ in range(4))
    rows, labels = [], []
    for i in range(700):
        w, toxic = [part() for _ in range(rng.randrange(10, 60))], rng.random() < 0.3
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), "scorn" + part())  # no such word twice, but one beginning
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    d, y = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.tag(d, toxicity.trained(d, y)).collect()}
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum(out[i] == bool(t) for i, t in held) >= 0.95 * len(held)


def test_very_long_and_odd_texts(spark, tables):
    rows, labels = labelled_texts(200)
    odd = [(9000, "word " * 60_000), (9001, "x" * 200_000), (9002, "\n" * 1000), (9003, "漢" * 5000), (None, "nasty")]
    d = frame(spark, [(r[0], r[1]) for r in rows] + odd)
    y = spark.createDataFrame([(i, int(g > 1), t) for i, g, t in labels], "doc_id long, quality int, toxic int")
    for module, query in ((toxicity, toxicity.op5_toxicity), (quality, quality.op6_quality_classifier)):
        tables(module, documents=d, labels=y)
        assert query(spark, "").count() == d.count()
    tables(near_dedup, documents=d)
    assert {r["doc_id"]: r["n_shingles"] for r in near_dedup.op8_near_dedup(spark, "").collect() if r["doc_id"] in (9000, 9001, 9002, 9003)} == {9000: 1, 9001: 1, 9002: 0, 9003: 1}


# --- quality


def test_probabilities_are_those_of_the_labelled_rows(spark):
    """Texts without any sign of their grade: the probability is the share of grades, though the sample is even."""
    d = frame(spark, [(i, "the same words for all") for i in range(3000)])
    y = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    weights = labelled.sample(d, y, "quality", 100).groupBy("y").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    free = Counter(float(i % 10 > 0) for i in range(3000) if zlib.crc32(str(i).encode()) % 5)
    assert {r["y"]: round(r["w"], 6) for r in weights} == free and all(r["n"] == 50 for r in weights)
    tail = quality.grade(d.limit(1), quality.trained(d, y, most=100)).first()["tails"][0]
    assert abs(tail - 0.9) < 0.05


def test_quality_query_by_hand(spark, tables):
    rows, labels = labelled_texts(300)
    d = frame(spark, [(r[0], r[1]) for r in rows])
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tables(quality, documents=d, labels=y)
    model = quality.trained(d, y)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    text = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    for r in quality.op6_quality_classifier(spark, "").collect():
        ids, values = quality.vector(text[r["doc_id"]].encode())
        tails = [sigmoid(float(model.w[ids] @ values) - cut) for cut in model.cuts]
        assert abs(r["p_above_lowest"] - tails[0]) < 1e-5 and abs(r["expected_grade"] - sum(tails)) < 1e-4 and r["kept"] == (r["p_above_lowest"] >= 0.5)


# --- urls


def test_many_urls_without_host(spark, tables):
    pages = spark.createDataFrame([(i, None if i % 3 else "no scheme", "h") for i in range(500)] + [(1000, "http://a.net/", "h")], "page_id long, url string, html string")
    tables(url_filter, pages=pages)
    got = Counter((r["host"], r["rule"], r["verdict"]) for r in url_filter.op9_url_filter(spark, "").collect())
    assert got == {("", None, "allow"): 500, ("a.net", "net/", "block"): 1}


# --- the whole pipeline


def groups_at(rows, percent):
    """{doc_id: smallest doc_id reachable} by all pairs."""
    root = {r["doc_id"]: r["doc_id"] for r in rows if r["doc_id"] is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(r["doc_id"], sets_of(r["text"])) for r in rows if r["doc_id"] is not None]
    for (i, s), (j, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((top(i), top(j)))
            root[y] = x
    return {i: top(i) for i in root}


def redacted(text, added):
    spans = sorted((s, e, pii.KINDS[k]) for k, s, e in pii.base_spans(text or "")) if text else []
    assert not added
    end, parts = 0, []
    for s, e, k in spans:
        if e > end:
            parts += [text[end:s], f"<{k}>"] if s >= end else []
            end = e
    return "".join([*parts, text[end:]]) if spans else text


def test_run_by_hand(spark, tmp_path):
    """run() on rows: graded, of each group at 80 % one, redacted, mixed and packed, each step done plainly."""
    folder = str(tmp_path)
    docs = corpus(spark, folder)
    rows = docs.collect()
    model = quality.trained(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = []
    for r in rows:
        ids, values = quality.vector((r["text"] or "").encode())
        if model.w[ids] @ values - model.cuts[0] >= 0:
            kept.append(r)
    groups = groups_at(kept, 80)
    one = {(r["doc_id"], r["text"]): r for r in kept if r["doc_id"] is not None and groups[r["doc_id"]] == r["doc_id"]}
    alone = [*one.values(), *(r for r in kept if r["doc_id"] is None)]
    assert len(alone) < len(kept) < len(rows)
    clean = [(r["doc_id"], redacted(r["text"], pii.added_candidates(r["text"] or "", pii.base_spans(r["text"] or ""))), r["source"]) for r in alone]

    got = corpus_pipeline.run(spark, folder).collect()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    left = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in clean], SCHEMA)
    encoder = packing.Encoder(packing.vocabulary_path())
    want = Counter()
    for r in mixing.mixed_documents(left).collect():
        ids = encoder.whole(r["text"]) + np.array([0], "<u4").tobytes()
        for p, s in enumerate(range(0, len(ids), 4 * 2048)):
            part = ids[s : s + 4 * 2048]
            want[r["doc_id"], p, s // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert {i for i, t, _ in clean if word.findall(t or "")} >= {r["doc_id"] for r in got}
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) == best_fit([r["length"] for r in got], 2048)


@pytest.mark.parametrize("percent", [80, 85])
def test_stage_groups_at_its_threshold(spark, percent):
    rows, _ = labelled_texts(120)
    rng = random.Random(2)
    near = []
    for i, t, *_ in rows:
        w = (t or "").split()
        if len(w) > 60:
            for at in rng.sample(range(len(w)), rng.choice([1, 2, 3])):
                w[at] = "other"
            near.append((9000 + i, " ".join(w)))
    d = frame(spark, [(r[0], r[1]) for r in rows] + near)
    want = groups_at(d.collect(), percent)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(d, percent=percent).collect()} == want
