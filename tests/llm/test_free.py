import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from strandwise.llm import embedding_dedup, near_dedup, packing, pii, quality, toxicity
from strandwise.llm.labelled import held_out
from strandwise.llm.shingles import MinHash, overlap, shingle_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- packing


def best_fit(lengths, size):
    """Number of sequences of best-fit decreasing, item by item."""
    room = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= x
        else:
            room.append(size - x)
    return len(room)


@pytest.mark.parametrize("which", ["docs", "repeated", "empty"])
def test_packing(spark, tables, request, which):
    import public_tokenizers
    from tokenizers import Tokenizer

    frame = request.getfixturevalue(which)
    tables(packing, documents=frame)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = [], 0
    for r in frame.collect():
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        want += [(r["doc_id"], p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    got = packing.op4_best_fit_packing(spark, "").collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by_sequence) == best_fit([r["length"] for r in got], 2048) and -(-total // 2048) <= len(by_sequence)


def test_plan_is_best_fit(spark):
    rng = random.Random(1)
    for _ in range(60):
        size = rng.choice([10, 50, 300])
        h = {}
        for _ in range(rng.choice([1, 5, 200])):
            x = rng.randint(1, size)
            h[x] = h.get(x, 0) + rng.choice([1, 1, 3, 50])
        bins = {}
        for length, rank, count, first, offset in packing.plan(h, size):
            for i in range(count):
                bins.setdefault(first + i, []).append((offset, length, rank + i))
        items = sorted((length, rank) for b in bins.values() for _, length, rank in b)
        assert items == sorted((x, i) for x, n in h.items() for i in range(n))
        for b in bins.values():
            end = 0
            for offset, length, _ in sorted(b):
                assert offset == end
                end += length
            assert end <= size
        assert len(bins) == best_fit([x for x, n in h.items() for _ in range(n)], size)


def test_encoder_equals_library():
    e = packing.Encoder(packing.vocabulary_path(), most=50)
    texts = ["", None, "a", "It's they're I'll 12'345", "ÀÉß ñandú L'été — “x”", "x\x85y z\xa0w", "<|endoftext|> a", "é İ ﬁ 漢字", "a'sb''s's 's", "!!??%%% foo%%%bar", "x" * 5000, "1 2 3 4567", "\x00\x1f a\x7f", "µ ª ²", "tab\tnew\nline\r\n"]
    for _ in range(2):
        assert e.batch(texts) == [e.whole(x or "") for x in texts]


# --- embeddings


def links_by_hand(rows, threshold=0.93):
    ok = []
    for r in rows:
        v = r["embedding"]
        good = v is not None and r["label"] is not None and r["vec_id"] is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None)
    near = [[i for i in range(len(rows)) if i != j and ok[i] is not None and ok[j] is not None and rows[i]["label"] == rows[j]["label"] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= threshold] for j in range(len(rows))]
    out = []
    for j, r in enumerate(rows):
        seen, todo = {j}, [j]
        while todo:
            for i in near[todo.pop()]:
                if i not in seen:
                    seen.add(i)
                    todo.append(i)
        least = min((rows[i]["vec_id"] for i in seen if rows[i]["vec_id"] is not None), default=None)
        out.append((r["vec_id"], len(near[j]), least, None if least is None else least == r["vec_id"]))
    return sorted(out, key=repr)


def test_embedding_links(spark, tables):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(220):
        v = centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)), "clash"))
    rows += [(500, rows[0][1], rows[0][2], ""), (501, [x * 2 for x in rows[0][1]], rows[0][2], ""), (502, None, 1, ""), (503, [0.0] * 16, 1, ""), (504, [float("nan")] * 16, 1, ""), (505, rows[1][1], None, ""), (506, [], 1, "")]
    rows += [(507, rows[0][1][:8], rows[0][2], ""), (508, [None, *rows[0][1][1:]], 0, ""), (509, [1e-30] * 16, 1, ""), (510, [1e30] * 16, 1, ""), (511, [float("inf")] + [1.0] * 15, 1, ""), (None, None, None, None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    tables(embedding_dedup, embeddings=d)
    assert sorted((tuple(r) for r in embedding_dedup.op7_embedding_dedup(spark, "").collect()), key=repr) == links_by_hand(d.collect())
    small = embedding_dedup.near_vectors(d, tile=16).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in small), key=repr) == [x[:3] for x in links_by_hand(d.collect())]
    tables(embedding_dedup, embeddings=d.limit(0))
    assert embedding_dedup.op7_embedding_dedup(spark, "").count() == 0


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(300, 24)) * rng.choice([1, 100], (300, 24))
    u /= np.linalg.norm(u, axis=1)[:, None]
    q, s, e = embedding_dedup.quantised(u)
    near = (q.astype(int) @ q.T.astype(int)) * s[:, None] * s[None, :]
    assert (np.abs(u @ u.T - near) <= e[:, None] + (1 + e[:, None]) * e[None, :]).all()
    for t in (0.2, 0.6):
        i, j = embedding_dedup.linked(u, u, t, True)
        assert {*zip(i.tolist(), j.tolist())} == {(a, b) for a in range(300) for b in range(a + 1, 300) if u[a] @ u[b] >= t}


# --- near copies


def sets_of(text):
    w = ["".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups_by_hand(rows):
    ids = sorted({r["doc_id"] for r in rows if r["doc_id"] is not None})
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(r["doc_id"], sets_of(r["text"])) for r in rows if r["doc_id"] is not None]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return sorted(((r["doc_id"], len(sets_of(r["text"])), None if r["doc_id"] is None else top(r["doc_id"])) for r in rows), key=repr)


def families(spark):
    """Copies with 0 to 25 % of their words changed: pairs on both sides of the threshold, in chains and in crowds."""
    rng = random.Random(2)
    rows, n = [], 0
    for family in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 300]))]
        for _ in range(40):
            w = list(base)
            for _ in range(int(len(w) * rng.choice([0, 0.005, 0.01, 0.02, 0.04, 0.08]))):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
            rows.append((n, " ".join(w).upper() if rng.random() < 0.2 else "\t".join(w)))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("which", ["docs", "repeated", "families"])
def test_near_groups(spark, tables, request, which):
    frame = families(spark) if which == "families" else request.getfixturevalue(which)
    tables(near_dedup, documents=frame)
    got = near_dedup.op8_near_dedup(spark, "").collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == groups_by_hand(frame.collect())
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_near_groups_of_nothing(spark, tables, empty):
    tables(near_dedup, documents=empty)
    assert near_dedup.op8_near_dedup(spark, "").count() == 0


def test_deduplicated(spark, repeated):
    out = near_dedup.deduplicated(repeated)
    assert out.columns == repeated.columns
    want = {g for i, _, g in groups_by_hand(repeated.collect()) if i is not None}
    got = [r["doc_id"] for r in out.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 2


def test_signature_guarantee(spark):
    """All pairs of signatures that differ in at most 15 of the keyed slots share a key."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        base = rng.integers(0, 2**16, near_dedup.KEYED, dtype=np.uint16)
        other = base.copy()
        at = rng.choice(near_dedup.KEYED, 15, replace=False)
        other[at] += np.uint16(1)
        rows += [(2 * i, base.tobytes()), (2 * i + 1, other.tobytes())]
    keys = near_dedup.chunk_keys(spark.createDataFrame([(i, bytearray(s)) for i, s in rows], "doc_id long, sig binary")).collect()
    by_key = {}
    for r in keys:
        by_key.setdefault(r["key"], set()).add(r["doc_id"])
    found = {tuple(sorted(v)) for v in by_key.values() if len(v) > 1}
    assert found == {(2 * i, 2 * i + 1) for i in range(60)}


def test_minhash_estimates():
    a, b = (shingle_set(" ".join(f"w{i}" for i in r).encode()) for r in (range(1000), range(80, 1080)))
    m = MinHash(256, 64)
    x, y = np.frombuffer(m(a), np.uint8), np.frombuffer(m(b), np.uint8)
    true = overlap(a, b) / (len(a) + len(b) - overlap(a, b))
    assert abs((x[128:] == y[128:]).mean() - true) < 0.12


# --- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def base_by_hand(text):
    d = lambda m: re.sub("[^0-9]", "", m[0])
    return (
        [("email", *m.span()) for m in EMAIL.finditer(text)]
        + [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        + [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d(m)) <= 19 and luhn(d(m))]
        + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(d(m)) <= 15]
    )


def odd_texts():
    rng = random.Random(6)
    alphabet = ["a", "b.", "@", ".", "-", "+1", "+", " ", "0", "1", "255", "256", "10.0.0.1", "4111 1111 1111 1111", "4111111111111111", "(523) 555-1055", "x@y.z", "@@", "a@b", "\n", "é", "漢", "token = \"f33e61083db5dbdf4bd2369d2f80176e57f7fda2\"", "me (at) home (dot) org", "523-555-1055"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)]
    return out + ["", "@", "a@b.c@d.e", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "001.002.003.004", "+12345678", "+1" + " " * 50, "a" * 100_000 + "@", "1" * 100_000, "1.1.1 " * 20_000, "+1 ." * 20_000, "a@" * 50_000]


def test_base_spans():
    for text in odd_texts():
        if len(text) < 5000:
            assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)] == base_by_hand(text), text
        else:
            pii.base_spans(text)


def test_pii_query(spark, tables):
    texts = odd_texts()[:150] + [None, "", "漢字 a@b.org"]
    d = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0, 0), (None, "x a@b.org", 0, 0)], "doc_id long, text string, start int, kind int")
    tables(pii, documents=d)
    got = sorted(pii.op3_pii(spark, "").collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    rows = sorted(d.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    for r, row in zip(got, rows, strict=True):
        base = base_by_hand(row["text"] or "")
        joined = ",".join("%s:%d:%d" % x for x in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in base) for k in pii.BASE]
    assert any("secret:" in r["spans"] for r in got)
    tables(pii, documents=d.limit(0))
    assert pii.op3_pii(spark, "").count() == 0


def test_redaction(spark, docs, empty):
    clean = spark.createDataFrame([(1, "write a@b.org, call +1 (523) 555-1055; token = \"f33e61083db5dbdf4bd2369d2f80176e57f7fda2\" é", "en", "s", 0), (2, None, "en", "s", None), (3, "nothing here", "en", "s", 12)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in pii.redact(clean).collect()}
    assert got[1]["text"].startswith("write <email>, call <phone>; token = \"") and got[1]["text"].endswith("é") and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "nothing here"
    assert pii.redact(docs).columns == docs.columns and pii.redact(empty).count() == 0


def test_em_finds_reliable_labelers():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.4
    ballots = np.stack([np.where(rng.random(4000) < a, np.where(truth, 2, 0), np.where(rng.random(4000) < 0.5, 1, np.where(truth, 0, 2))) for a in (0.95, 0.9, 0.6, 0.55)], 1)
    p = pii.reliabilities(np.zeros(4000, int), ballots, np.ones(4000))
    assert ((p >= 0.5) == truth).mean() > 0.93


# --- classifiers


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def labelled_texts(n=900):
    rng = random.Random(7)
    vocabulary, bad = ["".join(rng.choice(["ba", "ku", "re", "to", "mi"]) for _ in range(5)) for _ in range(800)], ["nasty", "vile", "foul", "rotten"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad).upper() if rng.random() < 0.3 else rng.choice(bad))
        grade = rng.randrange(4)
        w = [x + "%%" if rng.random() < 0.25 * (3 - grade) else x for x in w]
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, grade, int(toxic)))
    return rows + [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (5002, "one", None, None, None)], labels


def test_toxicity(spark, tables):
    rows, labels = labelled_texts()
    d = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, y string, score int")
    y = spark.createDataFrame(labels + [(1, 0, None), (None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    tables(toxicity, documents=d, labels=y)
    got = toxicity.op5_toxicity(spark, "").collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    truth = {i: t for i, _, t in labels}
    held = {r["doc_id"]: r for r in got if r["held_out"] and r["doc_id"] in truth}
    assert set(held) == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    t = np.array([truth[i] for i in held])
    assert auc(np.array([r["score"] for r in held.values()]), t) > 0.97
    assert np.mean([r["predicted"] == truth[i] for i, r in held.items()]) > 0.95
    again = {r["doc_id"]: r["score"] for r in toxicity.op5_toxicity(spark, "").collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got)
    tables(toxicity, documents=d.limit(0), labels=y.limit(0))
    assert toxicity.op5_toxicity(spark, "").count() == 0


def test_toxic_offsets(spark):
    rows, labels = labelled_texts(400)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
    tagger = toxicity.trained(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text = "é 漢 word1 nasty word2 word3 FOUL"
    spans = toxicity.tag(spark.createDataFrame([(1, text)], "doc_id long, text string"), tagger).first()["spans"]
    assert [text[s["start"] : s["end"]] for s in spans] == ["nasty", "FOUL"]


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    t = rng.normal(size=(2, 2))
    scores = [rng.normal(size=n) for n in (0, 1, 2, 5, 7, 7)]
    for s, p in zip(scores, toxicity.marginals(scores, t)):
        want, total = np.zeros(len(s)), 0.0
        for bits in range(2 ** len(s)):
            state = [bits >> i & 1 for i in range(len(s))]
            w = np.exp(sum(x * y for x, y in zip(s, state)) + sum(t[a, b] for a, b in zip(state, state[1:])))
            want += w * np.array(state)
            total += w
        assert np.allclose(p, want / total)


def test_quality(spark, tables):
    rows, labels = labelled_texts()
    d = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, y string, tails int")
    y = spark.createDataFrame([(i, g, t) for i, g, t in labels] + [(2, None, None), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    tables(quality, documents=d, labels=y)
    got = quality.op6_quality_classifier(spark, "").collect()
    assert len(got) == len(rows) + 3
    grade = {i: g for i, g, _ in labels}
    held = {r["doc_id"]: r for r in got if r["held_out"] and r["doc_id"] in grade}
    g = np.array([grade[i] for i in held])
    e = np.array([r["expected_grade"] for r in held.values()])
    assert np.corrcoef(g, e)[0, 1] > 0.8 and 0 <= e.min() and e.max() <= 3
    assert auc(np.array([r["p_above_lowest"] for r in held.values()]), (g > 0).astype(int)) > 0.9
    tables(quality, documents=d.limit(0), labels=y)
    assert quality.op6_quality_classifier(spark, "").count() == 0
    tables(quality, documents=d, labels=y.limit(0))
    assert all(r["kept"] for r in quality.op6_quality_classifier(spark, "").collect())


def test_ordinal_fit_recovers_thresholds():
    rng = np.random.default_rng(4)
    n = 4000
    x = rng.normal(size=n)
    latent = 2.0 * x + rng.logistic(size=n)
    y = np.digitize(latent, [-1.0, 0.5, 3.0])
    model = quality.fit([(np.array([3]), np.array([v])) for v in x], y, steps=600)
    assert model.grades == [0, 1, 2, 3] and np.allclose(model.cuts, [-1.0, 0.5, 3.0], atol=0.25) and abs(model.w[3] - 2) < 0.2
    assert (np.diff(model.tails(np.array([0.3]))[0]) < 0).all()


def test_held_out_fold(spark):
    from pyspark.sql import functions as F

    got = {r["id"]: r["h"] for r in spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}
