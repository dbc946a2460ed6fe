import hashlib
import re

import duckdb
import pytest

from strandwise.llm import fingerprint, license_scan, mixing, url_filter
from strandwise.llm.shared import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def water(sizes, weights, factor=3):
    """Targets by the contract's words: share, stop at the cap, share the excess again."""
    total, out, free, left = sum(sizes), [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        level = left / sum(weights[i] for i in free)
        over = [i for i in free if level * weights[i] > factor * sizes[i]]
        if not over:
            for i in free:
                out[i] = level * weights[i]
            break
        for i in over:
            out[i] = float(factor * sizes[i])
            left -= out[i]
            free.discard(i)
    assert abs(sum(out) - total) < 1e-6 * max(1, total)
    return out


@pytest.mark.parametrize("which", ["docs", "repeated"])
def test_mixing(spark, tables, request, which):
    frame = request.getfixturevalue(which)
    tables(mixing, documents=frame)
    got = [r.asDict() for r in mixing.op1_mixing(spark, "").collect()]
    again = [r.asDict() for r in mixing.op1_mixing(spark, "").collect()]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(got, key=key) == sorted(again, key=key)
    size = {}
    rows = frame.collect()
    for r in rows:
        size[r["source"]] = size.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    assert len(got) == len(rows)
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    targets = dict(zip(order, water([size[s] for s in order], [i % 3 + 1 for i in range(len(order))])))
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == size[s] and abs(r["target"] - targets[s]) < 1e-6 * (1 + targets[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - targets[s]) <= 2 * mixing.BLOCK
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)


def test_mixing_blocks_and_permutation(spark, docs):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        p = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long"))).collect()]
        assert sorted(p) == list(range(n))
    places = mixing.placed(docs)
    mix = mixing.mix(places, mixing.source_targets(places), block=32, shards=4).collect()
    by_slot = {}
    for r in mix:
        assert 0 <= r["from_word"] and r["from_word"] + r["n_words"] <= r["size"]
        by_slot.setdefault((r["skey"], r["slot"]), []).append(r)
    assert all(sum(x["n_words"] for x in v) <= 32 and len({x["shard"] for x in v}) == 1 for v in by_slot.values())
    assert len({r["shard"] for r in mix}) == 4


def test_mixed_documents(spark, docs, empty):
    out = mixing.mixed_documents(docs, block=50).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert out and all(WORD.findall(r["text"]) and " ".join(WORD.findall(r["text"])) in " ".join(WORD.findall(text[r["doc_id"]])) for r in out)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(empty).count() == 0


@pytest.mark.parametrize("which", ["docs", "repeated"])
def test_fingerprint(spark, tables, request, which):
    frame = request.getfixturevalue(which)
    tables(fingerprint, documents=frame)
    got = fingerprint.op2_fingerprint(spark, "").collect()
    rows = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in frame.collect()))
    want = []
    for i, (none, doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][2]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = shingles(text), shingles(edited), shingles(after)
        want.append((none, doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), len(a & b) / len(a | b) if a | b else 1.0, len(a & c) / len(a | c) if a | c else 1.0))
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got)
    for x, y in zip(found, sorted(want)):
        assert x[:4] == y[:4] and abs(x[4] - y[4]) < 0.16 and abs(x[5] - y[5]) < 0.16
    same = {}
    texts = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
    for r in got:
        if r["doc_id"] is not None:
            assert same.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_sketches_merge_and_estimate(spark):
    from pyspark.sql import functions as F

    left, right = " ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(300, 1200))
    d = spark.createDataFrame([(left, right)], "a string, b string")
    d = d.select(fingerprint.fingerprint(F.col("a")).alias("a"), fingerprint.fingerprint(F.col("b")).alias("b"), fingerprint.sketch(F.concat(fingerprint.shingle_hashes(F.col("a")), fingerprint.shingle_hashes(F.col("b")))).alias("u"))
    r = d.select((fingerprint.merged(F.col("a"), F.col("b")) == F.col("u")).alias("m"), fingerprint.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.distinct_count(F.col("a")).alias("n")).first()
    assert r["m"] and abs(r["r"] - 0.5) < 0.15 and abs(r["c"] - 2 / 3) < 0.2 and abs(r["n"] - 896) < 300


@pytest.mark.parametrize("n", [1, 2, 40, 700])
def test_next_document(spark, n):
    d = spark.createDataFrame([(i * i * 7 % 100003, f"t{i}") for i in range(n)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(d, "doc_id", ["text"], ["text"], per_bucket=8).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in d.collect())
    assert got == {a: rows[(i + 1) % n][1] for i, (a, _) in enumerate(rows)}


def judged(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_filter(spark, tables):
    urls = [None, "", "example.net/en/", "http://", "http://NET", "http://NET/", "https://a.b.Example.NET/en/x?y=http://org/fr/", "http://example.net/en", "http://example.org/fr/#a", "x://notexample.com/de/", "x://example.com:80/de/"]
    urls += ["http://example.com/de/1", "http://example.com/DE/1", "http://a..net//", "http://.net/", "http://é.org/fr/é", "http://x.net?/en/", "http://org/fr/" + "a/" * 5000, "http://" + "a." * 3000 + "net/", "http://example.com/de/1", "http://u@example.net/en/"]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)] + [(5, urls[5], "h", "clash"), (None, urls[5], None, None)], "page_id long, url string, host string, verdict string")
    tables(url_filter, pages=pages)
    got = [tuple(r) for r in url_filter.op9_url_filter(spark, "").collect()]
    want = [(r["page_id"], *judged(r["url"])) for r in pages.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    tables(url_filter, pages=pages.limit(0))
    assert url_filter.op9_url_filter(spark, "").count() == 0


def test_url_rules_without_slash_ties_and_none(spark):
    urls = spark.createDataFrame([("a.org", "/admin/x"), ("a.org", "/other"), ("b.org", "")], "host string, path string")
    rules = url_filter.rule_table(spark, [("a.org", "/adm", "block"), ("org", "", "allow"), ("a.org", "/adm", "allow")])
    got = {(r["host"], r["path"]): (r["rule"], r["verdict"]) for r in url_filter.judge(urls, rules, "deny").collect()}
    assert got == {("a.org", "/admin/x"): ("a.org/adm", "block"), ("a.org", "/other"): ("org", "allow"), ("b.org", ""): ("org", "allow")}
    assert {r["verdict"] for r in url_filter.judge(urls, url_filter.rule_table(spark, []), "deny").collect()} == {"deny"}


def test_url_filter_sql(spark, sf_dir):
    pages = f"{sf_dir}/pages.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{pages}')")
    want = sorted(con.execute(url_filter.SQL).fetchall(), key=repr)
    assert sorted((tuple(r) for r in url_filter.op9_url_filter(spark, sf_dir).collect()), key=repr) == want


def scanned(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def test_license_scan(spark, tables, rows):
    texts = ["GNU General Public License, gnu general public license", "apache  license apache license cc by cc by cc", "MIT\nLicense", "mit-license", "the apache", None, "", "no", "cc BY é", "éapache license", "apache licenseé", "apache license " * 3000]
    extra = [t for _, t, *_ in rows[:20]]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts + extra)] + [(0, texts[0], 1, "x"), (None, texts[1], 1, "x")], "doc_id long, text string, t int, label string")
    tables(license_scan, documents=d)
    got = license_scan.op10_license_scan(spark, "").collect()
    want = [(r["doc_id"], *scanned(r["text"])) for r in d.collect()]
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1 for r in got)
    tables(license_scan, documents=d.limit(0))
    assert license_scan.op10_license_scan(spark, "").count() == 0


def test_license_notices_with_edits(spark):
    notice = license_scan.NOTICES[0][0].split()
    edited = notice[:5] + ["quite"] + notice[5:]
    d = spark.createDataFrame([(1, "x y " + " ".join(notice)), (2, "a b c " + " ".join(edited)), (3, " ".join(notice[:6]))], "doc_id long, text string")
    spans, _ = license_scan.scan(d, ["doc_id"])
    found = {r["doc_id"]: r for r in spans.collect()}
    assert set(found) == {1, 2} and found[1]["score"] == 1.0 and (found[1]["first"], found[1]["last"]) == (2, 1 + len(notice))
    assert found[2]["label"] == "mit" and found[2]["first"] == 3 and found[2]["last"] == 2 + len(edited)


@pytest.mark.parametrize("few", [0, 100_000])
def test_components(spark, few):
    import random

    rng = random.Random(few)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    assert got == {x: top(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0
