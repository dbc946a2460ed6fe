"""The pipeline's stages against what their contracts say of the rows each one gets."""

import re

import corpus_pipeline
from strandwise.llm import mixing, packing, pii, quality
from test_free import best_fit, groups_by_hand, labelled_texts
from test_native import water

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(spark, folder):
    rows, labels = labelled_texts(300)
    texts = [(i, t, "en", f"s{i % 5}", None if t is None else len(t)) for i, t, *_ in rows]
    texts += [(10_000 + i, t, "en", "s1", n) for i, t, _, _, n in texts[:60]]  # copies
    texts += [(20_000 + i, t + " word", "en", None, n + 5) for i, t, _, _, n in texts[60:90] if len(t.split()) > 40]  # near copies
    texts += [(30_000, "mail a.b@c-d.org or call +1 (523) 555-1055 " + texts[3][1], "en", "s2", 0), (None, "no id " + texts[4][1], "en", "s2", 0)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(g > 0), t) for i, g, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    docs = corpus(spark, folder)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_duplicates", "personal_data", "mix_sources", "best_fit_packing"]
    made = {}
    before = docs
    for name, step in corpus_pipeline.STAGES:
        after = corpus_pipeline.stage(step(spark, before, folder), name)
        if name != names[-1]:
            assert after.columns == docs.columns
        made[name] = (before.collect(), after.collect(), before)
        before = after
    key = lambda r: repr(tuple(r))

    rows, kept, frame = made["quality_classifier"]
    model = quality.trained(frame, spark.read.parquet(f"{folder}/labels.parquet"))
    want = []
    for r in rows:
        ids, values = quality.vector((r["text"] or "").encode())
        if model.tails([float(model.w[ids] @ values)])[0][0] >= 0.5:
            want.append(r)
    assert sorted(map(key, kept)) == sorted(map(key, want)) and 0 < len(kept) < len(rows)

    rows, kept, _ = made["near_duplicates"]
    groups = {i: g for i, _, g in groups_by_hand(rows) if i is not None}
    assert sorted(map(key, kept)) == sorted(key(r) for r in rows if r["doc_id"] is None or groups[r["doc_id"]] == r["doc_id"]) and len(kept) < len(rows)

    rows, kept, _ = made["personal_data"]
    old = {r["doc_id"]: r["text"] for r in rows}
    assert len(kept) == len(rows)
    for r in kept:
        spans = pii.base_spans(old[r["doc_id"]] or "")
        assert not pii.base_spans(r["text"] or "") and (spans or r["text"] == old[r["doc_id"]])
        assert r["text"] is None or r["n_chars"] == len(r["text"])

    rows, kept, _ = made["mix_sources"]
    size = lambda r: len(WORD.findall(r["text"] or ""))
    sources = sorted({r["source"] for r in rows if r["source"] is not None}) + ([None] if any(r["source"] is None for r in rows) else [])
    sizes = [sum(size(r) for r in rows if r["source"] == s) for s in sources]
    for s, target in zip(sources, water(sizes, [i % 3 + 1 for i in range(len(sources))])):
        assert abs(sum(size(r) for r in kept if r["source"] == s) - target) <= 2048 + 1
    texts = {r["doc_id"]: " ".join(WORD.findall(r["text"] or "")) for r in rows}
    taken = {}
    for r in kept:
        assert " ".join(WORD.findall(r["text"])) in texts[r["doc_id"]]
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + size(r)
    assert all(n <= 3 * len(texts[i].split()) for i, n in taken.items())

    rows, pieces, _ = made["best_fit_packing"]
    ids = lambda r: len(packing.encoder(packing.vocabulary_path()).whole(r["text"] or "")) // 4 + 1
    assert sum(r["length"] for r in pieces) == sum(map(ids, rows))
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by_sequence) == best_fit([r["length"] for r in pieces], 2048)


def test_run_on_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_mixing_gives_short_documents_whole(spark):
    d = spark.createDataFrame([(i, f"a{i}  b\tc", "en", "s", len(f"a{i}  b\tc")) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mixed_documents(d, block=1000).collect()
    assert sorted(tuple(r) for r in out) == sorted(tuple(r) for r in d.collect())


def test_operators_with_clashing_columns(spark, docs):
    from pyspark.sql import functions as F

    own = ["spans", "found", "score", "tails", "expected_grade", "piece", "length", "ids", "offset", "sequence_id", "_key", "rule", "component_id", "_mix_id"]
    odd = docs.withColumns({c: F.lit("clash") for c in own})
    model = quality.trained(odd, spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int"))
    n = docs.count()
    assert quality.grade(odd, model).count() == n and quality.accepted(odd, model).columns == odd.columns
    assert pii.detect(odd).count() == n and pii.redact(odd).columns == odd.columns
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert packing.packed(corpus_pipeline.stage(packing.pieces(odd), "pieces")).count() >= n
    assert corpus_pipeline.near_dedup.deduplicated(odd).columns == odd.columns
    from strandwise.llm import toxicity

    assert toxicity.tag(odd, toxicity.fit([], __import__("numpy").zeros(0))).count() == n
