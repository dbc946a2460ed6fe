"""The near-duplicate stage joins pairs of 80 % likeness; op8 those of 85 %."""

import random

import corpus_pipeline
from strandwise.llm import near_dedup

from test_free import groups_by_hand


def test_layout_follows_the_threshold():
    assert near_dedup.layout(85) == (near_dedup.KEYED, near_dedup.CHUNKS, near_dedup.FAR)
    assert near_dedup.layout(80)[2] > near_dedup.FAR
    for percent in (1, 50, 70, 80, 90, 100):
        keyed, chunks, far = near_dedup.layout(percent)
        assert keyed % chunks == 0 and keyed <= near_dedup.SLOTS and 0 <= far <= near_dedup.SLOTS


def test_stage_drops_pairs_between_80_and_85(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        other = words.copy()
        for at in (20, 60, 100, 140):  # 4 words of 200 shingles: 180 alike of 220, 81.8 %
            other[at] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    far = [f"u{i}" for i in range(204)]
    rows += [(1000, " ".join(far)), (1001, " ".join("changed" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(far)))]  # 175 of 225
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, d, "").collect()}
    assert kept == {2 * i for i in range(60)} | {1000, 1001}
    assert near_dedup.deduplicated(d).count() == len(rows) == len({g for _, _, g in groups_by_hand(d.collect())})
