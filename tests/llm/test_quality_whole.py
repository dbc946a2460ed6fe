"""Word features see whole words; long runs count in all their pieces."""

import random

from strandwise.llm import quality


def test_all_of_a_long_run_counts():
    a, b = "数据" * 40, "数据" * 39 + "書本"
    assert a.encode()[:64] == b.encode()[:64]
    (x, _), (y, _) = quality.vector(a.encode()), quality.vector(b.encode())
    assert set(x.tolist()) != set(y.tolist())
    run = "".join(random.Random(1).choice("abcdXYZ019+/") for _ in range(5000)).encode()
    parts = quality.pieces([b"short", run, b"x" * 64])
    assert b"".join(parts[1:-1]) == run and parts[0] == b"short" and parts[-1] == b"x" * 64
    for text in (a, "é" * 100, "😀" * 50, "a" + "漢" * 60):
        cut = quality.pieces([text.encode()])
        assert "".join(p.decode() for p in cut) == text and len(cut) > 1 and max(map(len, cut)) <= 24


def test_whole_shape_and_marks():
    a, b = b"Aa0" * 12 + b"Aa0", b"Aa0" * 12 + b"0aA"
    assert quality.word_buckets(a)[1] != quality.word_buckets(b)[1]
    assert quality.word_buckets(b"-=" * 10 + b"-")[2] != quality.word_buckets(b"-=" * 10 + b"+")[2]


def test_scorer_equals_vector():
    import numpy as np
    import pyarrow as pa

    w = np.random.default_rng(1).normal(size=quality.BUCKETS)
    model = quality.Model([0, 1], w, [0.0])
    for text in ("数据" * 90 + " two words", "plain words only", ""):
        ids, values = quality.vector(text.encode())
        assert abs(quality.Scorer(model).tails(pa.array([text]))[0, 0] - model.tails([float(model.w[ids] @ values)])[0, 0]) < 1e-5
