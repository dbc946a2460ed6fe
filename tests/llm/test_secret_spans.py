"""Candidates for secrets are whole: any length, padding, parts joined by dots."""

import time

from strandwise.llm import pii

JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"


def found(text):
    return [text[s:e] for k, s, e in pii.added_candidates(text, []) if pii.KINDS[k] == "secret"]


def test_whole_secrets():
    long = "Ab3" * 172
    short = "SG.a1B2c3D4e5F6g7H8i9J0kL.Zz" + "9y8X" * 10
    assert len(long) == 516 and found(f"key: {long} x") == [long]
    assert found("token=QUJDREVGR0hJSktMTU5PUA==") == ["QUJDREVGR0hJSktMTU5PUA=="]
    assert found(f"api_key: {JWT}. Next") == [JWT]
    assert found(f"key='{short}'") == [short]
    assert found("a: 0123456789abcdef0 b") == ["0123456789abcdef0"]


def test_no_secrets():
    assert found("url: a_long_name_of_a_key=value") == [] and found("x=short.parts.only.here") == []


def test_time_is_linear():
    start = time.perf_counter()
    for text in ("=" * 200_000, "=a." * 70_000, "=" + "a." * 100_000, "=" + "a" * 200_000 + "=b", ":" + "abcdefgh." * 20_000 + "=x"):
        found(text)
    assert time.perf_counter() - start < 10
