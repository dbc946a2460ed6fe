import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, start string"


def words(rng, n):
    return [rng.choice(["alpha", "beta", "Gamma", "delta,", "été", "naïve", "x", "eins", "zwei", "drei"]) + str(rng.randrange(400)) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Documents with all that is odd: nulls, empties, white space alone, ties, repeated rows, near copies, long texts."""
    rng = random.Random(3)
    out = []
    for i in range(40):
        text = " ".join(words(rng, rng.choice([3, 30, 120, 400])))
        out.append((i, text, "en", f"s{i % 4}"))
        if i % 5 == 0:  # near copies and equal texts under other ids
            out.append((100 + i, text, "en", "s0"))
            out.append((200 + i, text.replace(text.split()[-1], "other"), "fr", None))
    out += [(300, None, None, "s1"), (301, "", "en", None), (302, " \n\t ", "en", "s1"), (303, "one", "en", "s2"), (304, "one two three four", "en", "s2")]
    out += [(305, " ".join(words(rng, 6000)), "en", "s3"), (306, "mail a.b@c-d.org or +1 (523) 555-1055 now", "en", "s9"), (307, "漢字 İstanbul ﬁn e\u0301 <|endoftext|> it's 10'000", "en", "é")]
    return [(i, t, lang, s, None if t is None else len(t), "clash", "clash") for i, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def repeated(spark, rows):
    """Some rows twice, and null ids."""
    return spark.createDataFrame(rows[:6] + rows[:6] + rows[-8:] + [(None, "no id at all here", "en", "s0", 17, "", ""), (None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def tables(monkeypatch):
    """tables(module, documents=df, ...) lets the module's queries read these."""

    def give(module, **frames):
        monkeypatch.setattr(module, "table", lambda spark, sf_dir, name: frames[name])

    return give
