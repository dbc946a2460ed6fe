import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandwise.plans import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = core.QUERIES[name](spark, sf_dir)
    want = con.execute(core.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("algorithm", ["conservative", "consensus", "scored"])
def test_corrected_reads_keep_order_of_magnitude(spark, sf_dir, algorithm):
    n = core.reads(spark, sf_dir).count()
    out = core.QUERIES[f"correct_{algorithm}"](spark, sf_dir)
    assert out.columns == ["read_id", "bases", "n_corrections", "status"] and out.count() == n


def test_entry_module(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(core.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 256


def test_vote_winners_fix_what_the_kernel_fixes(spark, sf_dir):
    """Votes counted by the join equal those that the conservative kernel counts read by read."""
    import numpy as np

    from strandwise.operators import correction
    from strandwise.operators.kernels.lookup import encode

    own = correction.solid_set(core.trusted(spark, sf_dir), core.K)
    want = {}
    for r in core.reads(spark, sf_dir).collect():
        codes = encode(r["bases"])
        if len(codes) >= core.K:
            m = own.windows(codes)
            good = (own.mutants(codes) > 0) & (m == 0)[:, None, None]
            for w, o, b in np.argwhere(good):
                key = (r["read_id"], int(w + o), "ACGT"[b])
                want[key] = want.get(key, 0) + 1
    got = {(r["read_id"], r["pos"], r["b"]): r["votes"] for r in core.ballots(spark, sf_dir).collect()}
    assert got == want
