from strandwise.operators import spectrum
from strandwise.plans import queries
from strandwise.streaming import counts as streaming


def test_drained_counts_keep_no_state_and_collect_nothing(spark, tmp_path):
    rows = [(i, "".join("ACGTN"[(i * i + j * (i % 7)) % 5] for j in range(i % 40)), "") for i in range(300)] + [(300, None, None), (301, "ACG", "")]
    reads = spark.createDataFrame(rows, "read_id long, bases string, quals string")
    reads.repartition(6).write.parquet(str(tmp_path / "in"))
    for k, n_as_a in ((4, False), (32, True)):
        stream = streaming.read_stream(spark, str(tmp_path / "in"), files_per_trigger=2)
        got = streaming.drained_counts(stream, k, 2, str(tmp_path / f"out{k}"), n_as_a)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spectrum.count_kmers(reads, k, 2, n_as_a).collect()))
        assert not (tmp_path / f"out{k}" / "state" / "state").exists()  # where a keyed sum would keep all k-mers
        assert len(list((tmp_path / f"out{k}" / "state" / "commits").glob("[0-9]*"))) == 3


def test_query_over_a_stream_collects_no_counts(spark, sf_dir):
    plan = queries.QUERIES["stream_kmer_count"](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert "LocalRelation" not in plan and "MemoryPlan" not in plan
