"""The sample has every value of the label, fractions included."""

from pyspark.sql import functions as F

from strandwise.llm import labelled, quality


def table_of(spark, grades):
    docs = spark.createDataFrame([(i, f"text {i}", None) for i in range(len(grades))], "doc_id long, text string, y string").drop("y")
    return docs, spark.createDataFrame([(i, float(g)) for i, g in enumerate(grades)], "doc_id long, quality double")


def test_high_and_fractional_grades_teach(spark):
    docs, labels = table_of(spark, [i % 101 for i in range(1500)])
    got = [r["y"] for r in labelled.sample(docs, labels, "quality", 8000).collect()]
    assert set(got) == set(map(float, range(101)))
    docs, labels = table_of(spark, [(0.25, 0.5, 0.75)[i % 3] for i in range(300)])
    assert set(quality.trained(docs, labels).grades) == {0.25, 0.5, 0.75}


def test_many_values_are_binned_evenly(spark):
    docs, labels = table_of(spark, [i / 3000 for i in range(3000)])
    free = labels.where(~labelled.held_out(F.col("doc_id"))).count()
    got = labelled.sample(docs, labels, "quality", 100_000).collect()
    grades = {}
    for r in got:
        grades.setdefault(r["y"], []).append(r["doc_id"] / 3000)
    assert len(got) == free and 100 <= len(grades) <= labelled.GRADES
    order = sorted(grades)
    assert all(max(grades[a]) < min(grades[b]) and abs(sum(grades[a]) / len(grades[a]) - a) < 1e-9 for a, b in zip(order, order[1:]))
    assert max(map(len, grades.values())) < 3 * free / len(grades)


def test_rows_are_those_of_the_smallest_hashes(spark):
    docs, labels = table_of(spark, [int(i % 10 > 0) for i in range(4000)])
    got = sorted((r["y"], r["doc_id"]) for r in labelled.sample(docs, labels, "quality", 60).collect())
    rows = labels.where(~labelled.held_out(F.col("doc_id"))).select("doc_id", "quality", F.xxhash64(F.lit("quality"), "doc_id").alias("h")).collect()
    want = [(g, r["doc_id"]) for g in (0.0, 1.0) for r in sorted((r for r in rows if r["quality"] == g), key=lambda r: r["h"])[:30]]
    assert got == sorted(want)
