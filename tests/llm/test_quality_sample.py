"""What of the labelled documents reaches the driver."""

from pyspark.sql import functions as F

from estate_jobs.llm import quality


def test_repeated_ids_teach_once(spark, monkeypatch):
    """300,000 rows of one labelled id, of equal and of different texts, bring one row to the driver."""
    same = spark.range(300_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("some text of it").alias("text"))
    other = spark.range(2_000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("words "), F.repeat(F.lit("x "), (F.col("id") % 50).cast("int"))).alias("text"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((len(x), sorted(y.tolist()))) or fit(x, y))
    quality.learn(same.union(other), labels, train_docs=1000)
    quality.learn(other.union(same).repartition(3), labels, train_docs=1000)
    assert seen == [(2, [0.0, 1.0])] * 2


def test_the_row_that_teaches_is_the_same_in_any_layout(spark, docs_of, make):
    rows = [(k % 20, make("en", 10 + k, k), None, None) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    models = [quality.learn(docs_of(rows).repartition(n), labels) for n in (1, 5)]
    assert all((a == b).all() if hasattr(a, "all") else a == b for a, b in zip(*models, strict=True))
