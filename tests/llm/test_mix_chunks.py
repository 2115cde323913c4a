"""Copies of one text spread over the chunks of their source."""

from pyspark.sql import functions as F

from cobblestone.llm import mixing


def test_chunks_stay_bounded_whatever_is_repeated(spark):
    rows = [(i, "the same text", "a") for i in range(4000)] + [(None, None, "a")] * 4000
    rows += [(i, "w " * (i % 7), "a") for i in range(1000)] + [(7, "short", None)] * 10
    sized = mixing.sizes(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rates = totals.withColumn("rate", F.lit(1.5))
    chunks = mixing.dealt(sized, rates, chunk=100).groupBy("_s", "_part").agg(F.sum("_times").alias("n")).collect()
    assert sum(r.n for r in chunks) == len(rows)
    assert max(r.n for r in chunks) < 200
    done = mixing.copies(sized, rates, chunk=100)
    assert done.count() == len(rows)
    assert done.where("doc_id is null and size = 0").count() == 4000
    got = done.agg(F.sum(F.col("copies") * F.col("size"))).first()[0]
    assert abs(got - 1.5 * totals.agg(F.sum("source_size")).first()[0]) <= 100 * 7
