"""What decides on broadcasts."""

from pyspark.sql import functions as F

import __spark_entry__ as contract
from cobblestone.session import JOINS, cut_lineage


def plan_of(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_not_broadcast_for_their_small_files(spark):
    ids = spark.range(1_000_000, numPartitions=2)
    cells = cut_lineage(ids.select(F.floor(F.col("id") / 1000).alias("row"), (F.col("id") % 1000).alias("col")), "join-cells")
    joined = cells.join(cells.withColumn("label", F.col("row")), ["row", "col"]).agg(F.count("*"))
    assert "BroadcastHashJoin" not in plan_of(joined)


def test_exploded_rows_are_not_broadcast_for_what_they_come_from(spark):
    few = cut_lineage(spark.range(100), "join-few").select("id", F.explode(F.sequence(F.lit(0), F.lit(9999))).alias("step"))
    many = spark.range(1_000_000).select((F.col("id") % 100).alias("id"), F.floor(F.col("id") / 100).alias("step"))
    assert "BroadcastHashJoin" not in plan_of(many.join(few, ["id", "step"]).agg(F.count("*")))


def test_few_rows_are_broadcast_once_they_are_counted(spark):
    few = cut_lineage(spark.range(3).withColumn("name", F.lit("a")), "join-few")
    many = spark.range(1_000_000).select((F.col("id") % 3).alias("id"))
    assert "BroadcastHashJoin" in plan_of(many.join(few, "id").agg(F.count("*")))


def test_registered_queries_set_it_on_the_session_they_get(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    contract.queries()["F2_nodes_in_area"](other, "/root/testdata/sf0.001")
    assert {k: other.conf.get(k) for k in JOINS} == JOINS
