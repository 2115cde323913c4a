"""Ordered computations without a single-task window: per-bucket windows plus a small table of bucket carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def number_rows(rows: DataFrame, bucket: str, order: str, out: str) -> DataFrame:
    """0-based position of every row in (bucket, order), buckets ascending."""
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("_n"))
    # one row per bucket, so this window is as small as the number of buckets
    shift = sizes.select(
        bucket, (F.sum("_n").over(Window.orderBy(bucket)) - F.col("_n")).alias("_shift")
    )
    within = F.row_number().over(Window.partitionBy(bucket).orderBy(order)) - 1
    return rows.withColumn("_i", within).join(shift, bucket).withColumn(out, F.col("_shift") + F.col("_i")).drop(
        "_i", "_shift", bucket
    )


def _blocked(rows: DataFrame, order: str, block) -> DataFrame:
    return rows.withColumn("_block", block if isinstance(block, Column) else F.floor(F.col(order) / block))


def carry_forward(
    rows: DataFrame, order: str, value: Column, out: str, by: tuple[str, ...] = (), block: int | Column = 1_000_000
) -> DataFrame:
    """The last non-null ``value`` up to and including each row, along ``order``.

    Rows are cut into blocks of ``order`` (or by a block column that rises with it); a
    block is one window group, and what earlier blocks leave behind comes from a table
    with one row per block.
    """
    keys = [*by, "_block"]
    marked = _blocked(rows.withColumn("_v", value), order, block)
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order)))
    blocks = marked.groupBy(*keys).agg(last.alias("_last"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = marked.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    return filled.join(carried, keys, "left").withColumn(out, F.coalesce("_in", "_carry")).drop(
        "_v", "_in", "_carry", "_block"
    )


def running(
    rows: DataFrame, order: str, value: Column, out: str, how: str, by: tuple[str, ...] = (),
    block: int | Column = 1_000_000, exclusive: bool = False,
) -> DataFrame:
    """Running ``max`` or ``sum`` of ``value`` along ``order`` per group, by blocks as above."""
    fold = {"max": F.max, "sum": F.sum}[how]
    keys = [*by, "_block"]
    marked = _blocked(rows.withColumn("_v", value), order, block)
    blocks = marked.groupBy(*keys).agg(fold("_v").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, fold("_total").over(before).alias("_carry"))
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    folded = marked.withColumn("_in", fold("_v").over(inside)).join(carried, keys, "left")
    both = F.greatest("_in", "_carry") if how == "max" else F.coalesce(F.col("_in") + F.col("_carry"), "_in", "_carry")
    return folded.withColumn(out, both).drop("_v", "_in", "_carry", "_block")
