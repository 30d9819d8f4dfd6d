"""Row numbers over a whole table without putting it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.tables import materialise


def global_rank(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with the number of each row, from 1, in an order that leaves no ties.

    Rows are dealt by ranges of the order and written with their range's number, so that it stays; a row's number is its place in
    the range and the sizes of the ranges before, of which there are as many as shuffle partitions.
    """
    keys = {f"_k{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    dealt = df.withColumns(keys).repartitionByRange(*keys)
    dealt = materialise(dealt.withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    out = dealt.withColumn("_place", place).join(F.broadcast(starts), "_range")  # a row for each range
    return out.withColumn(name, F.col("_start") + F.col("_place")).drop("_range", "_start", "_place", *keys)


def rank_within(df: DataFrame, key: str, order: list[Column | str], name: str) -> DataFrame:
    """df with the number of each row among those of its key, from 1, in an order that leaves no ties within a key.

    Rows are dealt by ranges of key and order, so a key with a third of all rows is spread over a third of the tasks. A row's number is
    its place among its key's rows of the range and the sizes of the key's ranges before; sizes meet rows by key and range.
    """
    keys = {f"_k{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    dealt = df.withColumns(keys).repartitionByRange(key, *keys)
    dealt = materialise(dealt.withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(key, "_range").count().select(F.col(key).alias("_key"), F.col("_range").alias("_at"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    out = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*keys)))
    out = out.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    return out.withColumn(name, F.col("_start") + F.col("_place")).drop("_range", "_start", "_place", "_key", "_at", *keys)
