"""Point clouds, frames and metric records derived from the given tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudloom.functions.tables import deal


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each point of lineitem's clouds (cloud = supplier)."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    rows = read(spark, sf_dir, "lineitem")
    rows = deal(rows, rows.count(), "l_suppkey").withColumn("point_id", F.row_number().over(order).cast("bigint"))
    rows = rows.selectExpr(
        "cast(l_suppkey as bigint) cloud_id", "point_id", "cast(l_quantity as double) x", "cast(round(l_discount*100) as double) y", "cast(round(l_tax*100) as double) z",
        "cast(l_extendedprice/100 as double) intensity", "l_partkey", "l_orderkey",
        "case when l_returnflag='N' then 0 when l_returnflag='A' then 1 else 3 end + case when l_returnflag<>'N' and l_linestatus='O' then 1 else 0 end label",
        "cast(l_partkey % 25 as int) rib",
    )
    return rows.selectExpr(
        "cloud_id", "point_id", "x", "y", "z", "intensity", "label", "case when l_partkey % 5 = 0 then (label+1) % 5 else label end pred", "cast(l_partkey % 7 as int) - 1 instance",
        "rib", "case when l_orderkey % 10 = 0 then (rib+1) % 25 when l_orderkey % 97 = 0 then (rib+7) % 25 else rib end rib_pred",
    )


POINTS_SQL = """base_rows AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
 l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS point_id FROM lineitem),
base_points AS (SELECT l_suppkey::bigint AS cloud_id, point_id, l_quantity::double AS x, round(l_discount*100)::double AS y, round(l_tax*100)::double AS z,
 (l_extendedprice/100)::double AS intensity, l_partkey, l_orderkey,
 CASE WHEN l_returnflag='N' THEN 0 WHEN l_returnflag='A' THEN 1 ELSE 3 END
 + CASE WHEN l_returnflag<>'N' AND l_linestatus='O' THEN 1 ELSE 0 END AS label, CAST(l_partkey % 25 AS int) AS rib FROM base_rows),
pts AS (SELECT cloud_id, point_id, x, y, z, intensity, label,
 CASE WHEN l_partkey % 5 = 0 THEN (label+1) % 5 ELSE label END AS pred, CAST(l_partkey % 7 AS int) - 1 AS instance, rib,
 CASE WHEN l_orderkey % 10 = 0 THEN (rib+1) % 25 WHEN l_orderkey % 97 = 0 THEN (rib+7) % 25 ELSE rib END AS rib_pred FROM base_points)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A driving-sequence stand-in: one frame for each order of a customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("bigint").alias("seq_id"), F.col("o_orderkey").cast("bigint").alias("frame_id"), (F.row_number().over(w) - 1).cast("bigint").alias("frame_idx"),
        F.col("o_orderdate").cast("date").alias("day"), (F.col("o_totalprice") / 1000).cast("double").alias("tx"), (F.col("o_orderkey") % 360).cast("double").alias("yaw_deg"),
    )


FRAMES_SQL = """frames AS (SELECT o_custkey::bigint AS seq_id, o_orderkey::bigint AS frame_id,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame_idx, o_orderdate::date AS day,
 (o_totalprice/1000)::double AS tx, (o_orderkey % 360)::double AS yaw_deg FROM orders)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric records: the value series of each user and event type."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("bigint").alias("run"), F.col("event_type").alias("name"), F.col("event_id").cast("bigint").alias("event_id"), "ts",
        (F.row_number().over(w) - 1).cast("bigint").alias("iter"), F.col("value").cast("double").alias("value"),
    )


METRICS_SQL = """metrics AS (SELECT user_id::bigint AS run, event_type AS name, event_id::bigint AS event_id, ts,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS iter, value::double AS value FROM events)"""
