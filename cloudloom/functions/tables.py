"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of points or records that a task takes: what is made of a point (up to 15 rows) is sorted and added up there too.
DEALT = 1 << 17


def new_folder(spark: SparkSession) -> str:
    """A new path below the folder of spark.checkpoint.dir. Only a local session without that setting gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cloudloom-"))
    return f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back; cuts the lineage."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def deal(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by its keys in parts of about DEALT of its rows, once that makes more parts than a shuffle has anyway.

    A fixed number of parts would make a task's sorts and aggregations grow with the table.
    """
    parts = -(-rows // DEALT)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def discard(df: DataFrame) -> None:
    """Delete what materialise wrote for df, once nothing is read from it any more."""
    spark, path = df.sparkSession, df._written
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
