"""Ingest and sinks (S1-S5, S19, S21, S24): files to points, one task a file, and whole-table publication."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrays of a scene folder and the columns that they become.
ASSETS = {"coord": ["x", "y", "z"], "color": ["r", "g", "b"], "normal": ["nx", "ny", "nz"], "strength": ["intensity"], "segment": ["label"], "instance": ["instance"]}
_COLUMNS = ["x", "y", "z", "r", "g", "b", "nx", "ny", "nz", "intensity", "label", "instance"]
_SCHEMA = "cloud string, point_id bigint, " + ", ".join(f"{c} {'int' if c in ('label', 'instance') else 'double'}" for c in _COLUMNS)


def scene_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """folder/<cloud>/<asset>.npy to points. Other assets are left out; missing labels are -1, other columns null.

    A cloud's files meet by their folder's name; a cloud is decoded by one task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -2).alias("cloud"), F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("asset"), "content").where(F.col("asset").isin(*ASSETS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        for asset, content in zip(pdf["asset"], pdf["content"]):
            a = np.load(io.BytesIO(content), allow_pickle=False)
            a = a.reshape(len(a), -1)
            out.update({c: a[:, k] for k, c in enumerate(ASSETS[asset])})
        return _framed(pdf["cloud"].iloc[0], out)

    return named.groupBy("cloud").applyInPandas(run, _SCHEMA)


def _framed(cloud: str, columns: dict) -> pd.DataFrame:
    n = len(next(iter(columns.values()))) if columns else 0
    data = {"cloud": [cloud] * n, "point_id": np.arange(n)}
    for c in _COLUMNS:
        label = c in ("label", "instance")
        data[c] = columns[c].astype(int if label else float) if c in columns else np.full(n, -1 if label else np.nan)
    return pd.DataFrame(data)


def npz_clouds(spark: SparkSession, folder: str, keys: dict[str, str]) -> DataFrame:
    """folder/<cloud>.npz to points; ``keys`` names the column of each one-dimensional array (voxel_index: x, y, z)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder).select(F.regexp_extract("path", r"([^/]+)\.npz$", 1).alias("cloud"), "content")

    def run(batches):
        for pdf in batches:
            for cloud, content in zip(pdf["cloud"], pdf["content"]):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                out = {keys[k]: z[k] for k in z.files if k in keys}
                if "voxel_index" in z.files:
                    out.update(zip("xyz", z["voxel_index"].T))
                yield _framed(cloud, out)

    return files.mapInPandas(run, _SCHEMA)


def lidar_frames(spark: SparkSession, folder: str, fields: int = 4, strength_scale: float = 1.0) -> DataFrame:
    """S3: little-endian float frames (x, y, z, strength, ...) with their .label files, whose low 16 bits are the label."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.(bin|label)$", 1).alias("cloud"), F.regexp_extract("path", r"\.(bin|label)$", 1).alias("kind"), "content").where("kind <> ''")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = dict(zip(pdf["kind"], pdf["content"]))
        if "bin" not in got:
            return _framed(pdf["cloud"].iloc[0], {})
        a = np.frombuffer(got["bin"], "<f4").reshape(-1, fields)
        out = {"x": a[:, 0], "y": a[:, 1], "z": a[:, 2], "intensity": a[:, 3] / strength_scale}
        if "label" in got:
            out["label"] = np.frombuffer(got["label"], "<u4").astype(np.int64) & 0xFFFF
        return _framed(pdf["cloud"].iloc[0], out)

    return named.groupBy("cloud").applyInPandas(run, _SCHEMA)


def text_points(spark: SparkSession, pattern: str, columns: list[str], separator: str = " ") -> DataFrame:
    """Delimited text, a file for each object: the class is the file name up to its number, the instance the order of
    the file's name in its folder. Parts of an object ("chair_1@300.txt", as ``formats`` writes them) are one object."""
    from pyspark.sql import Window

    schema = ", ".join(f"{c} double" for c in columns)
    rows = spark.read.schema(schema).option("sep", separator).csv(pattern).withColumn("_file", F.col("_metadata.file_path"))
    names = rows.select("_file").distinct().withColumn("cloud", F.element_at(F.split("_file", "/"), -2)).withColumn("_object", F.regexp_replace("_file", r"@\d+(\.[^./]+)$", "$1"))
    names = names.withColumns({"class": F.regexp_extract("_object", r"([^/]+?)_?\d*\.[^./]+$", 1), "instance": F.dense_rank().over(Window.partitionBy("cloud").orderBy("_object")) - 1})
    return rows.join(names, "_file").drop("_file", "_object")


def mesh_tables(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (cloud_id, vertex_id, x, y, z) and the faces (cloud_id, face_id, v0, v1, v2) all of whose corners are among them."""
    kept = faces
    for corner in ("v0", "v1", "v2"):
        kept = kept.join(vertices.select("cloud_id", F.col("vertex_id").alias(corner)), ["cloud_id", corner], "left_semi")
    return vertices.select("cloud_id", "vertex_id", "x", "y", "z"), kept.select("cloud_id", "face_id", "v0", "v1", "v2")


def publish(df: DataFrame, path: str) -> None:
    """Write beside the target, check the count, then rename: readers see all of it or nothing."""
    spark = df.sparkSession
    part = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    df.write.parquet(part)
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        raise FileExistsError(f"{path} is already there or can't be written")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object for each line; the header line, which has no vid, is left out."""
    return spark.read.schema(schema).json(path).where("vid is not null")
