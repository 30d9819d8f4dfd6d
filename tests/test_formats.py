"""Cloud files as data sources: round trips, parts of large clouds, and publication of all or nothing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.sources import formats, io
from tests.conftest import SMALL

COLUMNS = "cloud", "point_id", "x", "y", "z", "intensity", "label", "instance"


def some(spark, n=50):
    own = spark.range(n).selectExpr("concat('c', if(id < 40, 0, id)) cloud", "if(id < 40, id, 0L) point_id", "id % 7 * 1d x", "id % 5 * 1d y", "id * 1d z", "id / 4d intensity", "int(id % 4) label", "int(id % 3) instance")
    return own.select(*COLUMNS)


@pytest.mark.parametrize("layout", ["cloud_npz", "cloud_npy", "cloud_bin"])
def test_round_trip_in_parts(spark, tmp_path, layout):
    df, path = some(spark), str(tmp_path / "out")
    formats.write_clouds(df, path, layout, points_per_part="9")
    assert any("@" in f for _, d, fs in os.walk(path) for f in (*d, *fs)) and os.listdir(tmp_path) == ["out"]
    back = formats.read_clouds(spark, path, layout, partition_bytes="300")
    assert back.rdd.getNumPartitions() > 1
    assert sorted(map(tuple, back.select(*COLUMNS).collect())) == sorted(map(tuple, df.collect()))
    assert back.where("r is not null").count() == 0


def test_files_of_other_clouds_stay_unread(spark, tmp_path):
    path = str(tmp_path / "out")
    formats.write_clouds(some(spark), path, "cloud_npz")
    (tmp_path / "out" / "c41.npz").write_bytes(b"broken")
    assert formats.read_clouds(spark, path, "cloud_npz", clouds='["c0", "c42"]').count() == 41
    back = formats.read_clouds(spark, path, "cloud_npz", clouds='["c43", "c44"]')
    assert [back.where("cloud = 'c43'").count(), back.count()] == [1, 2]
    with pytest.raises(Exception):
        formats.read_clouds(spark, path, "cloud_npz").count()


def test_all_or_nothing(spark, tmp_path):
    df, path = some(spark), str(tmp_path / "out")
    bad = df.withColumn("x", F.when(F.col("cloud") == "c45", F.raise_error("a task fails").cast("double")).otherwise(F.col("x")))
    gap = df.where("point_id <> 20")
    for rows in (bad, gap, df.withColumn("cloud", F.when(F.col("cloud") != "c49", F.col("cloud")))):
        with pytest.raises(Exception):
            formats.write_clouds(rows, path, "cloud_npy")
        assert os.listdir(tmp_path) == []
    formats.write_clouds(df, path, "cloud_npy")
    with pytest.raises(Exception):
        formats.write_clouds(df.where("cloud = 'c0'"), path, "cloud_npy")
    assert formats.read_clouds(spark, path, "cloud_npy").count() == 50 and os.listdir(tmp_path) == ["out"]
    formats.write_clouds(df.where("cloud = 'c0'"), path, "cloud_npy", overwrite=True)
    assert formats.read_clouds(spark, path, "cloud_npy").count() == 40 and os.listdir(tmp_path) == ["out"]


def test_files_of_a_task_that_ran_twice_are_left_out(tmp_path):
    import pyarrow as pa

    writer = formats._Writer(formats.Npz, {"path": str(tmp_path / "out")}, False)
    batch = pa.RecordBatch.from_pydict({"cloud": ["a", "a", "b"], "point_id": [0, 1, 0], **{c: [1.0, 2.0, 3.0] for c in "xyz"}})
    writer.write(iter([batch]))  # its message is lost
    writer.commit([writer.write(iter([batch])), None])
    assert sorted(os.listdir(tmp_path / "out")) == ["a.npz", "b.npz"] and os.listdir(tmp_path) == ["out"]


def test_empty_tables_and_foreign_files(spark, tmp_path):
    path = str(tmp_path / "out")
    formats.write_clouds(some(spark).limit(0), path, "cloud_bin")
    assert formats.read_clouds(spark, path, "cloud_bin").count() == 0
    (tmp_path / "in" / "a").mkdir(parents=True)
    np.save(tmp_path / "in" / "a" / "coord.npy", np.ones((2, 3), np.float32))
    np.save(tmp_path / "in" / "a" / "other.npy", np.ones(9))
    (tmp_path / "in" / "notes.md").write_text("none")
    rows = formats.read_clouds(spark, str(tmp_path / "in"), "cloud_npy").collect()
    assert [(r.cloud, r.point_id, r.x, r.intensity, r.label) for r in rows] == [("a", 0, 1.0, None, -1), ("a", 1, 1.0, None, -1)]


def test_text_by_object_is_read_alike(spark, tmp_path):
    df = some(spark).withColumn("cloud", F.concat(F.lit("room/chair_"), F.substring("cloud", 2, 9)))
    formats.write_clouds(df, str(tmp_path / "out"), "cloud_txt")
    one, other = formats.read_clouds(spark, str(tmp_path / "out"), "cloud_txt"), io.text_points(spark, str(tmp_path / "out/*/*.txt"), ["x", "y", "z"])
    assert one.select("x", "y", "z").exceptAll(other.select("x", "y", "z")).count() == 0 and other.count() == 50
    assert {(r["class"], r.cloud) for r in other.collect()} == {("chair", "room")}
