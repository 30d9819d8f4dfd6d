import numpy as np
import pytest

from cloudloom.sources import io


def test_scene_arrays(spark, tmp_path):
    for cloud, n in (("a", 3), ("b", 2)):
        (tmp_path / cloud).mkdir()
        np.save(tmp_path / cloud / "coord.npy", np.arange(3 * n, dtype=np.float32).reshape(n, 3))
        np.save(tmp_path / cloud / "other.npy", np.zeros(n))
    np.save(tmp_path / "a" / "segment.npy", np.array([4, 5, 6]))
    rows = io.scene_arrays(spark, str(tmp_path)).orderBy("cloud", "point_id").collect()
    assert [(r.cloud, r.point_id, r.x, r.label, r.instance) for r in rows] == [("a", 0, 0.0, 4, -1), ("a", 1, 3.0, 5, -1), ("a", 2, 6.0, 6, -1), ("b", 0, 0.0, -1, -1), ("b", 1, 3.0, -1, -1)]


def test_npz_and_lidar(spark, tmp_path):
    (tmp_path / "npz").mkdir()
    np.savez(tmp_path / "npz" / "v.npz", voxel_index=np.array([[1, 2, 3]], np.uint16), label=np.array([7]), intensity=np.array([9]))
    r = io.npz_clouds(spark, str(tmp_path / "npz"), {"label": "label", "intensity": "intensity"}).first()
    assert (r.cloud, r.x, r.y, r.z, r.label, r.intensity) == ("v", 1.0, 2.0, 3.0, 7, 9.0)
    (tmp_path / "scan").mkdir()
    np.array([1, 2, 3, 255, 4, 5, 6, 51], "<f4").tofile(tmp_path / "scan" / "f.bin")
    np.array([0x00030001, 2], "<u4").tofile(tmp_path / "scan" / "f.label")
    rows = io.lidar_frames(spark, str(tmp_path / "scan"), 4, 255.0).orderBy("point_id").collect()
    assert [(r.x, r.label) for r in rows] == [(1.0, 1), (4.0, 2)] and rows[1].intensity == pytest.approx(0.2)


def test_text_points_and_publish(spark, tmp_path):
    (tmp_path / "room").mkdir()
    (tmp_path / "room" / "chair_1.txt").write_text("1 2 3\n4 5 6\n")
    (tmp_path / "room" / "table_1.txt").write_text("7 8 9\n")
    df = io.text_points(spark, str(tmp_path / "room" / "*.txt"), ["x", "y", "z"])
    assert sorted((r["class"], r.instance, r.x) for r in df.collect()) == [("chair", 0, 1.0), ("chair", 0, 4.0), ("table", 1, 7.0)]
    target = str(tmp_path / "out")
    io.publish(df, target)
    assert spark.read.parquet(target).count() == 3
    with pytest.raises(FileExistsError):
        io.publish(df, target)


def test_json_records(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"run": 1}\n{"vid": "a", "m": {"iou": 0.5}}\n')
    assert [r.m.iou for r in io.json_records(spark, str(tmp_path / "log.jsonl"), "vid string, m struct<iou:double>").collect()] == [0.5]
