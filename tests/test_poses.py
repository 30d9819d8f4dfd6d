"""Pose chains and boxes against numpy, and rows that lack a part."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import poses


def matrix(q, t):
    w, x, y, z = np.array(q, float) / np.linalg.norm(q)
    m = np.eye(4)
    m[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    m[:3, 3] = t
    return m


def frame(spark, rows, names):
    """Rows of keys and a quaternion with a translation, which become a pose column of the last name."""
    *keys, name = names.split()
    df = spark.createDataFrame([(*r[: len(keys)], *map(float, r[len(keys)] + r[len(keys) + 1])) for r in rows], ", ".join([f"{k} bigint" for k in keys] + [f"_{i} double" for i in range(7)]))
    return df.select(*keys, poses.pose([F.col(f"_{i}") for i in range(4)], [F.col(f"_{i}") for i in range(4, 7)]).alias(name))


RIG = [(1, (2, 0, 1, 1), (0.5, 0, 2)), (2, (1, 1, -1, 3), (-1, 0.25, 1))]
EGO = [(10, 1, (1, 0, 0, 2), (100, 50, 0)), (11, 1, (3, 1, 0, -1), (-20, 5, 1))]
SEEN = [(10, 2, (1, 0, 0.5, 2), (103, 51, 0)), (11, 1, (3, 1, 0, -1), (-20, 5, 1))]


def test_chain_is_the_product_of_matrices(spark):
    rig = frame(spark, RIG, "sensor sensor_pose")
    got = poses.sensor_to_reference(frame(spark, SEEN, "sample sensor vehicle_pose"), rig, frame(spark, EGO, "sample sensor vehicle_pose")).collect()
    cal, ego = {s: matrix(q, t) for s, q, t in RIG}, {s: matrix(q, t) for s, _, q, t in EGO}
    assert len(got) == 2
    for r in got:
        q, t = next((q, t) for s, _, q, t in SEEN if s == r.sample)
        want = np.linalg.inv(cal[1]) @ np.linalg.inv(ego[r.sample]) @ matrix(q, t) @ cal[r.sensor]
        np.testing.assert_allclose(np.array(r.pose[:9]).reshape(3, 3), want[:3, :3], atol=1e-9)
        np.testing.assert_allclose(r.pose[9:], want[:3, 3], atol=1e-9)


def test_chain_without_a_part_is_null(spark):
    rig = frame(spark, RIG, "sensor sensor_pose")
    records = frame(spark, [(10, 7, (1, 0, 0, 0), (0, 0, 0)), (12, 1, (1, 0, 0, 0), (0, 0, 0)), (10, 1, (0, 0, 0, 0), (0, 0, 0))], "sample sensor vehicle_pose")
    got = poses.sensor_to_reference(records, rig, frame(spark, EGO, "sample sensor vehicle_pose")).collect()
    assert [r.pose for r in got] == [None] * 3


def test_as_of_takes_the_latest_and_the_greatest_tie(spark):
    rows = spark.createDataFrame([(1, 0), (1, 5), (1, 7), (1, None), (None, 7), (2, 9), (1, 5)], "k bigint, t bigint")
    history = spark.createDataFrame([(1, 5, "a", 1), (1, 5, "b", 2), (1, 6, None, 1), (1, 8, "d", 1), (1, None, "e", 1), (None, 1, "f", 1)], "k bigint, t bigint, v string, tie bigint")
    got = sorted(map(tuple, poses.as_of(rows, history, ["k"], "t", ["v"], tie="tie").collect()), key=str)
    assert got == sorted([(1, 0, None), (1, 5, "b"), (1, 5, "b"), (1, 7, None), (1, None, None), (None, 7, None), (2, 9, None)], key=str)


def test_velocity_between_neighbours(spark):
    rows = [(1, 0.0, 0.0), (1, 1.0, 2.0), (1, 3.0, 12.0), (1, 9.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 1.0), (3, 1.0, 2.0)]
    df = spark.createDataFrame([(i, t, x, 0.0, 0.0) for i, t, x in rows], "i bigint, t double, x double, y double, z double")
    got = {(r.i, r.t, r.x): r.vx for r in poses.box_velocity(df, "i", ["t", "x"], "t", 2.0).collect()}
    assert got == {(1, 0.0, 0.0): 2.0, (1, 1.0, 2.0): 4.0, (1, 3.0, 12.0): None, (1, 9.0, 0.0): None, (2, 0.0, 1.0): None, (3, 1.0, 1.0): None, (3, 1.0, 2.0): None}


@pytest.mark.parametrize("q", [(1, 0, 0, 1), (2, 0.3, -1, 4), (0, 0, 0, 1)])
def test_boxes_move_as_matrices_do(spark, q):
    box = spark.createDataFrame([(10, 103.0, 52.0, 1.0, [float(v) for v in q], 2.0, 4.0, 1.5, 3.0, -1.0, 0.5, 3), (10, 0.0, 0.0, 0.0, [1.0, 0.0, 0.0, 0.0], 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0)], "sample bigint, x double, y double, z double, q array<double>, w double, l double, h double, vx double, vy double, vz double, n_points int")
    (got,) = poses.boxes_in_sensor(box, frame(spark, EGO, "sample sensor vehicle_pose"), frame(spark, RIG, "sensor sensor_pose")).collect()
    back = np.linalg.inv(matrix(*EGO[0][2:]) @ matrix(*RIG[0][1:]))
    np.testing.assert_allclose([got.cx, got.cy, got.cz], (back @ [103, 52, 1, 1])[:3], atol=1e-9)
    np.testing.assert_allclose([got.vx, got.vy], (back[:3, :3] @ [3, -1, 0.5])[:2], atol=1e-9)
    ahead = back[:3, :3] @ matrix(q, (0, 0, 0))[:3, 0]
    assert math.isclose(math.cos(got.yaw - math.atan2(ahead[1], ahead[0])), 1.0, abs_tol=1e-9)
    assert (got.dx, got.dy, got.dz) == (4.0, 2.0, 1.5)
