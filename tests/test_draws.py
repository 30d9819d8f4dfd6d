"""Draws use every bit of every key, and the noise of a field varies along each axis."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.functions.random import draw, drawn
from cloudloom.operators import augment


def test_two_million_ids_have_a_draw_each(spark):
    got = spark.range(2_000_000).withColumn("cloud_id", F.lit(7)).select(draw(3, "cloud_id", "id").alias("d")).toArrow()["d"].to_numpy()
    assert len(np.unique(got)) == 2_000_000 and 0 <= got.min() and got.max() < 1
    counts = np.histogram(got, 1000, (0, 1))[0]
    assert ((counts - 2000) ** 2 / 2000).sum() / 999 < 1.3
    assert abs(np.corrcoef(got[:-1], got[1:])[0, 1]) < 0.005


@pytest.mark.parametrize("shift", [20, 31, 40, 62])
def test_high_bits_and_clouds_count(spark, shift):
    rows = spark.range(1000).selectExpr("id", f"id + (1L << {shift}) AS far", "1 AS one", "2 AS two")
    got = rows.select(draw(3, "one", "id"), draw(3, "one", "far"), draw(3, "two", "id"), draw(4, "one", "id")).toPandas()
    assert len(set(got.to_numpy().ravel())) == 4000


@pytest.mark.parametrize("axis", ["x", "y", "z"])
def test_elastic_noise_varies_along_each_axis(spark, axis):
    row = spark.range(12).selectExpr("0L cloud_id", "id point_id", *[f"{'8.0 * id' if a == axis else 'cast(0 as double)'} {a}" for a in "xyz"])
    moved = augment.elastic(row, 4.0, 8.0, 70).orderBy("point_id").toPandas()
    before = {a: 8.0 * np.arange(12) if a == axis else np.zeros(12) for a in "xyz"}
    for a in "xyz":
        assert np.std(moved[a] - before[a]) > 0.05, a


@pytest.mark.parametrize("turn", [-0.5, -0.2, 0.0, 0.31, 0.5])
def test_hue_as_the_standard_library_has_it(spark, turn):
    import colorsys

    colours = [(255.0, 0.0, 0.0), (0.0, 255.0, 0.0), (12.0, 200.0, 201.0), (40.0, 40.0, 40.0), (0.0, 0.0, 0.0), (90.0, 3.0, 90.0), (7.0, 7.0, 250.0)]
    df = spark.createDataFrame(colours, "r double, g double, b double")
    got = df.select("r", "g", "b", *[c.alias(f"new_{n}") for n, c in zip("rgb", augment.turn_hue([F.col(c) for c in "rgb"], F.lit(turn)))]).collect()
    for r in got:
        h, s, v = colorsys.rgb_to_hsv(r.r / 255, r.g / 255, r.b / 255)
        assert (r.new_r, r.new_g, r.new_b) == pytest.approx(tuple(255 * c for c in colorsys.hsv_to_rgb((h + turn) % 1.0, s, v)), abs=1e-6)


def test_jitter_draws_every_order_and_leaves_out_steps(spark):
    rows = spark.range(2000).select(F.col("id").alias("cloud_id"), F.lit(1).alias("point_id"), F.lit(200.0).alias("r"), F.lit(90.0).alias("g"), F.lit(20.0).alias("b"))
    assert augment.random_colour_jitter(rows, 5).exceptAll(rows).isEmpty()
    assert augment.random_colour_jitter(rows, 5, (0.5, 0.6), p=0.0).exceptAll(rows).isEmpty()
    # brightness cuts to 255 before or after saturation: both orders occur
    two = augment.random_colour_jitter(rows, 5, brightness=(2.0, 2.0), saturation=(0.0, 0.0), p=1.0).groupBy(F.round("r").alias("r")).count().collect()
    first, last = 0.2989 * 255 + 0.587 * 180 + 0.114 * 40, 2 * (0.2989 * 200 + 0.587 * 90 + 0.114 * 20)
    assert {r.r for r in two} == {round(first), round(last)} and min(r["count"] for r in two) > 900
    with pytest.raises(ValueError):
        augment.random_colour_jitter(rows, 5, hue=(-0.6, 0.1))


def test_elastic_rounds_leave_closed_clouds_alone(spark):
    rows = spark.range(400).select((F.col("id") % 40).alias("cloud_id"), F.col("id").alias("point_id"), *[(F.col("id") * k % 7).cast("double").alias(a) for k, a in ((1, "x"), (3, "y"), (5, "z"))])
    assert augment.elastic_rounds(rows, ((2.0, 1.0),), 0.0, 3).exceptAll(rows).isEmpty()
    moved = augment.elastic_rounds(rows, ((2.0, 1.0),), 0.5, 3).join(rows.withColumnRenamed("x", "old"), ["cloud_id", "point_id"]).groupBy("cloud_id").agg(F.max(F.abs(F.col("x") - F.col("old"))).alias("d")).collect()
    assert len(moved) == 40 and 8 < sum(r.d > 0 for r in moved) < 32


def test_colour_steps_share_their_parts(spark):
    """Hue's place on the circle is worked out once a step and not in each channel (p44_random_colour_jitter)."""
    df = spark.range(9).selectExpr("id % 2 cloud_id", "id point_id", "double(id * 20) r", "double(id * id) g", "double(7 * id) b")
    out = augment.random_colour_jitter(df, 440, (0.6, 1.4), (0.6, 1.4), (0.5, 1.5), (-0.3, 0.3), p=0.7)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # a sort by a lambda isn't compiled
    assert max(line.count("CASE WHEN ((") for line in plan.splitlines()) <= 3
    assert 0 < plan.count("AS _sixth") <= 4


def test_drawn_as_the_expression_has_it(spark):
    keys = [0, 1, 5, 2147483646, 2147483647, 1 << 31, (1 << 62) + 3, -1, -(1 << 40)]
    rows = spark.createDataFrame([(k, j) for j, k in enumerate(keys)], "a bigint, b bigint")
    got = rows.select(draw(7, "a", "b", "a", "b").alias("d"), "a", "b").toPandas()
    assert np.abs(got.d - drawn(7, *(got[c].to_numpy() for c in "abab"))).max() < 1e-11  # the expression divides decimals


def test_elastic_shuffles_points_alone(spark):
    """r29_elastic: neither corners nor nodes are shuffled, and no table is written."""
    import os

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    rows, before = spark.range(400).selectExpr("id % 4 cloud_id", "id point_id", "double(id % 50) x", "double(id % 11) y", "double(id % 9) z"), set(os.listdir(folder))
    plan = augment.elastic(rows, 4.0, 8.0, 70)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Generate" not in plan
    assert plan.count("ArrowEvalPython") == 1
    assert set(os.listdir(folder)) == before


def test_elastic_moves_by_parts_and_far_apart():
    rng = np.random.default_rng(5)
    clouds, at = np.sort(rng.integers(-2, 3, 300)), rng.integers(0, 40, (3, 300)) / 4 + 1
    sizes = np.full((3, 300), 13)
    whole = augment._elastic_moves(clouds, at, sizes, 70)
    parts = [augment._elastic_moves(clouds[k : k + 7], at[:, k : k + 7], sizes[:, k : k + 7], 70) for k in range(0, 300, 7)]
    assert np.array_equal(whole, np.concatenate(parts, axis=1)) and np.abs(whole).max() > 0.1
    far = rng.integers(0, 1 << 50, (4, 50)) * np.array([[0], [1], [1], [1]])  # too far apart for one number
    for nodes in (far, np.concatenate([far, far[:, :9]], axis=1), far[:, :0]):
        kept, place = augment._distinct(nodes)
        assert np.array_equal(kept[:, place], nodes) and kept.shape[1] == len({*map(tuple, nodes.T.tolist())})


def test_elastic_leaves_points_without_a_coordinate(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 9.0, 9.0, 9.0), (1, 3, None, 5.0, 5.0), (None, 4, 1.0, 1.0, 1.0)], "cloud_id bigint, point_id bigint, x double, y double, z double")
    got = {r.point_id: r for r in augment.elastic(rows, 4.0, 8.0, 70).collect()}
    assert (got[3].x, got[3].y, got[3].z) == (None, 5.0, 5.0) and got[4].x == 1.0 and got[1].x != 0.0


def test_elastic_rounds_shuffle_points_once_a_round(spark):
    """r29_elastic_rounds: a later round reads the earlier one's points as they come, without a table or a join."""
    rows = spark.range(400).selectExpr("id % 4 cloud_id", "id point_id", "double(id % 50) x", "double(id % 11) y", "double(id % 9) z")
    plan = augment.elastic_rounds(rows, ((4.0, 2.0), (16.0, 6.0)), 0.6, 291)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Join" not in plan and "Generate" not in plan
    assert plan.count("ArrowEvalPython") == 2
