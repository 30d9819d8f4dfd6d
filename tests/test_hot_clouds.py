"""Forms for clouds that no task should hold give what the plain forms give, and read less."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudloom.functions.ranking import rank_within
from cloudloom.operators import cloud, cluster, farthest, neighbors

SCHEMA = "cloud_id bigint, point_id bigint, x double, y double, z double"


def made(spark, clouds, seed=1, lattice=False):
    """Clouds of the given sizes, uneven in space; ids in no order."""
    rng = np.random.default_rng(seed)
    parts = []
    for c, n in clouds.items():
        x = rng.normal(size=(n, 3)) * [5, 2, 1] + rng.integers(0, 3, size=(n, 1)) * 20
        parts.append(pd.DataFrame({"cloud_id": c, "point_id": rng.permutation(n) * 3, **dict(zip("xyz", (np.round(x / 4) if lattice else x).T))}))
    pdf = pd.concat(parts)
    return spark.createDataFrame(pdf.assign(label=(pdf.point_id % 4).astype("int32"), instance=(pdf.point_id % 3).astype("int32") - 1), SCHEMA + ", label int, instance int")


@pytest.mark.parametrize("lattice, n", [(False, 60), (True, 12)])
def test_farthest_points_as_in_one_task(spark, lattice, n):
    p = made(spark, {1: 6000, 2: 300, 3: 5, 4: 1}, lattice=lattice)
    want = cluster.farthest_points(p, n).toPandas().sort_values(["cloud_id", "rank"])
    got = farthest.farthest_points(p, n, leaf=128, top=8).toPandas().sort_values(["cloud_id", "rank"])
    np.testing.assert_array_equal(got.to_numpy(), want.to_numpy())


def test_farthest_points_of_one_place_of_none_and_without_a_place(spark):
    same = spark.createDataFrame([(1, k, 2.0, 2.0, 2.0) for k in range(50)] + [(2, 1, None, 0.0, 0.0), (2, 2, 1.0, 0.0, 0.0)], SCHEMA)
    got = sorted(map(tuple, farthest.farthest_points(same, 3, leaf=8, top=4).collect()))
    assert got == [(1, 0, 1), (1, 0, 2), (1, 0, 3), (2, 2, 1)]
    assert farthest.farthest_points(same.limit(0), 3).isEmpty()
    assert farthest.farthest_points(same, 0).isEmpty()


def test_a_rounds_bounds_prove_many_picks(spark, monkeypatch):
    rounds = []
    real = farthest.materialise
    monkeypatch.setattr(farthest, "materialise", lambda df: (rounds.append(df.columns), real(df))[1])
    farthest.farthest_points(made(spark, {1: 6000}), 60, leaf=128, top=8).count()
    assert sum("rank" in c for c in rounds) < 40  # 60 picks, the first from the start


def test_mining_by_boxes(spark):
    p = made(spark, {1: 6000, 2: 40})
    a = neighbors.drawn_anchors(p, 3, 5)
    want = neighbors.mine_pairs(p, a, 4).orderBy("cloud_id", "anchor", "positive", "rank").collect()
    assert neighbors.mine_pairs_by_boxes(p, a, 4, leaf=64).orderBy("cloud_id", "anchor", "positive", "rank").collect() == want


def test_pairs_read_hardly_grow_with_the_cloud(spark, monkeypatch):
    seen = []
    real = neighbors.promising_boxes
    monkeypatch.setattr(neighbors, "promising_boxes", lambda *args: seen.append(real(*args)) or seen[-1])
    for n in (6000, 48_000):
        p = made(spark, {1: n})
        neighbors.mine_pairs_by_boxes(p, neighbors.drawn_anchors(p, 3, 5), 4, leaf=64)
    small, large = (f[1].agg(F.sum("n")).first()[0] for f in seen)
    assert small < 0.1 * 6000 * 12  # anchors: three of each of four classes
    assert large < 2 * small  # of eight times the pairs


def test_mining_leaves_out_rows_without_class_or_place(spark):
    rows = [(1, k, float(k), 0.0, 0.0, k % 2) for k in range(8)] + [(1, 90, 50.0, 0.0, 0.0, None), (1, 91, None, 0.0, 0.0, 1)]
    p = spark.createDataFrame(rows, SCHEMA + ", label int")
    got = neighbors.mine_pairs_by_boxes(p, p.where("point_id in (0, 91)"), 2).collect()
    assert {(r.anchor, r.point_id, r.positive) for r in got} == {(0, 6, True), (0, 4, True), (0, 1, False), (0, 3, False)}


def test_skeletons_by_leaves(spark):
    p = made(spark, {1: 4000, 2: 30})
    s = p.where("point_id % 7 = 0 and instance >= 0 and not (cloud_id = 2 and instance = 1)")
    key = ["cloud_id", "point_id"]
    assert neighbors.nearest_skeleton_by_leaves(p, s).orderBy(key).collect() == neighbors.nearest_skeleton(p, s).orderBy(key).collect()


def test_ranks_of_a_hot_key_are_many_tasks_work(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, 5), (None, 4)], "k bigint, v bigint"))
    got = rank_within(df, "k", ["v"], "r").toPandas()
    assert len(got) == 20_002
    assert (got.sort_values(["k", "v"]).groupby("k", dropna=False).cumcount() + 1 == got.sort_values(["k", "v"])["r"]).all()
    assert rank_within(df.limit(0), "k", ["v"], "r").isEmpty()


@pytest.mark.parametrize("n", [0, 4, 100])
def test_samples_by_ranges(spark, n):
    p = made(spark, {1: 50, 2: 3, 3: 100})
    for f in (cloud.limit_points, cloud.sample_points):
        one, other = (f(p, n, 3, large=large) for large in (False, True))
        assert one.select(sorted(one.columns)).exceptAll(other.select(sorted(one.columns))).isEmpty() and one.count() == other.count()
