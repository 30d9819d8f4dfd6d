"""Brute-force checks of what SQL doesn't express, on tiny clouds."""

import itertools

import numpy as np
import pytest

from cloudloom.operators import cloud, cluster, fuse, grid, neighbors, voxels
from cloudloom.operators.scalar import reorientation


def cloud_of(spark, rows, schema="cloud_id bigint, point_id bigint, x double, y double, z double, label int"):
    return spark.createDataFrame(rows, schema)


def random_cloud(spark, n=80, seed=0, side=6):
    rng = np.random.default_rng(seed)
    rows = [(c, i, *map(float, rng.integers(0, side, 3)), int(rng.integers(0, 2))) for c in (1, 2) for i in range(n)]
    return rows, cloud_of(spark, rows)


def test_components_follow_edges(spark):
    rows, df = random_cloud(spark)
    got = {(r.cloud_id, r.point_id): r.cluster for r in cluster.label_components(df, 1.1, 1).collect()}
    assert len(got) == len(rows)
    parent = {(r[0], r[1]): (r[0], r[1]) for r in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(rows, 2):
        if a[0] == b[0] and a[5] == b[5] and sum((p - q) ** 2 for p, q in zip(a[2:5], b[2:5])) < 1.21:
            x, y = root((a[0], a[1])), root((b[0], b[1]))
            parent[max(x, y)] = min(x, y)
    for a, b in itertools.combinations([(r[0], r[1]) for r in rows], 2):
        if a[0] == b[0]:
            assert (root(a) == root(b)) == (got[a] == got[b])


def test_grid_knn_equals_numpy_form(spark):
    _, df = random_cloud(spark, 60, 3, 30)
    a = {tuple(r) for r in neighbors.knn(df, df, 5).select("cloud_id", "src", "dst", "rank").collect()}
    b = {tuple(r) for r in neighbors.knn_grid(df, df, 5, 4.0).select("cloud_id", "src", "dst", "rank").collect()}
    assert a == b


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for shape in ((4, 4), (3, 5), (5, 3)):
        c = rng.random(shape)
        got = sum(c[i, j] for i, j in cluster._assign(c))
        small = c if shape[0] <= shape[1] else c.T
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
        assert got == pytest.approx(best)


def test_farthest_points(spark):
    df = cloud_of(spark, [(1, 0, 0.0, 0.0, 0.0, 0), (1, 1, 1.0, 0.0, 0.0, 0), (1, 2, 5.0, 0.0, 0.0, 0), (1, 3, 2.0, 0.0, 0.0, 0)])
    assert [r.point_id for r in cluster.farthest_points(df, 3).orderBy("rank").collect()] == [0, 2, 3]


def test_segmentation_merges_light_edges(spark):
    e = spark.createDataFrame([(1, 0, 1, 0.1), (1, 1, 2, 0.1), (1, 2, 3, 5.0), (1, 3, 4, 0.1)], "cloud_id bigint, a bigint, b bigint, weight double")
    seg = {r.point_id: r.segment for r in cluster.segment_graph(e, 1.0, 1).collect()}
    assert seg[0] == seg[1] == seg[2] != seg[3] == seg[4]


def test_dilation_is_a_ball(spark):
    v = spark.createDataFrame([(1, 5, 5, 5), (1, 5, 5, 6)], "cloud_id bigint, i bigint, j bigint, k bigint")
    got = {(r.i, r.j, r.k) for r in voxels.dilate(v, 2).collect()}
    want = {(a, b, c) for a in range(10) for b in range(10) for c in range(10) if min(abs(a - 5) + abs(b - 5) + abs(c - s) for s in (5, 6)) <= 2}
    assert got == want


def test_every_fragment_holds_every_cell(spark):
    _, df = random_cloud(spark)
    cells = grid.cells(df, 3.0)
    per = cells.select(*grid.CELL).distinct().groupBy("cloud_id").count().collect()
    n = {r.cloud_id: r["count"] for r in per}
    for r in grid.fragments(cells).groupBy("cloud_id", "fragment").count().collect():
        assert r["count"] == n[r.cloud_id]


def test_empty_and_single_clouds(spark):
    none = cloud_of(spark, [])
    one = cloud_of(spark, [(1, 1, 2.0, 2.0, 2.0, 0)])
    assert cloud.unit_sphere(none).count() == 0 and neighbors.knn(none, none, 3).count() == 0
    assert [tuple(r)[2:5] for r in cloud.unit_sphere(one).collect()] == [(0.0, 0.0, 0.0)]
    assert neighbors.statistical_outliers(one, neighbors.knn(one, one, 3), 1.0).count() == 0


def test_average_precision_with_overlapping_guesses(spark):
    guesses = spark.createDataFrame([(1, 1, 0, 0.9, 10, 0), (1, 2, 0, 0.8, 10, 0), (1, 3, 0, 0.7, 10, 0)], "cloud_id bigint, inst bigint, class int, score double, size int, void int")
    truth = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 0, 10)], "cloud_id bigint, gt bigint, class int, size int")
    overlaps = spark.createDataFrame([(1, 1, 1, 9), (1, 2, 1, 8), (1, 3, 2, 9)], "cloud_id bigint, inst bigint, gt bigint, inter int")
    # 0.9 and 0.7 win the truths, 0.8 is a second guess of the first: points (2/3, 1), (1/2, 1/2), (1, 1/2), then (1, 0)
    assert cluster.average_precision(guesses, truth, overlaps, [0.5]).first().ap == pytest.approx(2 / 3 * 0.25 + 0.5 * 0.25 + 0.25 + 0.25)


def test_reorientation_round_trip():
    assert reorientation("RAS", "LPS") == ([0, 1, 2], [True, True, False])
    order, _ = reorientation("RAS", "PIR")
    assert order == [1, 2, 0]


def test_run_lengths(spark):
    df = spark.createDataFrame([(1, i, 7) for i in (1, 2, 3, 6, 9, 10)], "cloud_id bigint, point_id bigint, instance int")
    assert fuse.run_lengths(df, "instance").first().rle == "1 3 6 1 9 2"


def test_streams_equal_batch(spark, tmp_path):
    from cloudloom.streaming import metrics as m
    from cloudloom.streaming import stateful

    rows = [(1, "a", i, float(v)) for i, v in enumerate([3, 1, 4, 1, 5])]
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "run bigint, name string, iter bigint, value double")
    df.write.parquet(src)
    q = m.smoothed_stream(spark.readStream.schema(df.schema).parquet(src), 3).writeStream.format("memory").queryName("smoothed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    got = {(r.iter, r.mean, r.median) for r in spark.sql("select * from smoothed").collect()}
    assert got == {(r.iter, r.mean, r.median) for r in m.smoothed(df, 3).collect()}
    q = stateful.incremental_build(spark.readStream.schema(df.schema).parquet(src), lambda d: d.where("value > 1"), str(tmp_path / "out"), str(tmp_path / "cp2"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_hilbert_steps_to_a_neighbour():
    from cloudloom.operators.curves import hilbert_codes

    for bits in (1, 2, 3):
        n = 1 << bits
        grid3 = np.array(list(itertools.product(range(n), repeat=3)))
        code = hilbert_codes(grid3, bits)
        assert sorted(code) == list(range(n**3))
        walk = grid3[np.argsort(code)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
