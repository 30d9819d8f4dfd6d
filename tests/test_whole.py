"""Whole jobs of the point-cloud operators: cases in which one once did less than asked."""

import pytest

from cloudloom.operators import cluster, neighbors


def test_knn_grid_keeps_isolated_points(spark):
    rows = [(1, k, k * 0.01, 0.0, 0.0) for k in range(20)] + [(1, 99, 100.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "cloud_id bigint, point_id bigint, x double, y double, z double")
    got = neighbors.knn_grid(p, p, 3, 0.01).select("cloud_id", "src", "dst").collect()
    assert {(r.cloud_id, r.src) for r in got} == {(c, i) for c, i, *_ in rows}
    assert {r.dst for r in got if r.src == 99} == {99, 19, 18}


def test_components_raise_when_not_settled(spark):
    nodes = spark.createDataFrame([(1, k) for k in range(40)], "cloud_id bigint, point_id bigint")
    edges = spark.createDataFrame([(1, a, b) for k in range(39) for a, b in ((k, k + 1), (k + 1, k))], "cloud_id bigint, src bigint, dst bigint")
    with pytest.raises(RuntimeError):
        cluster.components(nodes, edges, max_rounds=1)
