"""Nearest neighbours by leaves against all distances: even, dense, flat and coincident clouds, and queries in one place."""

import tempfile

import numpy as np
import pytest

from cloudloom.operators import spacetree
from cloudloom.operators.spacetree import neighbour_lists, partition


def clouds(rng):
    yield 1, rng.random((900, 3))
    yield 2, np.concatenate([rng.normal(0, 1e-3, (500, 3)), rng.random((200, 3)) * 1000])  # dense beside sparse
    yield 3, np.column_stack([rng.integers(0, 4, 600), np.zeros(600), np.zeros(600)])  # four places, ties
    yield 4, np.zeros((300, 3))
    yield 5, rng.random((3, 3))
    yield 6, np.exp(rng.normal(0, 4, (400, 3)))


def plain(q, p, k):
    """Ids are places; ties by id."""
    out = {}
    for i, x in enumerate(q):
        d2 = np.zeros(len(p))
        for a in range(3):
            d2 += (x[a] - p[:, a]) ** 2
        order = np.lexsort((np.arange(len(p)), d2))[:k]
        out[i] = (order.tolist(), d2[order].tolist())
    return out


def frame(spark, rows, start=0):
    return spark.createDataFrame([(c, start + i, *map(float, x)) for c, own in rows for i, x in enumerate(own)], "cloud_id bigint, point_id bigint, x double, y double, z double")


@pytest.mark.parametrize("k, leaf", [(5, 32), (20, 64), (1, 2)])
def test_neighbours_of_a_cloud_in_itself(spark, k, leaf):
    rows = list(clouds(np.random.default_rng(k)))
    df = frame(spark, rows)
    got = {(r.cloud_id, r.src): (r.dst, r.d2) for r in neighbour_lists(df, df, k, leaf).collect()}
    want = {(c, i): v for c, own in rows for i, v in plain(own, own, k).items()}
    assert got == want


def test_other_queries_far_and_crowded(spark, monkeypatch):
    from cloudloom.operators import spacetree

    monkeypatch.setattr(spacetree, "PART", 50)
    rng = np.random.default_rng(9)
    points = list(clouds(rng))
    queries = [(c, np.concatenate([np.full((400, 3), 0.5), rng.random((50, 3)) * 3000 - 1000])) for c, _ in points] + [(99, np.zeros((2, 3)))]
    got = {(r.cloud_id, r.src): (r.dst, r.d2) for r in neighbour_lists(frame(spark, queries), frame(spark, points), 4, 32).collect()}
    held = dict(points)
    assert got == {(c, i): v for c, own in queries if c in held for i, v in plain(own, held[c], 4).items()}


def test_outliers_by_lists_are_those_of_edges(spark):
    from cloudloom.operators import neighbors

    df = frame(spark, list(clouds(np.random.default_rng(2))))
    want = neighbors.statistical_outliers(df, neighbors.knn(df, df, 6), 1.0)
    assert sorted(map(tuple, neighbors.outliers_by_lists(df, 6, 1.0).collect())) == sorted(map(tuple, want.collect()))


def test_leaves_are_bounded_and_empty_tables_work(spark):
    df = frame(spark, [(1, np.random.default_rng(0).normal(0, 1, (5000, 3)) ** 3)])
    leaves = partition(df, None, 100)[0].groupBy("leaf").count().collect()
    assert max(r["count"] for r in leaves) <= 100 and len(leaves) < 400
    assert neighbour_lists(df.limit(0), df, 3).count() == 0 and neighbour_lists(df, df.limit(0), 3).count() == 0


def test_small_leaves_share_their_calls(spark, tmp_path, monkeypatch):
    """300 clouds in leaves of 8 points: a call of Python takes many leaves (j1_r19_leaves, j8_skeleton_by_leaves)."""
    calls = tmp_path / "calls"
    calls.mkdir()
    whole = spacetree._lists

    def counted(*args):
        tempfile.mkstemp(dir=calls)
        return whole(*args)

    monkeypatch.setattr(spacetree, "_lists", counted)
    rng = np.random.default_rng(3)
    rows = [(c, rng.random((20, 3))) for c in range(300)]
    df = frame(spark, rows)
    got = {(r.cloud_id, r.src): (r.dst, r.d2) for r in neighbour_lists(df, df, 3, 8).collect()}
    assert got == {(c, i): v for c, own in rows for i, v in plain(own, own, 3).items()}
    assert 0 < len(list(calls.iterdir())) <= 8
