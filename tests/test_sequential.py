"""Operators that SQL can't express, against plain Python: graph segmentation, one-to-one assignment, greedy matching."""

import itertools
import random
import tempfile

import numpy as np
import pytest

from cloudloom.operators import cluster, neighbors


def plain_segments(edges, k, least):
    """Sets merged in the order of the edges; a set's limit is the last merged weight plus k over its size."""
    sets = {n: frozenset([n]) for a, b, _ in edges for n in (a, b)}
    limit = {n: k for n in sets}
    for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        x, y = sets[a], sets[b]
        if x != y and w <= limit[min(x)] and w <= limit[min(y)]:
            both = x | y
            for n in both:
                sets[n] = both
            limit[min(both)] = w + k / len(both)
    for a, b, _ in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        x, y = sets[a], sets[b]
        if x != y and min(len(x), len(y)) < least:
            for n in x | y:
                sets[n] = x | y
    return {(min(s), n) for n, s in sets.items()}


def test_graph_segments(spark):
    rng = random.Random(2)
    rows = []
    for c in range(6):
        pairs = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(60)}
        rows += [(c, a, b, rng.randint(1, 40) / 8) for a, b in sorted(pairs)]
    got = cluster.segment_graph(spark.createDataFrame(rows, "cloud_id bigint, a bigint, b bigint, weight double"), 3.0, 3).collect()
    for c in range(6):
        own = [(r.segment, r.point_id) for r in got if r.cloud_id == c]
        first = {s: min(p for t, p in own if t == s) for s, _ in own}
        assert {(first[s], p) for s, p in own} == plain_segments([r[1:] for r in rows if r[0] == c], 3.0, 3)
        assert sorted(first, key=first.get) == sorted(first)  # numbered by their first nodes


def test_assignment_is_the_cheapest(spark):
    rng = random.Random(3)
    sizes = [(4, 4), (3, 5), (5, 3), (1, 4)]
    cost = {c: np.array([[rng.randint(0, 50) / 4 for _ in range(m)] for _ in range(n)]) for c, (n, m) in enumerate(sizes)}
    rows = [(c, 10 + i, 20 + j, float(x[i, j])) for c, x in cost.items() for i in range(x.shape[0]) for j in range(x.shape[1])]
    got = cluster.assignment(spark.createDataFrame(rows, "cloud_id bigint, r bigint, c bigint, cost double"), "r", "c", "cost").collect()
    for c, x in cost.items():
        own = [(r.r - 10, r.c - 20) for r in got if r.cloud_id == c]
        n, m = x.shape
        assert len(own) == len({a for a, _ in own}) == len({b for _, b in own}) == min(n, m)
        wide = x if n <= m else x.T
        best = min(sum(wide[i, p] for i, p in enumerate(perm)) for perm in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert sum(x[a, b] for a, b in own) == pytest.approx(best)


def test_clusters_get_the_classes_they_overlap_most(spark):
    rng = random.Random(5)
    rows = [(0, k, rng.randint(0, 4), rng.randint(0, 5)) for k in range(200)]
    df = spark.createDataFrame(rows, "cloud_id bigint, point_id bigint, cluster int, label int")
    got = {r.cluster: r.label for r in cluster.best_assignment(df, "cluster", "label").collect()}
    share = np.zeros((5, 6))
    for _, _, a, b in rows:
        share[a, b] += 1
    assert sum(share[a, b] for a, b in got.items()) == max(sum(share[i, p] for i, p in enumerate(perm)) for perm in itertools.permutations(range(6), 5))


def test_feature_knn_in_small_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (90, 3)).astype(float)
    df = spark.createDataFrame([(k % 2, k, v.tolist()) for k, v in enumerate(x)], "cloud_id bigint, point_id bigint, feat array<double>")
    want = set()
    for g in (0, 1):
        ids = np.arange(g, 90, 2)
        for i in ids:
            d2 = ((x[ids] - x[i]) ** 2).sum(axis=1)
            want |= {(g, int(i), int(ids[j]), n + 1) for n, j in enumerate(np.lexsort((ids, d2))[:4])}
    for block in (4096, 7):
        assert {(r.cloud_id, r.src, r.dst, r.rank) for r in neighbors.feature_knn(df, 4, block=block).collect()} == want


def test_nearest_rows_with_ties():
    rng = np.random.default_rng(2)
    for n, k in ((1, 1), (7, 3), (40, 4), (5, 9), (60, 20), (18, 18)):
        d2 = rng.integers(0, 5, (30, n)).astype(float)
        order, value = neighbors.nearest_rows(d2, k)
        want = np.argsort(d2, axis=1, kind="stable")[:, :k]
        assert np.array_equal(order, want) and np.array_equal(value, np.take_along_axis(d2, want, axis=1))


def test_e25_reads_points_once_and_calls_python_by_batches(spark):
    from cloudloom.plans.catalog import QUERIES
    from tests.conftest import SMALL

    plan = QUERIES["e25_average_precision"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "lineitem" not in plan and "l_suppkey" not in plan


def test_many_small_clouds_share_their_calls(spark, tmp_path, monkeypatch):
    """Farthest points of clouds that begin and end within batches, and kNN with many clouds a call (j17_anchor_patches)."""
    rng = np.random.default_rng(8)
    own = {c: rng.random((n, 3)) for c, n in enumerate([*rng.integers(1, 12, 60).tolist(), 40])}
    df = spark.createDataFrame([(c, i, *map(float, x)) for c, xs in own.items() for i, x in enumerate(xs)], "cloud_id bigint, point_id bigint, x double, y double, z double")
    want = set()
    for c, xs in own.items():
        d2, pick = np.full(len(xs), np.inf), 0
        for rank in range(1, min(4, len(xs)) + 1):
            want.add((c, pick, rank))
            d2 = np.minimum(d2, ((xs - xs[pick]) ** 2).sum(axis=1))
            pick = int(np.argmax(d2))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for rows in ("7", before):
            spark.conf.set(name, rows)
            assert {tuple(r) for r in cluster.farthest_points(df, 4).collect()} == want
    finally:
        spark.conf.set(name, before)
    whole = neighbors._knn_numpy

    def counted(k):
        run = whole(k)

        def call(left, right):
            tempfile.mkstemp(dir=tmp_path)
            return run(left, right)

        return call

    monkeypatch.setattr(neighbors, "_knn_numpy", counted)
    got = {(r.cloud_id, r.src, r["rank"]): r.dst for r in neighbors.knn(df, df, 2).collect()}
    for c, xs in own.items():
        for i, x in enumerate(xs):
            order = np.lexsort((np.arange(len(xs)), ((xs - x) ** 2).sum(axis=1)))[:2]
            assert [got.get((c, i, r)) for r in range(1, len(order) + 1)] == order.tolist()
    assert len(list(tmp_path.iterdir())) == 1
