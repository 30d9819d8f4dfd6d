"""Forms for crowded and large clouds against plain Python: components by cells, information expected of huge margins."""

import math

import numpy as np
import pytest

from cloudloom.operators import cluster, evaluate

POINTS = "cloud_id bigint, point_id bigint, x double, y double, z double, label int"


def plain_components(rows, radius, least):
    """(cloud, point) -> the cluster's number, by comparing all pairs."""
    root = {r[:2]: r[:2] for r in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(rows):
        for b in rows[:i]:
            usable = all(v is not None and v == v for v in a[2:] + b[2:])
            if a[0] == b[0] and usable and a[5] == b[5] and sum((p - q) ** 2 for p, q in zip(a[2:5], b[2:5])) < radius * radius:
                x, y = sorted((find(a[:2]), find(b[:2])))
                root[y] = x
    members = {}
    for r in rows:
        members.setdefault(find(r[:2]), []).append(r[:2])
    out = {}
    for cloud in {r[0] for r in rows}:
        for n, k in enumerate(sorted(k for k, m in members.items() if k[0] == cloud and len(m) >= least)):
            out |= {m: n for m in members[k]}
    return out


@pytest.mark.parametrize("direct", [0, 4, 1_024])
def test_components_of_crowded_cells(spark, direct):
    """Crowds, equal points, gaps about the radius, points at exactly the radius and negative places; any bound on direct pairs."""
    rng = np.random.default_rng(3)
    places = [rng.normal(c, 0.2, (60, 3)) for c in ((0, 0, 0), (1.45, 0, 0), (-1.7, 0.1, 0), (0, 2.2, 0.4))]
    places += [np.zeros((20, 3)) + 7, np.zeros((20, 3)) + (8, 7, 7), np.zeros((9, 3)) + (9 - 1e-12, 7, 7), rng.uniform(-5, 5, (60, 3)), np.array([[20.0, k, 0] for k in range(5)])]
    p = np.vstack(places)
    rows = [(1 + i % 2, 1000 - i, *map(float, v), int(i % 3 == 0)) for i, v in enumerate(np.vstack([p, p]))]
    rows += [(1, 2000, None, 0.0, 0.0, 1), (1, 2001, math.nan, 0.0, 0.0, 1), (1, 2002, 0.0, 0.0, 0.0, None), (1, 2003, 0.0, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, POINTS)
    for least in (1, 4):
        got = {(r.cloud_id, r.point_id): r.cluster for r in cluster.label_components(df, 1.0, least, direct=direct).collect()}
        assert got == plain_components(rows, 1.0, least)
        if direct != 4:
            break


def test_components_of_an_empty_cloud(spark):
    assert cluster.label_components(spark.createDataFrame([], POINTS), 1.0, 1).count() == 0


def test_a_crowd_makes_no_pairs_of_its_points(spark):
    """100,000 points of two crowds side by side: 10^10 pairs, but some hundred comparisons of cells."""
    from pyspark.sql import functions as F

    df = spark.range(100_000).selectExpr(
        "1L cloud_id", "id point_id", "pmod(id * 7919, 50021) / 100042D + (id % 2) * 0.9 x", "pmod(id * 104729, 50023) / 100046D y", "pmod(id * 1299709, 50033) / 100066D z", "1 label"
    )
    r = cluster.label_components(df, 1.0, 1).agg(F.countDistinct("cluster").alias("k"), F.count("*").alias("n")).first()
    assert (r.k, r.n) == (1, 100_000)


def plain_expected(a, b, t):
    f = math.lgamma
    total = 0.0
    for x in a:
        for y in b:
            for n in range(max(1, x + y - t), min(x, y) + 1):
                odds = f(x + 1) + f(y + 1) + f(t - x + 1) + f(t - y + 1) - f(t + 1) - f(n + 1) - f(x - n + 1) - f(y - n + 1) - f(t - x - y + n + 1)
                total += n / t * math.log(t * n / (x * y)) * math.exp(odds)
    return total


def expected(spark, a, b):
    sizes = lambda v, name: spark.createDataFrame([(k, v.count(k)) for k in sorted(set(v))], f"{name} bigint, {name}_times bigint")
    return evaluate.expected_information(sizes(a, "a"), sizes(b, "b"), spark.createDataFrame([(sum(a),)], "t bigint")).first().emi


def test_expected_information_against_the_whole_sum(spark):
    for a, b in (([5, 5, 1, 9], [10, 10]), ([700, 300, 1, 1, 1], [500, 501, 2]), ([40] * 25, [1] * 1000), ([7], [7])):
        assert expected(spark, a, b) == pytest.approx(plain_expected(a, b, sum(a)), abs=1e-9)


def test_expected_information_of_huge_margins(spark):
    """Close to (k - 1)(c - 1) / 2t, as theory says of large tables."""
    assert expected(spark, [10**8] * 3, [2 * 10**8, 10**8]) == pytest.approx(2 / (2 * 3e8), rel=1e-3)
