"""Neighbourhoods (J1-J19, R19): spatial joins as equi-joins on cells, or numpy within one small cloud at a time.

Ranked edges of a cloud of at most SMALL points are one task's work. Larger clouds are searched by leaves of an adaptive partition
(spacetree), whose leaves hold equally many points wherever they lie; neighbour lists take that way for all clouds. A radius search is one
join on (cloud, cell) keys.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.ranking import global_rank
from cloudloom.functions.tables import materialise
from cloudloom.operators.spacetree import FEW, LEAF, call_number, groups, neighbour_lists, partition

#: Points of a cloud up to which a task may hold all its distances (blocks of 128 rows, so a few MB at once).
SMALL = 3_000
AXES = ("x", "y", "z")
EDGES = "cloud_id bigint, src bigint, dst bigint, d2 double, rank int"


def _cell(radius: float) -> dict[str, Column]:
    return {f"c{a}": F.floor(F.col(a) / (2.0 * radius)) for a in AXES}


def asked_cells(queries: DataFrame, radius: float, carry: Sequence[str], same: bool) -> DataFrame:
    """Queries with each cell that their ball reaches, about eight; of a cloud with itself (``same``) its own cell and later ones."""
    own = {f"_{k}": v for k, v in _cell(radius).items()}
    out = queries.select("cloud_id", F.col("point_id").alias("src"), *AXES, *[F.col(c).alias(f"src_{c}") for c in carry], *[v.alias(k) for k, v in own.items()])
    for a in AXES:
        first = F.col("_cx") if same and a == "x" else F.floor((F.col(a) - radius) / (2.0 * radius))
        out = out.withColumn(f"c{a}", F.explode(F.sequence(first, F.floor((F.col(a) + radius) / (2.0 * radius)))))
    at, home = F.struct(*[f"c{a}" for a in AXES]), F.struct(*own)
    out = out.where(at >= home) if same else out
    return out.withColumn("_own", at == home).drop(*own)


def radius_edges(queries: DataFrame, points: DataFrame, radius: float, include_self: bool = True, closed: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """All (src, dst, d2) of a cloud nearer than the radius, by cells of twice that size. Of a cloud with itself a point asks
    its own cell and later ones only, and what is found in those goes both ways.

    Columns to ``carry`` come along from both ends, as src_ and dst_ and their name; they spare joins of the edges with the points.
    """
    same, cell = queries is points, _cell(radius)
    near = points.select("cloud_id", F.col("point_id").alias("dst"), *[F.col(a).alias(f"_{a}") for a in AXES], *[F.col(c).alias(f"dst_{c}") for c in carry], *[v.alias(k) for k, v in cell.items()])
    d2 = sum(((F.col(a) - F.col(f"_{a}")) ** 2 for a in AXES), F.lit(0.0))
    out = asked_cells(queries, radius, carry, same).join(near, ["cloud_id", *cell]).withColumn("d2", d2)
    out = out.where(F.col("d2") <= radius * radius if closed else F.col("d2") < radius * radius)
    found = ["src", "dst", *[f"{e}_{c}" for e in ("src", "dst") for c in carry]]
    if same:
        back = ["dst", "src", *[f"{e}_{c}" for e in ("dst", "src") for c in carry]]
        one, other = F.struct(*found), F.struct(*[F.col(b).alias(f) for b, f in zip(back, found)])
        both = F.when(F.col("_own"), F.array(one)).otherwise(F.array(one, other))  # within a cell both orders meet anyway
        out = out.select("cloud_id", "d2", F.explode(both).alias("e")).select("cloud_id", "e.*", "d2")
    return (out if include_self else out.where("src <> dst")).select("cloud_id", "src", "dst", "d2", *found[2:])


def ranked(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each source, ties to the smaller id."""
    w = Window.partitionBy("cloud_id", "src").orderBy("d2", "dst")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ball_query(queries: DataFrame, points: DataFrame, samples: int, radius: float, least: float = 0.0) -> DataFrame:
    """Neighbours between two radii (coincident points count), by distance; of more than ``samples`` evenly spread
    ranks stay."""
    edges = radius_edges(queries, points, radius).where((F.col("d2") >= least * least) | (F.col("d2") <= 1e-5))
    w = Window.partitionBy("cloud_id", "src")
    out = edges.withColumns({"_r": F.row_number().over(w.orderBy("d2", "dst")) - 1, "_n": F.count("*").over(w)})
    slot = F.when(F.col("_n") <= samples, F.col("_r")).otherwise(F.ceil(F.col("_r") * samples / F.col("_n")))
    chosen = (F.col("_n") <= samples) | ((slot < samples) & (F.floor(slot * F.col("_n") / samples) == F.col("_r")))
    return out.withColumn("rank", slot.cast("int") + 1).where(chosen).drop("_r", "_n")


def random_ball_query(queries: DataFrame, points: DataFrame, samples: int, radius: float, seed: int, carry: Sequence[str] = ()) -> DataFrame:
    """Neighbours within the radius in a drawn order, the first of them; columns to ``carry`` as in radius_edges."""
    from cloudloom.functions.random import draw

    w = Window.partitionBy("cloud_id", "src").orderBy(draw(seed, "cloud_id", "src", "dst"), "dst")
    return radius_edges(queries, points, radius, carry=carry).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= samples)


def ball_group(queries: DataFrame, points: DataFrame, samples: int, radius: float, seed: int, columns: Sequence[str]) -> DataFrame:
    """The neighbours of random_ball_query with their place relative to the query (dx, dy, dz) and their columns."""
    e = random_ball_query(queries, points, samples, radius, seed, [*AXES, *columns])
    return e.select("cloud_id", "src", "dst", "d2", "rank", *[(F.col(f"dst_{a}") - F.col(f"src_{a}")).alias(f"d{a}") for a in AXES], *[F.col(f"dst_{c}").alias(c) for c in columns])


def nearest_rows(d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the k least values of each row, in order, ties to the smaller place, and the values."""
    k = min(k, d2.shape[1])
    if k <= 16:  # the first of equal least values is the one of the smaller place
        rows, d2 = np.arange(len(d2)), d2.copy()
        order, value = np.empty((len(d2), k), np.int64), np.empty((len(d2), k))
        for n in range(k):
            order[:, n] = d2.argmin(axis=1)
            value[:, n] = d2[rows, order[:, n]]
            d2[rows, order[:, n]] = np.inf
        return order, value
    if k == d2.shape[1]:
        order = np.argsort(d2, axis=1, kind="stable")
        return order, np.take_along_axis(d2, order, axis=1)
    limit = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero(d2 <= limit)  # at least k a row; more where the last value is tied
    value = d2[row, col]
    order = np.lexsort((value, row))  # stable: equal values stay in the order of places
    row, col, value = row[order], col[order], value[order]
    first = np.searchsorted(row, np.arange(len(d2)))
    at = first[:, None] + np.arange(k)
    return col[at], value[at]


def _knn_numpy(k: int):
    """The edges of the clouds of a call."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, p = (t.sort_by([(c, "ascending") for c in names]) for t, names in ((left, ("q_cloud_id", "q_point_id")), (right, ("cloud_id", "point_id"))))
        x, y = ([t[prefix + c].to_numpy() for c in AXES] for t, prefix in ((q, "q_"), (p, "")))
        ids, held, found = p["point_id"].to_numpy(), groups(p, ["cloud_id"]), []
        for cloud, (start, end) in groups(q, ["q_cloud_id"]).items():
            if cloud not in held:
                continue
            of = slice(*held[cloud])
            for at in range(start, end, 128):  # a block stays in a core's cache
                to = min(at + 128, end)
                d2 = np.zeros((to - at, of.stop - of.start))
                one = np.empty_like(d2)
                for a, b in zip(x, y):
                    np.subtract(a[at:to, None], b[None, of], out=one)
                    one *= one
                    d2 += one
                order, d2 = nearest_rows(d2, k)
                n = order.shape[1]
                found.append((np.repeat(np.arange(at, to), n), ids[of][order.ravel()], d2.ravel(), np.tile(np.arange(1, n + 1, dtype=np.int32), to - at)))
        src, dst, d2, rank = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int32))
        asked = q.select(["q_cloud_id", "q_point_id"]).take(pa.array(src))
        return pa.table([asked["q_cloud_id"], asked["q_point_id"], dst, d2, rank], ["cloud_id", "src", "dst", "d2", "rank"])

    return run


def knn(queries: DataFrame, points: DataFrame, k: int, cell: float | None = None) -> DataFrame:
    """The k nearest points of the same cloud for every query: (cloud_id, src, dst, d2, rank), ties to the
    smaller id. Clouds of more than SMALL points are searched by leaves of an adaptive partition, or by cells of ``cell`` if that is given.
    The sides are written to the shared folder first, so that what they are made of is worked out once."""
    from cloudloom.functions.tables import materialise

    columns = ["cloud_id", "point_id", *AXES]
    slim = lambda df: materialise(df.select(F.col("cloud_id").cast("bigint").alias("cloud_id"), F.col("point_id").cast("bigint").alias("point_id"), *[F.col(a).cast("double").alias(a) for a in AXES]))
    same = queries is points
    points = slim(points)
    queries = points if same else slim(queries)
    sizes = points.groupBy("cloud_id").agg(F.count("*").alias("_n"), *[(F.max(a) - F.min(a)).alias(f"_e{a}") for a in AXES])
    big = sizes.where(F.col("_n") > SMALL)
    any_big = not big.isEmpty()
    placed = " and ".join(f"{a} is not null" for a in AXES)  # a row without a place has no distances
    small_p, small_q = points.where(placed), queries.where(placed)
    if any_big:
        small_p, small_q = (df.join(big.select("cloud_id"), "cloud_id", "left_anti") for df in (small_p, small_q))
    rows = points.count() if same else points.count() + queries.count()
    asked = small_q.select(*[F.col(c).alias(f"q_{c}") for c in columns], call_number(rows, "cloud_id").alias("_q_call"))  # other names, as both may come from one frame
    held = small_p.withColumn("_call", call_number(rows, "cloud_id"))
    out = asked.groupBy("_q_call").cogroup(held.groupBy("_call")).applyInArrow(_knn_numpy(k), EDGES)
    if not any_big:
        return out
    keep_p, keep_q = (df.select(*columns).join(big.select("cloud_id"), "cloud_id", "left_semi") for df in (points, queries))
    if cell is not None:
        return out.unionByName(knn_grid(keep_q, keep_p, k, cell).select("cloud_id", "src", "dst", "d2", "rank"))
    return out.unionByName(exploded(neighbour_lists(keep_q, keep_q if same else keep_p, k)))


def exploded(lists: DataFrame) -> DataFrame:
    """Neighbour lists as edges."""
    out = lists.select("cloud_id", "src", F.posexplode(F.arrays_zip("dst", "d2")).alias("rank", "e"))
    return out.select("cloud_id", "src", "e.dst", "e.d2", (F.col("rank") + 1).alias("rank"))


def knn_grid(queries: DataFrame, points: DataFrame, k: int, cell: float, rounds: int = 64) -> DataFrame:
    """J1 for large clouds: search 27 cells; a query whose kth neighbour is no farther than the searched block reaches is
    proven, the rest search cells of twice the size, until the block covers the query's own cloud. Raises if queries
    are left after so many rounds."""
    from cloudloom.functions.tables import discard, materialise

    placed = " and ".join(f"{a} is not null" for a in AXES)  # a row without a place has no distances
    points, queries = points.where(placed), queries.where(placed)
    total = points.groupBy("cloud_id").agg(F.count("*").alias("_n"))
    both = points.select("cloud_id", *AXES).unionByName(queries.select("cloud_id", *AXES))
    reach = both.groupBy("cloud_id").agg(F.greatest(*[F.max(a) - F.min(a) for a in AXES]).alias("_reach"))
    total = materialise(total.join(reach, "cloud_id"))
    left, found, size = queries.join(total.select("cloud_id"), "cloud_id", "left_semi"), None, cell
    for _ in range(rounds):
        edges = materialise(ranked(radius_edges_block(left, points, size), k))
        proof = edges.groupBy("cloud_id", "src").agg(F.count("*").alias("_hits"), F.max("d2").alias("_far")).join(total, "cloud_id")
        done = (F.col("_hits") >= F.least(F.lit(k), F.col("_n"))) & ((F.col("_far") <= size * size) | (F.col("_reach") <= size))
        proven = proof.where(done).select("cloud_id", "src")
        part = edges.join(proven, ["cloud_id", "src"], "left_semi")
        found = part if found is None else found.unionByName(part)
        asked, left = left, materialise(left.join(proven.withColumnRenamed("src", "point_id"), ["cloud_id", "point_id"], "left_anti"))
        if hasattr(asked, "_written"):
            discard(asked)
        if left.isEmpty():
            return found
        size *= 2
    raise RuntimeError(f"knn_grid: queries are left after {rounds} rounds from cells of {cell}")


def radius_edges_block(queries: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """All points in the 27 cells around each query; whatever is within ``size`` of it is among them."""
    near = points.select("cloud_id", F.col("point_id").alias("dst"), *[F.col(a).alias(f"_{a}") for a in AXES], *[F.floor(F.col(a) / size).alias(f"c{a}") for a in AXES])
    around = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("ijk", (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    asked = queries.select("cloud_id", F.col("point_id").alias("src"), *AXES, around.alias("o"))
    asked = asked.select("cloud_id", "src", *AXES, *[(F.floor(F.col(a) / size) + F.col(f"o.{k}")).alias(f"c{a}") for a, k in zip(AXES, "ijk")])
    d2 = sum(((F.col(a) - F.col(f"_{a}")) ** 2 for a in AXES), F.lit(0.0))
    return asked.join(near, ["cloud_id", "cx", "cy", "cz"]).select("cloud_id", "src", "dst", d2.alias("d2"))


def match_within(edges: DataFrame, radius: float) -> DataFrame:
    """The nearest neighbour, where it's near enough."""
    return edges.where((F.col("rank") == 1) & (F.col("d2") <= radius * radius))


def pick_pairs(edges: DataFrame, radius: float, most: int, seed: int) -> DataFrame:
    """One drawn neighbour within the radius for each source, then at most so many pairs of each cloud, by draw."""
    from cloudloom.functions.random import draw

    one = Window.partitionBy("cloud_id", "src").orderBy(draw(seed, "cloud_id", "src", "dst"), "dst")
    cap = Window.partitionBy("cloud_id").orderBy(draw(seed + 1, "cloud_id", "src"), "src")
    pairs = edges.where(F.col("d2") <= radius * radius).withColumn("_r", F.row_number().over(one)).where("_r = 1")
    return pairs.withColumn("_c", F.row_number().over(cap)).where(F.col("_c") <= most).drop("_r", "_c")


def nearest_skeleton(points: DataFrame, skeleton: DataFrame) -> DataFrame:
    """The nearest skeleton point of the point's own instance (-1 for background), ties to the smaller id."""
    s = skeleton.select("cloud_id", "instance", F.col("point_id").alias("skeleton_id"), *[F.col(a).alias(f"_{a}") for a in AXES])
    d2 = sum(((F.col(a) - F.col(f"_{a}")) ** 2 for a in AXES), F.lit(0.0))
    hits = points.where("instance >= 0").join(s, ["cloud_id", "instance"]).withColumn("_d2", d2)
    best = hits.groupBy("cloud_id", "point_id").agg(F.min(F.struct("_d2", "skeleton_id")).alias("b"))
    return points.select("cloud_id", "point_id").join(best, ["cloud_id", "point_id"], "left").select("cloud_id", "point_id", F.coalesce("b.skeleton_id", F.lit(-1)).alias("skeleton_id"))


def nearest_skeleton_by_leaves(points: DataFrame, skeleton: DataFrame) -> DataFrame:
    """J8, as ``nearest_skeleton`` gives it, for large instances: each is searched as a cloud of its own, by leaves. Points without a
    place have no skeleton point."""
    groups = materialise(global_rank(skeleton.where("instance >= 0").select("cloud_id", "instance").distinct(), ["cloud_id", "instance"], "_group"))
    few = groups.limit(FEW + 1).count() <= FEW
    alone = lambda df: df.join(F.broadcast(groups) if few else groups, ["cloud_id", "instance"]).select(F.col("_group").alias("cloud_id"), "point_id", *AXES)
    lists = neighbour_lists(alone(points.where("instance >= 0")), alone(skeleton), 1)
    best = lists.select(F.col("cloud_id").alias("_group"), F.col("src").alias("point_id"), F.get("dst", F.lit(0)).alias("skeleton_id")).join(groups, "_group").drop("_group", "instance")
    return points.select("cloud_id", "point_id").join(best, ["cloud_id", "point_id"], "left").select("cloud_id", "point_id", F.coalesce("skeleton_id", F.lit(-1)).alias("skeleton_id"))


def gather(edges: DataFrame, points: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The neighbours' columns on the edges."""
    return edges.join(points.select("cloud_id", F.col("point_id").alias("dst"), *columns), ["cloud_id", "dst"])


def relative(edges: DataFrame, queries: DataFrame, points: DataFrame) -> DataFrame:
    """Each neighbour's coordinates from its source's."""
    out = gather(edges, points, AXES)
    own = queries.select("cloud_id", F.col("point_id").alias("src"), *[F.col(a).alias(f"_{a}") for a in AXES])
    return out.join(own, ["cloud_id", "src"]).withColumns({f"d{a}": F.col(a) - F.col(f"_{a}") for a in AXES}).drop(*AXES, "_x", "_y", "_z")


def dilated(edges: DataFrame, k: int, dilation: int) -> DataFrame:
    """Every (dilation + 1)th of the nearest neighbours, k of them."""
    step = dilation + 1
    out = edges.where(((F.col("rank") - 1) % step == 0) & (F.col("rank") <= 1 + (k - 1) * step))
    return out.withColumn("rank", ((F.col("rank") - 1) / step).cast("int") + 1)


def interpolate(edges: DataFrame, points: DataFrame, value: str, eps: float = 1e-8) -> DataFrame:
    """Mean of the neighbours' value, weighted by inverse distance."""
    w = 1 / (F.sqrt("d2") + eps)
    return gather(edges, points, [value]).groupBy("cloud_id", "src").agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))


def differences(edges: DataFrame, points: DataFrame, value: str) -> DataFrame:
    """The neighbour's value less the source's, and the source's."""
    own = points.select("cloud_id", F.col("point_id").alias("src"), F.col(value).alias("own"))
    return gather(edges, points, [value]).join(own, ["cloud_id", "src"]).withColumn("difference", F.col(value) - F.col("own"))


def weighted_sum(edges: DataFrame, points: DataFrame, value: str, weight: Column, position: Column | float = 0.0) -> DataFrame:
    """Sum over neighbours of (value + position) * weight."""
    return gather(edges, points, [value]).groupBy("cloud_id", "src").agg(F.sum((F.col(value) + position) * weight).alias(value))


def attention(edges: DataFrame, points: DataFrame, query: str, key: str, value: str) -> DataFrame:
    """Over each source's edges, softmax of the product of its query with the neighbours' keys, and the mean of
    their values under it."""
    own = points.select("cloud_id", F.col("point_id").alias("src"), F.col(query).alias("_q"))
    e = edges.join(points.select("cloud_id", F.col("point_id").alias("dst"), F.col(key).alias("_k"), F.col(value).alias("_v")), ["cloud_id", "dst"]).join(own, ["cloud_id", "src"])
    w = Window.partitionBy("cloud_id", "src")
    score = F.col("_q") * F.col("_k")
    e = e.withColumn("_s", score).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    return e.groupBy("cloud_id", "src").agg((F.sum(F.col("_e") * F.col("_v")) / F.sum("_e")).alias("fused"))


def statistical_outliers(points: DataFrame, edges: DataFrame, ratio: float) -> DataFrame:
    """Keep points whose mean distance to their neighbours (self included) is above 0 and below the cloud's mean by
    ratio sample deviations; edges are those of a kNN of the cloud in itself."""
    mean = edges.groupBy("cloud_id", F.col("src").alias("point_id")).agg(F.avg(F.sqrt("d2")).alias("_d"))
    return points.join(_inliers(mean, ratio), ["cloud_id", "point_id"], "left_semi")


def outliers_by_lists(points: DataFrame, k: int, ratio: float) -> DataFrame:
    """R19 straight from neighbour lists, a row for each point instead of one for each edge: for clouds of any size."""
    total = F.aggregate("d2", F.lit(0.0), lambda s, v: s + F.sqrt(v))
    mean = materialise(neighbour_lists(points, points, k).select("cloud_id", F.col("src").alias("point_id"), (total / F.size("d2")).alias("_d")))
    return points.join(_inliers(mean, ratio), ["cloud_id", "point_id"], "left_semi")


def _inliers(mean: DataFrame, ratio: float) -> DataFrame:
    limit = mean.groupBy("cloud_id").agg((F.avg("_d") + ratio * F.coalesce(F.stddev_samp("_d"), F.lit(0.0))).alias("_limit"))
    return mean.join(limit, "cloud_id").where((F.col("_d") > 0) & (F.col("_d") < F.col("_limit"))).select("cloud_id", "point_id")


def distance_partitions(edges: DataFrame, near: float, far: float, height: Column) -> DataFrame:
    """Edges by distance and side: 1, 2 between the radii (above, below), 3, 4 beyond them, 0 within."""
    d = F.sqrt("d2")
    up = height > 0
    return edges.withColumn("part", F.when(d <= near, 0).when((d <= far) & up, 1).when(d <= far, 2).when(up, 3).otherwise(4))


def drawn_anchors(points: DataFrame, n: int, seed: int, label: str = "label") -> DataFrame:
    """Up to n drawn points of each class of a cloud."""
    from cloudloom.functions.random import draw

    w = Window.partitionBy("cloud_id", label).orderBy(draw(seed, "cloud_id", "point_id"), "point_id")
    return points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def mine_pairs(points: DataFrame, anchors: DataFrame, k: int, label: str = "label") -> DataFrame:
    """For each anchor its k farthest points of the same class and its k nearest of others; anchors need both."""
    return _of_both_kinds(_best_pairs(_pairs(points.join(_anchors(anchors, label), "cloud_id"), label), k))


def mine_pairs_by_boxes(points: DataFrame, anchors: DataFrame, k: int, label: str = "label", leaf: int = LEAF) -> DataFrame:
    """J31, as ``mine_pairs`` gives it, for large clouds: an anchor reads only the boxes that may hold one of its pairs.

    Points are parted into leaves, and a leaf's points of a class share a box. Points and anchors without place or class take no part.
    """
    whole = " and ".join(f"{c} is not null" for c in (*AXES, label))
    placed, _ = partition(materialise(points.where(whole).select("cloud_id", "point_id", label, *AXES)), None, leaf)
    best, more = promising_boxes(placed, _anchors(anchors.where(whole), label), k, label)
    rest = _pairs(placed.join(more.drop("n"), ["cloud_id", "leaf", label]), label)
    return _of_both_kinds(_best_pairs(best.drop("rank").unionByName(rest), k))


def promising_boxes(placed: DataFrame, anchors: DataFrame, k: int, label: str) -> tuple[DataFrame, DataFrame]:
    """The best pairs among each anchor's foremost boxes, and the other boxes (cloud_id, leaf, class, with n points) that may hold better
    ones, with the anchor.

    Foremost are the boxes that surely hold k points of a kind at the best distance (the most for farthest, the least for nearest).
    The kth distance really found there is the limit that another box must be able to reach.
    """
    boxes = placed.groupBy("cloud_id", "leaf", label).agg(F.count("*").alias("n"), *[f(a).alias(f"{m}_{a}") for a in AXES for m, f in (("low", F.min), ("high", F.max))])
    side = lambda a: F.greatest(F.col(f"low_{a}") - F.col(f"_{a}"), F.col(f"_{a}") - F.col(f"high_{a}"), F.lit(0.0))
    reach = lambda a: F.greatest(F.abs(F.col(f"low_{a}") - F.col(f"_{a}")), F.abs(F.col(f"high_{a}") - F.col(f"_{a}")))
    near, far = (sum((f(a) * f(a) for a in AXES), F.lit(0.0)) for f in (side, reach))
    small = anchors.limit(FEW + 1).count() <= FEW
    met = boxes.join(F.broadcast(anchors) if small else anchors, "cloud_id").withColumn("positive", F.col(label) == F.col("_l"))
    # the smaller the better for both kinds
    met = met.withColumns({"_sure": F.when(F.col("positive"), -near).otherwise(far), "_hoped": F.when(F.col("positive"), -far).otherwise(near)})
    before = Window.partitionBy("cloud_id", "anchor", "positive").orderBy("_sure", "leaf", label).rowsBetween(Window.unboundedPreceding, -1)
    need = k + F.col("positive").cast("int")  # the anchor itself is in a box of its class
    met = met.withColumn("_foremost", F.coalesce(F.sum("n").over(before), F.lit(0)) < need)
    met = materialise(met.select("cloud_id", "leaf", label, "n", "anchor", "_l", *[f"_{a}" for a in AXES], "positive", "_hoped", "_foremost"))
    best = materialise(_best_pairs(_pairs(placed.join(met.where("_foremost").drop("n", "positive"), ["cloud_id", "leaf", label]), label), k))
    limit = F.when(F.col("positive"), -F.col("d2")).otherwise(F.col("d2"))
    limits = best.where(F.col("rank") == k).select("cloud_id", "anchor", "positive", (limit + F.abs(limit) * 1e-9).alias("_limit"))  # for rounding
    more = met.where("not _foremost").join(limits, ["cloud_id", "anchor", "positive"]).where(F.col("_hoped") <= F.col("_limit"))
    return best, more.select("cloud_id", "leaf", label, "n", "anchor", "_l", *[f"_{a}" for a in AXES])


def _anchors(anchors: DataFrame, label: str) -> DataFrame:
    return anchors.select("cloud_id", F.col("point_id").alias("anchor"), F.col(label).alias("_l"), *[F.col(c).alias(f"_{c}") for c in AXES])


def _pairs(met: DataFrame, label: str) -> DataFrame:
    d2 = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in AXES), F.lit(0.0))
    return met.where("point_id <> anchor").select("cloud_id", "anchor", "point_id", (F.col(label) == F.col("_l")).alias("positive"), d2.alias("d2"))


def _best_pairs(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("cloud_id", "anchor", "positive").orderBy(F.when(F.col("positive"), -F.col("d2")).otherwise(F.col("d2")), "point_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _of_both_kinds(top: DataFrame) -> DataFrame:
    both = top.groupBy("cloud_id", "anchor").agg(F.countDistinct("positive").alias("_k")).where("_k = 2").drop("_k")
    return top.join(both, ["cloud_id", "anchor"], "left_semi")


def overlap_ratios(frames: DataFrame, size: float, reach: float = 1.5) -> DataFrame:
    """For every pair of frames a < b of a scene the larger share of voxels with a neighbour in the other
    within reach * size. One bucket join over all frames of the scene. Rows: scene, frame, x, y, z."""
    vox = frames.groupBy("scene", "frame", *[F.floor(F.col(a) / size).alias(f"v{a}") for a in AXES]).agg(*[F.avg(a).alias(a) for a in AXES])
    vox = vox.select(F.col("scene").alias("cloud_id"), "frame", *AXES, F.xxhash64("frame", "vx", "vy", "vz").alias("point_id"))
    sizes = vox.groupBy("cloud_id", "frame").agg(F.count("*").alias("n"))
    e = radius_edges(vox, vox, reach * size)
    ids = vox.select("cloud_id", "point_id", "frame")
    e = e.join(ids.withColumnsRenamed({"point_id": "src", "frame": "fa"}), ["cloud_id", "src"]).join(ids.withColumnsRenamed({"point_id": "dst", "frame": "fb"}), ["cloud_id", "dst"])
    hit = e.where("fa <> fb").groupBy("cloud_id", "fa", "fb").agg(F.countDistinct("src").alias("hits"))
    share = hit.join(sizes.withColumnRenamed("frame", "fa"), ["cloud_id", "fa"]).withColumn("share", F.col("hits") / F.col("n"))
    return share.groupBy(F.col("cloud_id").alias("scene"), F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).agg(F.max("share").alias("overlap"))


def feature_knn(df: DataFrame, k: int, group: str = "cloud_id", ident: str = "point_id", vector: str = "feat", block: int = 4096) -> DataFrame:
    """The k nearest in feature space of the same group, ties to the smaller id; distances are rounded to 9 digits.

    A group is dealt into blocks of about ``block`` rows by a hash; every pair of blocks is a task's work, and a query's best of
    its blocks are merged. The work is the square of a group, as the search is exact; a task's memory is bounded by the block.
    """
    sizes = df.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    rows = df.select(group, ident, vector).join(sizes, group).withColumn("_own", F.pmod(F.xxhash64(ident), F.col("_blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    asked = rows.withColumn("_other", every).select(group, ident, vector, F.col("_own").alias("_q"), F.col("_other").alias("_p"), F.lit(True).alias("_asks"))
    held = rows.withColumn("_other", every).select(group, ident, vector, F.col("_other").alias("_q"), F.col("_own").alias("_p"), F.lit(False).alias("_asks"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, p = pdf[pdf["_asks"]], pdf[~pdf["_asks"]].sort_values(ident)
        if not len(q) or not len(p):
            return pd.DataFrame({group: [], "src": [], "dst": [], "d2": []})
        x, y, ids = np.stack(q[vector].to_numpy()).astype(float), np.stack(p[vector].to_numpy()).astype(float), p[ident].to_numpy()
        n, parts = min(k, len(ids)), []
        for at in range(0, len(x), 256):
            d2 = np.zeros((len(x[at : at + 256]), len(y)))
            for c in range(x.shape[1]):
                d2 += (x[at : at + 256, c, None] - y[None, :, c]) ** 2
            parts.append(nearest_rows(np.round(d2, 9), n))
        order, d2 = np.vstack([o for o, _ in parts]), np.vstack([d for _, d in parts])
        return pd.DataFrame({group: pdf[group].iloc[0], "src": np.repeat(q[ident].to_numpy(), n), "dst": ids[order.ravel()], "d2": d2.ravel()})

    found = asked.unionByName(held).groupBy(group, "_q", "_p").applyInPandas(run, f"{group} bigint, src bigint, dst bigint, d2 double")
    w = Window.partitionBy(group, "src").orderBy("d2", "dst")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(group, "src", "dst", "rank")


def edge_features(edges: DataFrame, df: DataFrame, group: str = "cloud_id", ident: str = "point_id", vector: str = "feat") -> DataFrame:
    """On each edge the neighbour's features less the source's, then the source's own."""
    own, other = (df.select(group, F.col(ident).alias(end), F.col(vector).alias(f"_{end}")) for end in ("src", "dst"))
    out = edges.join(own, [group, "src"]).join(other, [group, "dst"])
    return out.withColumn("edge", F.concat(F.zip_with("_dst", "_src", lambda a, b: a - b), F.col("_src"))).drop("_src", "_dst")


def pool_down(points: DataFrame, n: int, k: int, features: Sequence[str]) -> DataFrame:
    """Farthest points, and over the k nearest points of each the greatest features."""
    from cloudloom.operators.cluster import farthest_points

    anchors = points.join(farthest_points(points, n), ["cloud_id", "point_id"])
    best = gather(knn(anchors, points, k), points, features).groupBy("cloud_id", F.col("src").alias("point_id")).agg(*[F.max(f).alias(f) for f in features])
    return anchors.select("cloud_id", "point_id", "rank", *AXES).join(best, ["cloud_id", "point_id"])


def anchor_patches(points: DataFrame, n: int, k: int) -> DataFrame:
    """Patches of the k nearest points of each of n farthest points: cloud_id, patch (the anchor's rank), point_id, rank."""
    from cloudloom.operators.cluster import farthest_points

    chosen = farthest_points(points, n)
    anchors = points.join(chosen.select("cloud_id", "point_id"), ["cloud_id", "point_id"], "left_semi")
    edges = knn(anchors, points, k)
    return edges.join(chosen.select("cloud_id", F.col("point_id").alias("src"), F.col("rank").alias("patch")), ["cloud_id", "src"]).select("cloud_id", "patch", F.col("dst").alias("point_id"), "rank")
