"""Nearest neighbours in clouds of any size by an adaptive partition of space.

1. A cloud is split along its widest axis into up to 16 slices at approximate quantiles, and each slice again, until a leaf has at most ``leaf``
   points. A round is one aggregation of counts, bounds and quantiles over all clouds and one join of the cuts with the points, so dense
   and sparse regions get leaves of the same size, and a cloud of n points takes about log16(n / leaf) rounds.
2. Each query is answered from its own leaf first; its kth distance there is an upper bound. Leaves whose box lies within a leaf's greatest
   bound are found by going down the tree, level by level, as joins on the parent; then each query asks those whose box is within its own bound.
3. What other leaves add is merged with the first answer. Most queries lie inside their leaf and end after the first step.

Queries of a leaf are dealt to parts of a bounded number, with a copy of the leaf's points each, so many queries in one place are many tasks' work.
Points at one and the same place can't be split: of those only the k of the smallest ids can be among a query's k nearest, and only they are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.tables import deal, discard, materialise

AXES = ("x", "y", "z")
LEAF, WAYS, PART = 768, 16, 4_096
#: Rows of several leaves that one call of Python takes: a call for each leaf costs more than a small leaf's search.
CALL = 32_768
#: Rows of cuts, of about 200 bytes each, up to which they are broadcast.
FEW = 100_000
LISTS = "cloud_id bigint, src bigint, x double, y double, z double, leaf bigint, dst array<bigint>, d2 array<double>"


def _bounds() -> list[Column]:
    return [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))]


def _cuts(nodes: DataFrame, leaf: int) -> DataFrame:
    """cloud_id, node, axis and cuts of the nodes of over ``leaf`` points that can be split."""
    large = nodes.groupBy("cloud_id", "node").agg(F.count("*").alias("n")).where(F.col("n") > leaf)
    shares = [(i + 1) / WAYS for i in range(WAYS - 1)]
    rows = nodes.join(F.broadcast(large) if large.limit(FEW + 1).count() <= FEW else large, ["cloud_id", "node"])
    found = rows.groupBy("cloud_id", "node").agg(F.first("n").alias("n"), *_bounds(), *[F.percentile_approx(a, shares, 500).alias(f"p_{a}") for a in AXES])
    wide = F.greatest(*[F.col(f"high_{a}") - F.col(f"low_{a}") for a in AXES])
    axis = F.coalesce(*[F.when(F.col(f"high_{a}") - F.col(f"low_{a}") == wide, F.lit(a)) for a in AXES])
    own = {n: F.coalesce(*[F.when(F.col("axis") == a, F.col(f"{n}_{a}")) for a in AXES]) for n in ("low", "high", "p")}
    found = found.where(wide > 0).withColumn("axis", axis)
    above = F.filter(F.array_distinct(own["p"]), lambda c: c > own["low"])  # a cut at the least value parts nothing
    step = F.greatest(F.lit(1), F.floor(WAYS * leaf / F.col("n"))).cast("int")  # fewer slices of a node that is only a little too large
    some = F.filter(above, lambda c, i: (i + 1) % step == 0)
    middle = F.array(own["low"] / 2 + own["high"] / 2)
    return found.select("cloud_id", "node", "axis", F.when(F.size(some) > 0, some).when(F.size(above) > 0, F.slice(above, 1, 1)).otherwise(middle).alias("cuts"))


def _dealt(rows: DataFrame, cuts: DataFrame, few: bool) -> DataFrame:
    """rows with the node that the cuts put them into."""
    value = F.coalesce(*[F.when(F.col("axis") == a, F.col(a)) for a in AXES])
    child = F.col("node") * WAYS + F.size(F.filter("cuts", lambda c: c <= value))
    return rows.join(F.broadcast(cuts) if few else cuts, ["cloud_id", "node"], "left").withColumn("node", F.when(F.col("axis").isNull(), F.col("node")).otherwise(child)).drop("axis", "cuts")


def partition(points: DataFrame, queries: DataFrame | None, leaf: int) -> tuple[DataFrame, DataFrame | None]:
    """points and queries with ``leaf``, written to the shared folder. The root is 1 and a node's children are 16 node to 16 node + 15."""
    sides = [f if f is None else f.withColumn("node", F.lit(1).cast("bigint")) for f in (points, queries)]
    for _ in range(15):
        cuts = materialise(_cuts(sides[0], leaf))
        n = cuts.count()
        if n:
            old, sides = sides, [f if f is None else materialise(_dealt(f, cuts, n <= FEW)) for f in sides]
            for f in old:
                if hasattr(f, "_written"):
                    discard(f)
        discard(cuts)
        if not n:
            return tuple(f if f is None else f.withColumnRenamed("node", "leaf") for f in sides)
    raise RuntimeError("partition: points lie too unevenly for 15 rounds of cuts")


def _nearest(q: list[np.ndarray], p: list[np.ndarray], ids: np.ndarray, k: int, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Ids (sorted) and squared distances of the k nearest points of each query, by (distance, id)."""
    from cloudloom.operators.neighbors import nearest_rows

    n = min(k, len(ids))
    dst, out = np.empty((len(q[0]), n), np.int64), np.empty((len(q[0]), n))
    for at in range(0, len(q[0]), block):
        d2 = np.zeros((min(block, len(q[0]) - at), len(ids)))
        one = np.empty_like(d2)
        for x, y in zip(q, p):
            np.subtract(x[at : at + block, None], y[None, :], out=one)
            one *= one
            d2 += one
        order, out[at : at + block] = nearest_rows(d2, n)
        dst[at : at + block] = ids[order]
    return dst, out


def _within(q: list[np.ndarray], p: list[np.ndarray], ids: np.ndarray, k: int, bound: np.ndarray, block: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many of its k nearest points lie within its bound, for each query; their ids and squared distances."""
    counts, dst, out = np.zeros(len(bound), np.int64), [], []
    for at in range(0, len(bound), block):
        d2 = np.zeros((min(block, len(bound) - at), len(ids)))
        one = np.empty_like(d2)
        for x, y in zip(q, p):
            np.subtract(x[at : at + block, None], y[None, :], out=one)
            one *= one
            d2 += one
        row, col = np.nonzero(d2 <= bound[at : at + block, None])
        value = d2[row, col]
        order = np.lexsort((col, value, row))
        row, col, value = row[order], col[order], value[order]
        few = np.arange(len(row)) - np.searchsorted(row, row) < k
        counts[at : at + block] = np.bincount(row[few], minlength=len(d2))
        dst.append(ids[col[few]])
        out.append(value[few])
    return counts, np.concatenate(dst), np.concatenate(out)


def groups(rows: pa.Table, keys: Sequence[str]) -> dict[tuple, tuple[int, int]]:
    """Where the rows of each combination of keys begin and end; rows are sorted by them."""
    columns = [x for c in keys for x in (rows[c].fill_null(0).to_numpy(), rows[c].is_null().to_numpy())]
    new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.concatenate([[0], np.flatnonzero(new) + 1]) if len(rows) else np.zeros(0, np.int64)
    return dict(zip(zip(*(c[first].tolist() for c in columns)), zip(first.tolist(), [*first[1:].tolist(), len(rows)])))


def _lists(queries: pa.Table, points: pa.Table, k: int, own: Sequence[str], other: Sequence[str]) -> pa.Table:
    """The queries with dst and d2 from the points of the same leaf, whose keys are ``own`` and ``other``; where they have a bound, only
    points within it. Leaves without points answer nothing."""
    queries = queries.sort_by([(c, "ascending") for c in own])
    points = points.sort_by([(c, "ascending") for c in (*other, "point_id")])
    q, p, ids = [queries[a].to_numpy() for a in AXES], [points[f"p{a}"].to_numpy() for a in AXES], points["point_id"].to_numpy()
    bound = queries["bound"].to_numpy() if "bound" in queries.column_names else None
    held, found, asked = groups(points, other), [], []
    for key, (a, b) in groups(queries, own).items():
        if key not in held:
            continue
        c, d = held[key]
        mine, theirs = [x[a:b] for x in q], [x[c:d] for x in p]
        if bound is None:
            dst, d2 = _nearest(mine, theirs, ids[c:d], k)
            found.append((np.full(b - a, dst.shape[1]), dst.ravel(), d2.ravel()))
        else:
            found.append(_within(mine, theirs, ids[c:d], k, bound[a:b]))
        asked.append((a, b))
    columns = [queries[c] for c in ("cloud_id", "src", *AXES, "leaf")]
    if sum(b - a for a, b in asked) < len(queries):
        at = np.concatenate([np.arange(a, b) for a, b in asked] or [np.zeros(0, np.int64)])
        columns = [c.take(pa.array(at)) for c in columns]
    counts, dst, d2 = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.table([*columns, *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (dst, d2))], ["cloud_id", "src", *AXES, "leaf", "dst", "d2"])


def call_number(rows: int, *keys: Column | str) -> Column:
    """A number for some keys that about CALL of the rows share: they go to Python in one call."""
    return F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-rows // CALL)))).cast("int")


def _answers(queries: DataFrame, points: DataFrame, target: str, k: int) -> DataFrame:
    """The k nearest points of the leaf ``target`` for each query; queries of a leaf in parts of about PART. Both sides are written tables."""
    rows = queries.count() + points.count()  # a leaf's copies for its parts are no more than its queries
    sizes = queries.groupBy("cloud_id", F.col(target).alias("_leaf")).agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts"))
    asked = queries.join(sizes.withColumnRenamed("_leaf", target), ["cloud_id", target])
    asked = asked.select(F.col("cloud_id").alias("_cloud"), F.col(target).alias("_leaf"), F.pmod(F.xxhash64("src"), F.col("_parts")).cast("int").alias("_part"), "cloud_id", "src", *AXES, "leaf", *(["bound"] if "bound" in queries.columns else []))
    held = points.join(sizes.withColumnRenamed("_leaf", "leaf"), ["cloud_id", "leaf"])
    held = held.select(F.col("cloud_id").alias("_pcloud"), F.col("leaf").alias("_pleaf"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_ppart"), "point_id", *[F.col(a).alias(f"p{a}") for a in AXES])
    own, other = ("_cloud", "_leaf", "_part"), ("_pcloud", "_pleaf", "_ppart")
    one, two = (df.withColumn(name, call_number(rows, *keys)).groupBy(name) for df, name, keys in ((asked, "_call", own), (held, "_pcall", other)))
    return one.cogroup(two).applyInArrow(lambda q, p: _lists(q, p, k, own, other), LISTS)


def _own_answers(points: DataFrame, k: int) -> DataFrame:
    """The k nearest points of its leaf for each point of it. points is a written table."""
    keys = ("cloud_id", "leaf")

    def run(rows: pa.Table) -> pa.Table:
        queries = rows.rename_columns([{"point_id": "src"}.get(c, c) for c in rows.column_names])
        return _lists(queries, rows.rename_columns([{a: f"p{a}" for a in AXES}.get(c, c) for c in rows.column_names]), k, keys, keys)

    return points.select("cloud_id", "leaf", "point_id", *AXES, call_number(points.count(), *keys).alias("_call")).groupBy("_call").applyInArrow(run, LISTS)


def _gap(one: str, other: str) -> Column:
    """Squared distance of two boxes, or of a point (other is empty) and a box."""
    low, high = (lambda a: F.col(f"{other}low_{a}"), lambda a: F.col(f"{other}high_{a}")) if other else (F.col, F.col)
    side = lambda a: F.greatest(F.col(f"{one}low_{a}") - high(a), low(a) - F.col(f"{one}high_{a}"), F.lit(0.0))
    return sum((side(a) * side(a) for a in AXES), F.lit(0.0))


def _within_reach(first: DataFrame, points: DataFrame, k: int) -> DataFrame | None:
    """cloud_id, leaf, target and its box: the other leaves that may hold something for a query of the leaf."""
    leaves = materialise(points.groupBy("cloud_id", F.col("leaf").alias("node")).agg(*_bounds()))
    up = leaves.withColumn("depth", F.floor(F.log2("node") / 4 + 1e-9).cast("int"))
    up = up.withColumn("up", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    box = [f(f"{n}_{a}").alias(f"{n}_{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))]
    nodes = up.withColumn("node", F.expr("shiftright(node, 4 * up)")).groupBy("cloud_id", "node").agg(*box, F.min("up").alias("above"))
    nodes = materialise(nodes.withColumn("parent", F.shiftright("node", 4)))  # above = 0: a leaf
    asks = first.groupBy("cloud_id", "leaf").agg(F.max(_reach(k)).alias("reach"), *[f(a).alias(f"q_{n}_{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))])
    front = materialise(asks.withColumn("parent", F.lit(0).cast("bigint")))
    found = None
    while not front.isEmpty():
        met = materialise(front.join(nodes, ["cloud_id", "parent"]).where(_gap("", "q_") <= F.col("reach")))
        own = met.where("above = 0 and node <> leaf").select("cloud_id", "leaf", F.col("node").alias("target"), *[f"{n}_{a}" for a in AXES for n in ("low", "high")])
        found = own if found is None else found.unionByName(own)
        front = met.where("above > 0").select("cloud_id", "leaf", "reach", *[f"q_{n}_{a}" for a in AXES for n in ("low", "high")], F.col("node").alias("parent"))
    return found


def _reach(k: int) -> Column:
    """A query's bound: its kth squared distance, or any distance if its leaf has fewer points."""
    return F.when(F.size("d2") >= k, F.element_at("d2", -1)).otherwise(F.lit(float("inf")))


def neighbour_lists(queries: DataFrame, points: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """J1 as lists: cloud_id, src, and dst and d2 of the k nearest points of the query's cloud, by (distance, id); all of a smaller cloud.

    Rows without a place take no part, nor do queries of clouds without points.
    """
    slim = lambda df, ident: df.where(" and ".join(f"{a} is not null" for a in AXES)).select(F.col("cloud_id").cast("bigint").alias("cloud_id"), F.col("point_id").cast("bigint").alias(ident), *[F.col(a).cast("double").alias(a) for a in AXES])
    same, leaf = queries is points, max(leaf, 2 * k)
    placed, asked = partition(materialise(slim(points, "point_id")), None if same else materialise(slim(queries, "src")), leaf)
    asked = placed.withColumnRenamed("point_id", "src") if same else asked
    sizes = materialise(placed.groupBy("cloud_id", "leaf").agg(F.count("*").alias("n")))
    crowded = not sizes.where(F.col("n") > leaf).isEmpty()
    if crowded:  # only points at one place are left together
        many = sizes.where(F.col("n") > leaf).select("cloud_id", "leaf", F.lit(True).alias("_crowded"))
        place = F.row_number().over(Window.partitionBy("cloud_id", "leaf").orderBy("point_id"))
        both = placed.join(F.broadcast(many) if many.count() <= FEW else many, ["cloud_id", "leaf"], "left")
        few = both.where("_crowded").withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
        placed = materialise(both.where("_crowded is null").unionByName(few).drop("_crowded"))
    split = not sizes.where("leaf > 1").isEmpty()
    first = _own_answers(placed, k) if same and not crowded else _answers(asked, placed, "leaf", k)
    if not split:
        return first.select("cloud_id", "src", "dst", "d2")
    first = materialise(first)
    near = _within_reach(first, placed, k)
    if near is None:
        return first.select("cloud_id", "src", "dst", "d2")
    more = first.join(near, ["cloud_id", "leaf"]).where(_gap("", "") <= _reach(k)).select("cloud_id", "src", *AXES, "leaf", "target", _reach(k).alias("bound"))
    more = materialise(more)
    again = more.select("cloud_id", "src").distinct()
    first = deal(first, first.count(), "cloud_id", "src")
    found = first.join(again, ["cloud_id", "src"], "left_semi").unionByName(_answers(more, placed, "target", k))
    merged = deal(found, 2 * more.count(), "cloud_id", "src").groupBy("cloud_id", "src").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d2", "dst")))), 1, k).alias("all"))
    merged = merged.select("cloud_id", "src", F.col("all.dst").alias("dst"), F.col("all.d2").alias("d2"))
    return first.join(again, ["cloud_id", "src"], "left_anti").select("cloud_id", "src", "dst", "d2").unionByName(merged)
