"""Farthest points of clouds of any size: leaves send their farthest points and a bound for the rest, and a cloud's task picks on while
the bounds prove its picks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.tables import discard, materialise
from cloudloom.operators.spacetree import AXES, FEW, LEAF, partition

PICKS = "cloud_id bigint, point_id bigint, x double, y double, z double, rank int, want int"


def _square(x, y, z):
    return x * x + y * y + z * z


def _picks(rows: pa.Table) -> pa.Table:
    """The next picks of a cloud: rows are its leaves with box, held (the first by distance to the chosen points, ties by id) and bound (the
    distance of the next one, -1 without one)."""
    held = rows["held"].combine_chunks()
    d2, ids, *place = (held.flatten().field(c).to_numpy() for c in ("d2", "point_id", *AXES))
    d2 = d2.copy()
    low, high = ([rows[f"{n}_{a}"].to_numpy() for a in AXES] for n in ("low", "high"))
    bound, have, want = rows["bound"].to_numpy().copy(), rows["have"][0].as_py(), rows["want"][0].as_py()
    out = []
    while len(out) < want - have:
        most = d2.max()
        if out and bound.max() >= most:  # a point that wasn't sent may be as far
            break
        at = np.flatnonzero(d2 == most)
        k = at[np.argmin(ids[at])]
        if most <= 0:  # all lie at chosen places: the smallest id again and again
            out += [k] * (want - have - len(out))
            break
        out.append(k)
        np.minimum(d2, _square(*(p - p[k] for p in place)), out=d2)
        np.minimum(bound, _square(*(np.maximum(abs(lo - p[k]), abs(hi - p[k])) for p, lo, hi in zip(place, low, high))), out=bound)
    n = len(out)
    columns = [pa.array([rows["cloud_id"][0].as_py()] * n, pa.int64()), pa.array(ids[out], pa.int64()), *(pa.array(p[out]) for p in place)]
    return pa.table([*columns, pa.array(range(have + 1, have + n + 1), pa.int32()), pa.array([want] * n, pa.int32())], ["cloud_id", "point_id", *AXES, "rank", "want"])


def farthest_points(points: DataFrame, n: int, leaf: int = LEAF, top: int = 16) -> DataFrame:
    """R17 as (cloud_id, point_id, rank): what ``cluster.farthest_points`` gives, for clouds of any size.

    A round brings each point's distance to the chosen ones up to date in Spark, and sends ``top`` points of each leaf, with the leaf's
    box and the next distance, to one task a cloud: about a fiftieth of its points. There picks go on for as long as the farthest point
    sent is farther than any that wasn't can be, by the bounds, which every pick lowers. The first pick of a round is always proven, so a
    round makes progress; many equal distances make many rounds. Rows without a place take no part.
    """
    slim = points.where(" and ".join(f"{a} is not null" for a in AXES)).select(F.col("cloud_id").cast("bigint").alias("cloud_id"), F.col("point_id").cast("bigint").alias("point_id"), *[F.col(a).cast("double").alias(a) for a in AXES])
    placed, _ = partition(materialise(slim), None, leaf)
    boxes = materialise(placed.groupBy("cloud_id", "leaf").agg(*[f(a).alias(f"{m}_{a}") for a in AXES for m, f in (("low", F.min), ("high", F.max))]))
    first = placed.groupBy("cloud_id").agg(F.min(F.struct("point_id", *AXES)).alias("p"), F.least(F.count("*"), F.lit(n)).cast("int").alias("want"))
    new = materialise(first.where("want > 0").select("cloud_id", "p.*", F.lit(1).alias("rank"), "want"))
    found, state = [new], placed.withColumn("d2", F.lit(float("inf")))
    while True:
        step = new.groupBy("cloud_id").agg(F.max("rank").alias("have"), F.first("want").alias("want"), F.collect_list(F.struct(*AXES)).alias("at")).where("have < want")
        open_clouds = step.limit(FEW // max(n, 1) + 2).count()
        if not open_clouds:
            break
        step = F.broadcast(step) if open_clouds * n <= FEW else step  # a cloud's row holds at most n places
        near = F.array_min(F.transform("at", lambda p: _square(*(F.col(a) - p[a] for a in AXES))))
        old, state = state, materialise(state.join(step, "cloud_id").withColumn("d2", F.least("d2", near)).drop("at"))
        if hasattr(old, "_written"):
            discard(old)
        place = F.row_number().over(Window.partitionBy("cloud_id", "leaf").orderBy(F.desc("d2"), "point_id"))
        sent = state.withColumn("_place", place).where(F.col("_place") <= top + 1)
        leaves = sent.groupBy("cloud_id", "leaf", "have", "want").agg(
            F.collect_list(F.when(F.col("_place") <= top, F.struct("d2", "point_id", *AXES))).alias("held"),
            F.coalesce(F.max(F.when(F.col("_place") > top, F.col("d2"))), F.lit(-1.0)).alias("bound"),
        )
        new = materialise(leaves.join(boxes, ["cloud_id", "leaf"]).groupBy("cloud_id").applyInArrow(_picks, PICKS))
        state = _without(state, "have", "want")
        found.append(new)
        if len(found) > 16:  # keeps the plan short
            found = [materialise(_united(found))]
    return _united(found).select("cloud_id", "point_id", "rank")


def _without(written: DataFrame, *columns: str) -> DataFrame:
    out = written.drop(*columns)
    out._written = written._written
    return out


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
