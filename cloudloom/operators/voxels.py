"""Sparse voxel tables (R2, R22, J24, J25, E11): a volume is the rows (cloud_id, i, j, k, value) that hold something."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.random import draw

VOXEL = ["cloud_id", "i", "j", "k"]


def look_up(points: DataFrame, grid: DataFrame, value: str, missing) -> DataFrame:
    """The grid's value at each point's voxel."""
    return points.join(grid.select(*VOXEL, value), VOXEL, "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def dilate(seeds: DataFrame, n: int) -> DataFrame:
    """R2: all voxels within n steps along the axes of a seed. Only seeds with a free neighbour need their whole ball."""
    reach = [(a, b, c) for a in range(-n, n + 1) for b in range(-n, n + 1) for c in range(-n, n + 1) if abs(a) + abs(b) + abs(c) <= n]
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in reach])).alias("o")
    out = surface(seeds).select(*VOXEL, moves).select("cloud_id", (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), (F.col("k") + F.col("o.c")).alias("k"))
    return out.union(seeds.select(*VOXEL)).distinct()


def threshold_or_dilated(voxels: DataFrame, above: Column, kept: Column, seed: Column, n: int) -> DataFrame:
    """R2: voxels above the threshold and of a kept class, and those of the volume within n steps of a seed class."""
    near = dilate(voxels.where(seed).select(*VOXEL).distinct(), n)
    grown = voxels.select(*VOXEL).distinct().join(near, VOXEL, "left_semi")
    return voxels.where(above & kept).select(*VOXEL).union(grown).distinct()


def mask_patches(points: DataFrame, cell: Sequence[str], ratio: float, seed: int) -> DataFrame:
    """The share of a cloud's occupied patches, by draw, as a mask on its points."""
    cells = points.select("cloud_id", *cell).distinct()
    cloud = Window.partitionBy("cloud_id")
    cells = cells.withColumns({"_r": F.row_number().over(cloud.orderBy(draw(seed, "cloud_id", *cell[:2]), *cell)), "_n": F.count("*").over(cloud)})
    return points.join(cells.withColumn("masked", F.col("_r") <= F.floor(F.col("_n") * ratio)).drop("_r", "_n"), ["cloud_id", *cell])


def rasterise(points: DataFrame, pred: str) -> DataFrame:
    """Voxels of predicted points: 1 foreground, 0 background; of several points in a voxel the last one counts."""
    return points.groupBy(*VOXEL).agg((F.max_by(pred, "point_id") > 0).cast("int").alias("fg"))


def visible(points: DataFrame, view: Sequence[str], normal: Sequence[str], least_cosine: float, valid: Column) -> DataFrame:
    """Points seen at a steep enough angle (the cosine of view and normal above ``least_cosine``) with a valid depth and label."""
    dot = sum((F.col(a) * F.col(b) for a, b in zip(view, normal)), F.lit(0.0))
    norm = lambda c: F.sqrt(sum((F.col(x) ** 2 for x in c), F.lit(0.0)))
    return points.where((F.abs(F.try_divide(dot, norm(view) * norm(normal))) > least_cosine) & valid)


def surface(voxels: DataFrame) -> DataFrame:
    """Voxels with a missing neighbour among the six: those whose number of present neighbours is below six."""
    v = voxels.select(*VOXEL).distinct()
    steps = F.explode(F.array(*[F.struct(*[F.lit(s if a == b else 0).alias(b) for b in "ijk"]) for a in "ijk" for s in (-1, 1)])).alias("o")
    around = v.select("cloud_id", "i", "j", "k", steps).select("cloud_id", *[(F.col(a) + F.col(f"o.{a}")).alias(a) for a in "ijk"])
    present = around.groupBy(*VOXEL).agg(F.count("*").alias("_n")).where("_n = 6").select(*VOXEL)
    return v.join(present, VOXEL, "left_anti")


def surface_distances(truth: DataFrame, pred: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """Hausdorff distance, its 95th percentile (of both directions together), the average distance from the predicted surface to
    the true one (asd) and the mean of both directions' averages (assd), of the voxel sets of each cloud; null for a cloud that
    lacks one of them."""
    from cloudloom.operators.neighbors import knn

    def coords(df: DataFrame) -> DataFrame:
        s = surface(df)
        number = F.row_number().over(Window.partitionBy("cloud_id").orderBy("i", "j", "k")).cast("bigint").alias("point_id")
        return s.select("cloud_id", number, *[(F.col(a) * spacing[n]).cast("double").alias(b) for n, (a, b) in enumerate(zip("ijk", "xyz"))])

    a, b = coords(truth), coords(pred)
    back, forth = (knn(x, y, 1).select("cloud_id", F.sqrt("d2").alias("d"), F.lit(k).alias("way")) for k, (x, y) in enumerate(((a, b), (b, a))))
    way = lambda k: F.avg(F.when(F.col("way") == k, F.col("d")))
    found = back.unionByName(forth).groupBy("cloud_id").agg(F.max("d").alias("hd"), F.percentile("d", 0.95).alias("hd95"), way(1).alias("asd"), ((way(0) + way(1)) / 2).alias("assd"))
    return truth.select("cloud_id").union(pred.select("cloud_id")).distinct().join(found, "cloud_id", "left")


def cross_masks(views: DataFrame, cell: Sequence[str], rate: float, seed: int) -> DataFrame:
    """Patches of a grid that two views share, masked in one or the other: disjoint sets, each a share ``rate`` (at
    most a half) of the cloud's patches; the points of view 0 are masked by set 1, those of view 1 by set 2."""
    cells = views.select("cloud_id", *cell).distinct()
    cloud = Window.partitionBy("cloud_id")
    n = F.floor(F.count("*").over(cloud) * rate)
    cells = cells.withColumns({"_r": F.row_number().over(cloud.orderBy(draw(seed, "cloud_id", *cell[:2]), *cell)), "_n": n})
    tag = F.when(F.col("_r") <= F.col("_n"), 1).when(F.col("_r") <= 2 * F.col("_n"), 2).otherwise(0)
    return views.join(cells.withColumn("_tag", tag).drop("_r", "_n"), ["cloud_id", *cell]).withColumn("masked", F.col("_tag") == F.col("view") + 1).drop("_tag")


def window_pairs(points: DataFrame, size: float, sampled: Column) -> DataFrame:
    """All pairs of a window, and pairs of a point with sampled points of the window of twice the size that aren't
    in its small window."""
    key = [F.floor(F.col(a) / size).alias(f"w{a}") for a in "xyz"] + [F.floor(F.col(a) / (2 * size)).alias(f"d{a}") for a in "xyz"]
    p = points.withColumn("_sampled", sampled).select("cloud_id", "point_id", "_sampled", *key)
    small, large = ["cloud_id", "wx", "wy", "wz"], ["cloud_id", "dx", "dy", "dz"]
    q = p.select(*small, F.col("point_id").alias("key"))
    dense = p.join(q, small).select("cloud_id", "point_id", "key")
    s = p.where("_sampled").select(*large, F.col("point_id").alias("key"), *[F.col(f"w{a}").alias(f"_w{a}") for a in "xyz"])
    apart = (F.col("wx") != F.col("_wx")) | (F.col("wy") != F.col("_wy")) | (F.col("wz") != F.col("_wz"))
    return dense.unionByName(p.join(s, large).where(apart).select("cloud_id", "point_id", "key"))
