"""Voxel grids (R13-R16, G*): cells are plain integer columns, so they group and join like any key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.random import draw
from cloudloom.operators.cloud import numbered, per_cloud, sized
from cloudloom.operators.scalar import morton

CELL = ["cloud_id", "cx", "cy", "cz"]


def cells(df: DataFrame, size: float, relative: bool = True) -> DataFrame:
    """Cell indices floor(coordinate / size), counted from the cloud's lowest cell."""
    raw = {f"c{a}": F.floor(F.col(a) / size) for a in "xyz"}
    out = df.withColumns(raw)
    return out.withColumns({c: F.col(c) - F.min(c).over(per_cloud()) for c in raw}) if relative else out


def representatives(celled: DataFrame, seed: int | None = None, protected: Column | None = None) -> DataFrame:
    """One point of each cell, the first by id or (with a seed) a drawn one; protected points stay too."""
    order = ["point_id"] if seed is None else [draw(seed, "cloud_id", "point_id"), F.col("point_id")]
    ranked = celled.withColumn("_rank", F.row_number().over(Window.partitionBy(*CELL).orderBy(*order)))
    keep = F.col("_rank") == 1
    return ranked.where(keep if protected is None else keep | protected).drop("_rank")


def of_first_in_cell(column: str) -> Column:
    """The value of each cell's first point by id, on all points of the cell, without a join."""
    return F.first(column).over(Window.partitionBy(*CELL).orderBy("point_id"))


def displacement(celled: DataFrame, size: float) -> DataFrame:
    """How far a point lies from its cell's middle, in cells."""
    low = {a: F.min(F.floor(F.col(a) / size)).over(per_cloud()) for a in "xyz"}
    return celled.withColumns({f"d{a}": F.col(a) / size - (F.col(f"c{a}") + low[a]) - 0.5 for a in "xyz"})


def to_points(celled: DataFrame, per_cell: DataFrame) -> DataFrame:
    """What is known of a cell, back on all its points."""
    return celled.join(per_cell, CELL)


def fragments(celled: DataFrame) -> DataFrame:
    """As many fragments as the fullest cell has points; each holds one point of every cell, taken in turn."""
    w = Window.partitionBy(*CELL)
    ranked = celled.withColumns({"_r": F.row_number().over(w.orderBy("point_id")) - 1, "_n": F.count("*").over(w)})
    ranked = ranked.withColumn("_m", F.max("_n").over(per_cloud()))
    return ranked.withColumn("fragment", F.explode(F.sequence(F.col("_r").cast("int"), (F.col("_m") - 1).cast("int"), F.col("_n").cast("int")))).drop("_r", "_n", "_m")


def tiles(df: DataFrame, length: float, stride: float, least: int, compat: bool = False) -> DataFrame:
    """Overlapping tiles in x and y that start every ``stride`` and are ``length`` long; those of fewer than
    ``least`` points go, the others are numbered densely. compat: the y grid ends where the x extent does."""
    out = df.withColumns({f"_{a}": F.col(a) - F.min(a).over(per_cloud()) for a in "xy"})
    out = out.withColumns({"_wx": F.max("_x").over(per_cloud()), "_wy": F.max("_x" if compat else "_y").over(per_cloud())})
    for a in "xy":
        first = F.greatest(F.floor((F.col(f"_{a}") - length) / stride) + 1, F.lit(0))
        last = F.least(F.floor(F.col(f"_{a}") / stride), F.floor(F.col(f"_w{a}") / stride))
        out = out.where(first <= last).withColumn(f"t{a}", F.explode(F.sequence(first, last)))
    tile = ["cloud_id", "tx", "ty"]
    kept = out.withColumn("_n", F.count("*").over(Window.partitionBy(*tile))).where(F.col("_n") >= least)
    number = F.dense_rank().over(per_cloud().orderBy("tx", "ty")) - 1
    return kept.withColumn("chunk", number).select(*df.columns, "chunk")


def pool(celled: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """Mean coordinate, greatest features and number of points of each cell."""
    return celled.groupBy(*CELL).agg(*[F.avg(a).alias(a) for a in "xyz"], *[F.max(f).alias(f) for f in features], F.count("*").alias("n"))


def segment_mean(df: DataFrame, segment: str, columns: Sequence[str]) -> DataFrame:
    """Means over the segments of a cloud."""
    return df.groupBy("cloud_id", segment).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("n"))


def segment_instances(df: DataFrame, segment: str, share: float = 0.5) -> DataFrame:
    """Segments of which more than ``share`` belongs to one instance, with that instance and its highest label."""
    size = F.count("*").over(Window.partitionBy("cloud_id", segment))
    marked = df.withColumn("_size", size).where("instance >= 0")
    per = marked.groupBy("cloud_id", segment, "instance").agg((F.count("*") / F.max("_size")).alias("share"))
    cls = df.where("instance >= 0").groupBy("cloud_id", "instance").agg(F.max("label").alias("class"))
    return per.where(F.col("share") > share).join(cls, ["cloud_id", "instance"])


def nearest_to_mean(celled: DataFrame) -> DataFrame:
    """Of each cell the point nearest to the mean, ties to the smaller id."""
    w = Window.partitionBy(*CELL)
    d2 = sum(((F.col(a) - F.avg(a).over(w)) ** 2 for a in "xyz"), F.lit(0.0))
    ranked = celled.withColumn("_d2", F.round(d2, 9)).withColumn("_rank", F.row_number().over(w.orderBy("_d2", "point_id")))
    return ranked.where("_rank = 1").drop("_d2", "_rank")


def occupancy(df: DataFrame, size: float, stride: int, stages: int) -> DataFrame:
    """Occupied cells of each cloud at sizes size * stride^k, in one pass over the points."""
    staged = df.withColumn("stage", F.explode(F.sequence(F.lit(0), F.lit(stages - 1))))
    cell = F.struct(*[F.floor(F.col(a) / (size * F.pow(F.lit(float(stride)), "stage"))).alias(a) for a in "xyz"])
    return staged.groupBy("cloud_id", "stage").agg(F.countDistinct(cell).alias("cells"))


def suggested_cap(occupied: DataFrame, quantile: float = 0.99) -> DataFrame:
    """Per stage the mean, median and high percentile of cells, and the latter rounded up to a thousand."""
    q = F.percentile("cells", quantile)
    return occupied.groupBy("stage").agg(F.avg("cells").alias("mean"), F.median("cells").alias("median"), q.alias("high"), (F.ceil(q / 1000) * 1000).alias("cap"))


def cell_softmax(celled: DataFrame, score: str, value: str) -> DataFrame:
    """Weights exp(score) shared within each cell, and the weighted sum of a value back on its points."""
    w = Window.partitionBy(*CELL)
    out = celled.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    out = out.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")
    return out.withColumn("fused", F.sum(F.col("weight") * F.col(value)).over(w))


def class_prototypes(df: DataFrame, vector: str, label: str) -> DataFrame:
    """The mean vector of each class, as one row for each component."""
    return df.select(label, F.posexplode(vector).alias("axis", "v")).groupBy(label, "axis").agg(F.avg("v").alias("v"))


def octree_levels(df: DataFrame, depth: int, columns: Sequence[str] = ("cx", "cy", "cz")) -> DataFrame:
    """Occupied nodes of every level of an octree: prefixes of the z-order code."""
    coded = df.withColumn("_code", morton(*[F.col(c) for c in columns], bits=depth))
    levels = F.posexplode(F.array(*[F.shiftright("_code", 3 * (depth - k)) for k in range(depth + 1)]))
    return coded.select("cloud_id", levels.alias("level", "node")).distinct().groupBy("cloud_id", "level").agg(F.count("*").alias("nodes"))


def serialise(df: DataFrame, columns: Sequence[str] = ("cx", "cy", "cz"), bits: int = 10, large: bool = False) -> DataFrame:
    """Z-order code and rank of each point along the curve of its cloud, ties by id. See ``cloud.numbered`` for ``large``."""
    coded = df.withColumn("code", morton(*[F.col(c) for c in columns], bits=bits))
    return numbered(coded, "ord", ["code", "point_id"], large).withColumn("ord", F.col("ord") - 1)


def serial_pool(serialised: DataFrame, depth: int) -> DataFrame:
    """Cells of the code without its last 3 * depth bits: mean coordinate, number, head point."""
    return serialised.groupBy("cloud_id", F.shiftright("code", 3 * depth).alias("cell")).agg(*[F.avg(a).alias(a) for a in "xyz"], F.min_by("point_id", "ord").alias("head"), F.count("*").alias("n"))


def patches(serialised: DataFrame, size: int, large: bool = False) -> DataFrame:
    """Patches of ``size`` along the curve. The last one of a cloud borrows from the one before it, so that all are
    full where the cloud has more than a patch; borrowed rows are marked."""
    n = sized(serialised, "_n", large)
    own = n.withColumns({"patch": F.floor(F.col("ord") / size), "borrowed": F.lit(False)})
    last = F.floor((F.col("_n") - 1) / size)
    more = n.where((F.col("_n") > size) & (F.col("_n") % size > 0) & (F.col("ord") >= F.col("_n") - size) & (F.col("ord") < last * size))
    return own.unionByName(more.withColumns({"patch": last, "borrowed": F.lit(True)})).drop("_n")


def windows(df: DataFrame, size: float, shifted: bool = False) -> DataFrame:
    """Window of each point on a grid, moved by half a window if asked for, and its rank there."""
    start = size / 2 if shifted else 0.0
    out = df.withColumns({f"w{a}": F.floor((F.col(a) - F.min(a).over(per_cloud()) + start) / size) for a in "xyz"})
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("cloud_id", "wx", "wy", "wz").orderBy("point_id")) - 1)


def interpolate_cells(points: DataFrame, values: DataFrame, size: float, value: str) -> DataFrame:
    """Trilinear interpolation of cell values at points; weights are shared among the corners that have a value."""
    out = points.withColumns({f"_{a}": F.col(a) / size for a in "xyz"})
    corners = F.explode(F.array(*[F.struct(*[F.lit(b).alias(c) for b, c in zip((i, j, k), "ijk")]) for i in (0, 1) for j in (0, 1) for k in (0, 1)]))
    out = out.withColumn("_c", corners)
    part = lambda a, c: F.when(F.col(f"_c.{c}") == 1, F.col(f"_{a}") - F.floor(f"_{a}")).otherwise(1 - (F.col(f"_{a}") - F.floor(f"_{a}")))
    weight = part("x", "i") * part("y", "j") * part("z", "k")
    keys = {f"c{a}": F.floor(f"_{a}") + F.col(f"_c.{c}") for a, c in zip("xyz", "ijk")}
    hit = out.withColumn("_w", weight).where("_w > 0").withColumns(keys).join(values.select(*CELL, F.col(value).alias("_v")), CELL)
    return hit.groupBy("cloud_id", "point_id").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias(value))


def fused_voxels(points: DataFrame, size: float, means: Sequence[str], tops: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Over all frames of a group, the mean of some features and the greatest of others in each voxel, and its points."""
    voxel = [F.floor(F.col(a) / size).alias(f"v{a}") for a in "xyz"]
    return points.groupBy(*by, *voxel).agg(*[F.avg(c).alias(c) for c in means], *[F.max(c).alias(c) for c in tops], F.count("*").alias("n"))


def downsample_sizes(points: DataFrame, ratio: float, scale: int) -> DataFrame:
    """How many points each cloud keeps: floor(n * ratio) + 1, or n // scale."""
    n = F.count("*")
    return points.groupBy("cloud_id").agg((F.floor(n * ratio) + 1).alias("by_ratio"), F.floor(n / scale).alias("by_scale"))


def axis_orders(points: DataFrame, orders: dict[str, Sequence[str]]) -> DataFrame:
    """K1: for each name the place of a point in its cloud, sorted by the given columns, ties by id; the inverse of a place is its row."""
    return points.withColumns({name: F.row_number().over(per_cloud().orderBy(*columns, "point_id")) - 1 for name, columns in orders.items()})
