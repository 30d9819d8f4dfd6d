"""Per-cloud aggregates put back on points (A*), filters, crops and sampling (R*).

All of them partition by cloud_id, so after one exchange on that key Spark runs any chain of them without another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.random import draw
from cloudloom.functions.ranking import rank_within


def per_cloud():
    """The window over a whole cloud."""
    return Window.partitionBy("cloud_id")


def ranked(*order) -> Column:
    return F.row_number().over(per_cloud().orderBy(*order))


def numbered(df: DataFrame, name: str, order: Sequence[Column | str], large: bool = False) -> DataFrame:
    """df with each row's number in its cloud, from 1; ``large``: by ranges of the order, for clouds that no task should sort whole."""
    return rank_within(df, "cloud_id", list(order), name) if large else df.withColumn(name, ranked(*order))


def sized(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """df with the size of each row's cloud; ``large``: counted before the shuffle and joined."""
    if not large:
        return df.withColumn(name, F.count("*").over(per_cloud()))
    return df.join(df.groupBy("cloud_id").agg(F.count("*").alias(name)), "cloud_id")


def centre_shift(df: DataFrame, apply_z: bool = True) -> DataFrame:
    """A1: x and y from the box's centre; z from its bottom, if asked for."""
    moved = {a: F.col(a) - (F.min(a).over(per_cloud()) + F.max(a).over(per_cloud())) / 2 for a in "xy"}
    if apply_z:
        moved["z"] = F.col("z") - F.min("z").over(per_cloud())
    return df.withColumns(moved)


def positive_shift(df: DataFrame) -> DataFrame:
    """A2: the box's corner to the origin."""
    return df.withColumns({a: F.col(a) - F.min(a).over(per_cloud()) for a in "xyz"})


def unit_sphere(df: DataFrame) -> DataFrame:
    """A3: from the centroid, over the largest distance; a cloud of one place becomes zeros."""
    near = df.withColumns({a: F.col(a) - F.avg(a).over(per_cloud()) for a in "xyz"})
    radius = F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).over(per_cloud())
    return near.withColumn("_radius", radius).withColumns({a: F.coalesce(F.try_divide(F.col(a), "_radius"), F.lit(0.0)) for a in "xyz"}).drop("_radius")


def intensity_stats(df: DataFrame, value: str = "intensity", low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Per cloud the two percentiles, and mean and population deviation of the values clipped to them."""
    cut = df.groupBy("cloud_id").agg(F.percentile(value, low).alias("p_low"), F.percentile(value, high).alias("p_high"))
    clipped = df.join(cut, "cloud_id").withColumn("_v", F.least(F.greatest(F.col(value), "p_low"), "p_high"))
    return clipped.groupBy("cloud_id").agg(F.first("p_low").alias("p_low"), F.first("p_high").alias("p_high"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))


def normalise_intensity(df: DataFrame, value: str = "intensity", stats: DataFrame | None = None, floor: float = 1e-6) -> DataFrame:
    """Clip to the percentiles and standardise, by the cloud's own or by stored statistics."""
    stats = intensity_stats(df, value) if stats is None else stats
    v = F.least(F.greatest(F.col(value), "p_low"), "p_high")
    return df.join(stats, "cloud_id").withColumn(value, (v - F.col("mean")) / F.greatest(F.col("std"), F.lit(floor))).drop("p_low", "p_high", "mean", "std")


def auto_contrast(df: DataFrame, channels: Sequence[str], blend: float) -> DataFrame:
    """A5: stretch each channel to 0..255 over its cloud, blended with the old value; a flat channel stays."""
    out = {}
    for c in channels:
        low, high = F.min(c).over(per_cloud()), F.max(c).over(per_cloud())
        stretched = F.coalesce(F.try_divide((F.col(c) - low) * 255, high - low), F.col(c))
        out[c] = (1 - blend) * F.col(c) + blend * stretched
    return df.withColumns(out)


def intensity_variation(df: DataFrame, shift: float, scale: float, gamma: float, value: str = "intensity") -> DataFrame:
    """Shift, scale about the cloud's least value, and gamma on the range 0..1 of the cloud."""
    low, high = F.min(value).over(per_cloud()), F.max(value).over(per_cloud())
    moved = (F.col(value) - low) * scale + low + shift
    span = (high - low) * scale
    share = F.greatest(F.coalesce(F.try_divide(moved - low - shift, span), F.lit(0.0)), F.lit(0.0))  # rounding may go below
    return df.withColumn(value, F.pow(share, F.lit(gamma)) * span + low + shift)


def parse_instances(df: DataFrame, ignored: Sequence[int]) -> DataFrame:
    """Points of ignored classes lose their instance (-1); the others are numbered densely from 0 in each cloud.

    Adds the centroid of the point's instance (null without one).
    """
    kept = F.when(F.col("label").isin(*ignored) | (F.col("instance") < 0), None).otherwise(F.col("instance"))
    out = df.withColumn("_kept", kept)
    dense = F.dense_rank().over(per_cloud().orderBy(F.col("_kept").asc_nulls_last())) - 1
    own = Window.partitionBy("cloud_id", "_kept")
    out = out.withColumn("instance", F.when(F.col("_kept").isNull(), -1).otherwise(dense))
    return out.withColumns({f"c{a}": F.when(F.col("_kept").isNotNull(), F.avg(a).over(own)) for a in "xyz"}).drop("_kept")


def instance_boxes(parsed: DataFrame) -> DataFrame:
    """Box centre, size and class (of the first point) of each instance."""
    boxes = parsed.where("instance >= 0").groupBy("cloud_id", "instance")
    size = [f for a in "xyz" for f in (((F.min(a) + F.max(a)) / 2).alias(f"b{a}"), (F.max(a) - F.min(a)).alias(f"s{a}"))]
    return boxes.agg(*size, F.min_by("label", "point_id").alias("class"), F.count("*").alias("n"))


def class_histogram(df: DataFrame, label: str = "label") -> DataFrame:
    """Points, share and number of clouds of each class."""
    per = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("points"), F.countDistinct("cloud_id").alias("clouds"))
    return per.withColumn("share", F.col("points") / F.sum("points").over(Window.partitionBy(F.lit(1))))


def drop_classes(df: DataFrame, classes: Sequence[int], label: str = "label") -> DataFrame:
    """R1."""
    return df.where(~F.col(label).isin(*classes))


def patch(df: DataFrame, size: Sequence[float], seed: int) -> DataFrame:
    """Points in a box of the given size about a drawn point of the cloud, moved back inside the cloud's box.

    x and y are half-open, z is closed; an axis on which the cloud is no longer than the patch isn't cut.
    """
    w = per_cloud().orderBy(draw(seed, "cloud_id", "point_id"), "point_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out, tests = df, []
    for k, a in enumerate("xyz"):
        low, high = F.min(a).over(per_cloud()), F.max(a).over(per_cloud())
        start = F.greatest(low, F.least(F.first(a).over(w) - size[k] / 2, high - size[k]))
        out = out.withColumns({f"_{a}": start, f"_all{a}": (high - low) <= size[k]})
        inside = (F.col(a) >= F.col(f"_{a}")) & ((F.col(a) < F.col(f"_{a}") + size[k]) if a != "z" else (F.col(a) <= F.col(f"_{a}") + size[k]))
        tests.append(F.col(f"_all{a}") | inside)
    return out.where(tests[0] & tests[1] & tests[2]).select(df.columns)


def sphere_crop(df: DataFrame, point_max: int) -> DataFrame:
    """The point_max points nearest to the cloud's middle point by id; ties to the smaller id."""
    n = df.groupBy("cloud_id").agg((F.floor(F.count("*") / 2) + 1).alias("_at"))
    order = df.join(n, "cloud_id").withColumn("_rank", ranked("point_id"))
    centre = order.where("_rank = _at").select("cloud_id", *[F.col(a).alias(f"_{a}") for a in "xyz"])
    d2 = sum(((F.col(a) - F.col(f"_{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    near = df.join(centre, "cloud_id").withColumn("_d2", d2).withColumn("_near", ranked("_d2", "point_id"))
    return near.where(F.col("_near") <= point_max).select(df.columns)


def rib_pairs_to_drop(depth: int, begin: str, n_pairs: int = 12) -> list[int]:
    """Ids of the first or last ``depth`` pairs (k and k + 12)."""
    pairs = range(1, depth + 1) if begin == "first" else range(n_pairs - depth + 1, n_pairs + 1)
    return [k for p in pairs for k in (p, p + n_pairs)]


def drop_ribs(df: DataFrame, depth: int, begin: str = "first", min_points: int = 0, label: str = "rib") -> DataFrame:
    """Drop whole pairs of ribs from one end, unless fewer than min_points would stay."""
    gone = F.col(label).isin(*rib_pairs_to_drop(depth, begin))
    left = F.count_if(~gone).over(per_cloud())
    return df.withColumn("_left", left).where(~gone | (F.col("_left") < min_points)).drop("_left")


def _beyond(df: DataFrame, begin: Column, position: Column, anchored: Column, axis: str, fallback: Column, min_points: int) -> DataFrame:
    """Keep what lies strictly beyond the cut of the anchored points, by the mean ('m') or the border ('b') of their places; begin
    's' loses the upper part, 'i' the lower one. Without anchored points ``fallback`` decides; a cloud that would keep fewer than
    min_points stays whole."""
    place = F.when(anchored, F.col(axis))
    upper = begin == "s"
    cut = F.when(position == "m", F.avg(place).over(per_cloud())).when(upper, F.min(place).over(per_cloud())).otherwise(F.max(place).over(per_cloud()))
    out = df.withColumn("_cut", cut)
    inside = F.when(F.col("_cut").isNull(), fallback).when(upper, F.col(axis) < F.col("_cut")).otherwise(F.col(axis) > F.col("_cut"))
    out = out.withColumn("_in", inside).withColumn("_n", F.count_if("_in").over(per_cloud()))
    return out.where(F.col("_in") | (F.col("_n") < min_points))


def pair_number(label: Column) -> Column:
    """1 to 12: the place of a rib from the top on its side."""
    return F.when(label > 12, label - 12).otherwise(label)


def truncate_at_rib(df: DataFrame, depth: int, begin: str = "i", position: str = "m", axis: str = "z", min_points: int = 0, label: str = "rib") -> DataFrame:
    """Cut off ``depth`` pairs of ribs from the top (begin 's') or the bottom ('i') of an axis that grows upwards.

    The anchor is the last pair to go: the cut runs through its middle ('m') or along its far border ('b'), and only points
    strictly beyond it stay. A cloud without the anchor keeps the ribs of the pairs beyond it, and the background.
    """
    anchor = depth if begin == "s" else 13 - depth
    number = pair_number(F.col(label))
    stays = (F.col(label) == 0) | (number > anchor if begin == "s" else number < anchor)
    return _beyond(df, F.lit(begin), F.lit(position), number == anchor, axis, stays, min_points).select(df.columns)


def random_truncate(df: DataFrame, max_depth: int, seed: int, begin: str = "", position: str = "", p: float = 0.5, axis: str = "z", min_points: int = 0, label: str = "rib") -> DataFrame:
    """With probability p a cloud of two pairs or more is cut at one rib, drawn among those present of the outer pairs; their
    number is drawn from 1 up to max_depth and one less than the cloud's pairs. End and position are drawn where not given."""
    d = lambda k: draw(seed + k, "cloud_id")
    pick = lambda given, k, a, b: F.lit(given) if given else F.when(d(k) < 0.5, a).otherwise(b)
    out = df.withColumn("_set", F.array_sort(F.collect_set(label).over(per_cloud())))  # at most as many as there are classes
    pairs = F.floor(F.size("_set") / 2)
    most = F.least(pairs - 1, F.lit(min(max_depth, 11)))
    out = out.withColumns({"_depth": F.floor(d(1) * most) + 1, "_begin": pick(begin, 2, "s", "i"), "_ok": (d(0) < p) & (pairs >= 2)})
    outer = lambda x: (x > 0) & F.when(F.col("_begin") == "s", pair_number(x) <= F.col("_depth")).otherwise(pair_number(x) > 12 - F.col("_depth"))
    out = out.withColumn("_outer", F.filter("_set", outer))
    out = out.withColumn("_anchor", F.when(F.col("_ok") & (F.size("_outer") > 0), F.get("_outer", F.floor(d(3) * F.size("_outer")).cast("int"))))
    return _beyond(out, F.col("_begin"), pick(position, 4, "m", "b"), F.col(label) == F.col("_anchor"), axis, F.lit(True), min_points).select(df.columns)


def dropout(df: DataFrame, ratio: float, seed: int, protected: Column | None = None) -> DataFrame:
    """Keep floor(n (1 - ratio)) points of each cloud by draw, and the protected ones."""
    out = df.withColumn("_rank", ranked(draw(seed, "cloud_id", "point_id"), "point_id")).withColumn("_n", F.count("*").over(per_cloud()))
    keep = F.col("_rank") <= F.floor(F.col("_n") * (1 - ratio))
    return out.where(keep if protected is None else keep | protected).select(df.columns)


def limit_points(df: DataFrame, most: int, seed: int, large: bool = False) -> DataFrame:
    """At most so many points of each cloud, by draw. See ``numbered`` for ``large``."""
    return numbered(df, "_rank", [draw(seed, "cloud_id", "point_id"), "point_id"], large).where(F.col("_rank") <= most).drop("_rank")


def sample_points(df: DataFrame, n: int, seed: int, large: bool = False) -> DataFrame:
    """Exactly n rows of each cloud: by draw without replacement, after that with replacement. ``slot`` numbers them. See
    ``numbered`` for ``large``."""
    order = sized(numbered(df, "_rank", [draw(seed, "cloud_id", "point_id"), "point_id"], large), "_n", large).withColumn("_rank", F.col("_rank").cast("int"))
    first = order.where(F.col("_rank") <= n).withColumn("slot", F.col("_rank"))
    sizes = order.groupBy("cloud_id").agg(F.count("*").alias("_n")).where(F.col("_n") < n)
    more = sizes.select("cloud_id", "_n", F.explode(F.sequence(F.col("_n") + 1, F.lit(n))).alias("slot"))
    more = more.select("cloud_id", F.col("slot").cast("int").alias("slot"), (F.floor(draw(seed + 1, "cloud_id", "slot") * F.col("_n")) + 1).cast("int").alias("_rank"))
    return first.drop("_rank", "_n").unionByName(more.join(order.drop("_n"), ["cloud_id", "_rank"]).drop("_rank").select(*df.columns, "slot"))


def shuffle_points(df: DataFrame, seed: int) -> DataFrame:
    """A drawn order of the cloud's points, as the column ord."""
    return df.withColumn("ord", ranked(draw(seed, "cloud_id", "point_id"), "point_id"))


def with_probability(df: DataFrame, p: float, seed: int, change) -> DataFrame:
    """Apply a change to the clouds whose draw is below p; the others pass."""
    d = draw(seed, "cloud_id")
    changed = change(df.where(d < p))
    return changed.unionByName(df.where(d >= p))


def mix_pairs(df: DataFrame) -> DataFrame:
    """Clouds 2k and 2k + 1 become one; instances of the second start after the first's last."""
    pair = F.floor(F.col("cloud_id") / 2)
    top = df.where("cloud_id % 2 = 0").groupBy(pair.alias("mix_id")).agg(F.max("instance").alias("_top"))
    out = df.withColumn("mix_id", pair).join(top, "mix_id", "left")
    moved = F.when((F.col("cloud_id") % 2 == 1) & (F.col("instance") >= 0), F.col("instance") + F.coalesce("_top", F.lit(-1)) + 1).otherwise(F.col("instance"))
    return out.withColumn("instance", moved).drop("_top")
