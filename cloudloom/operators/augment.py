"""Seeded augmentations of points: one draw for each cloud, or one for each point where it's noise."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.random import draw, drawn
from cloudloom.operators.cloud import per_cloud
from cloudloom.operators.scalar import rotate


def flip(df: DataFrame, p: float, seed: int) -> DataFrame:
    """X, then y, negated with probability p for each cloud; normals too."""
    out = {}
    for k, a in enumerate("xy"):
        for c in (a, f"n{a}"):
            if c in df.columns:
                out[c] = F.when(draw(seed + k, "cloud_id") < p, -F.col(c)).otherwise(F.col(c))
    return df.withColumns(out)


def rotate_clouds(df: DataFrame, axis: str, angle: Column) -> DataFrame:
    """Turn each cloud about an axis through the centre of its box."""
    centred = {f"_{a}": (F.min(a).over(per_cloud()) + F.max(a).over(per_cloud())) / 2 for a in "xyz"}
    out = df.withColumns(centred)
    return out.withColumns(rotate(axis, angle, {a: F.col(f"_{a}") for a in "xyz"})).drop(*centred)


def scale_clouds(df: DataFrame, low: float, high: float, seed: int, anisotropic: bool = False) -> DataFrame:
    """One factor for each cloud, or for each axis of it."""
    return df.withColumns({a: F.col(a) * (low + draw(seed + k * anisotropic, "cloud_id") * (high - low)) for k, a in enumerate("xyz")})


def shift_clouds(df: DataFrame, ranges: Mapping[str, tuple[float, float]], seed: int) -> DataFrame:
    """An offset for each cloud and axis."""
    return df.withColumns({a: F.col(a) + (lo + draw(seed + k, "cloud_id") * (hi - lo)) for k, (a, (lo, hi)) in enumerate(ranges.items())})


def normal_draw(seed: int, *keys: str) -> Column:
    """A standard normal draw (Box-Muller on two uniform ones)."""
    return F.sqrt(-2 * F.ln(1 - draw(seed, *keys))) * F.cos(2 * F.pi() * draw(seed + 1000, *keys))


def jitter(df: DataFrame, seeds: Mapping[str, int], sigma: float, clip: float) -> DataFrame:
    """Clipped normal noise on the given columns, for each point."""
    noise = lambda s: F.least(F.greatest(sigma * normal_draw(s, "cloud_id", "point_id"), F.lit(-clip)), F.lit(clip))
    return df.withColumns({c: F.col(c) + noise(s) for c, s in seeds.items()})


def clip_jitter(df: DataFrame, seeds: Mapping[str, int], scale: float) -> DataFrame:
    """Normal noise of which 95 % lies within one unit, clipped to it, times a scale."""
    unit = lambda s: F.least(F.greatest(normal_draw(s, "cloud_id", "point_id") / 1.96, F.lit(-1.0)), F.lit(1.0))
    return df.withColumns({c: F.col(c) + scale * unit(s) for c, s in seeds.items()})


def density_noise(df: DataFrame, sigma: float, p: float, seed: int, value: str = "intensity") -> DataFrame:
    """With probability p a cloud's intensities get normal noise, for each point."""
    return df.withColumn(value, F.col(value) + F.when(draw(seed, "cloud_id") < p, sigma * normal_draw(seed + 1, "cloud_id", "point_id")).otherwise(0.0))


def choose_one(df: DataFrame, candidates, seed: int) -> DataFrame:
    """Each cloud goes through one of the transforms, chosen by its draw."""
    pick = F.floor(draw(seed, "cloud_id") * len(candidates))
    parts = [t(df.where(pick == k)) for k, t in enumerate(candidates)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def colour_drop(df: DataFrame, p: float, factor: float, seed: int, channels=("r", "g", "b")) -> DataFrame:
    """A cloud's colours times a factor, with probability p."""
    return df.withColumns({c: F.col(c) * F.when(draw(seed, "cloud_id") < p, factor).otherwise(1.0) for c in channels})


def colour_shift(df: DataFrame, p: float, ratio: float, seed: int, channels=("r", "g", "b")) -> DataFrame:
    """With probability p a cloud's channels move by up to ratio * 255, clipped to 0..255."""
    move = lambda k: (draw(seed + 1 + k, "cloud_id") - 0.5) * 2 * 255 * ratio
    shifted = {c: F.when(draw(seed, "cloud_id") < p, F.least(F.greatest(F.col(c) + move(k), F.lit(0.0)), F.lit(255.0))).otherwise(F.col(c)) for k, c in enumerate(channels)}
    return df.withColumns(shifted)


def colour_jitter(df: DataFrame, brightness: float, contrast: float, saturation: float, channels=("r", "g", "b")) -> DataFrame:
    """Brightness, then contrast (blended with the cloud's mean grey), then saturation (with the point's own grey)."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))
    grey = lambda d: sum((F.col(c) * w for c, w in zip(channels, GREY)), F.lit(0.0))
    out = df.withColumns({c: clip(F.col(c) * brightness) for c in channels})
    out = out.withColumn("_mean", F.avg(grey(out)).over(per_cloud()))
    out = out.withColumns({c: clip(F.col(c) * contrast + F.col("_mean") * (1 - contrast)) for c in channels})
    out = out.withColumn("_grey", grey(out))
    return out.withColumns({c: clip(F.col(c) * saturation + F.col("_grey") * (1 - saturation)) for c in channels}).drop("_mean", "_grey")


#: The grey of a colour.
GREY = (0.2989, 0.587, 0.114)


def _sixths(rgb: Sequence[Column], top: Column, spread: Column, turn: Column) -> Column:
    """The place on the circle in sixths, moved by a share of the circle."""
    r, g, b = rgb
    sixth = F.when(top == r, (g - b) / spread).when(top == g, 2 + (b - r) / spread).otherwise(4 + (r - g) / spread)
    return F.when(spread > 0, sixth).otherwise(0.0) + 6 * turn + 12  # above 0 for turns of up to one


def _channels(top: Column, spread: Column, sixth: Column) -> list[Column]:
    ks = [(sixth + n) % 6 for n in (5, 3, 1)]
    return [top - spread * F.greatest(F.least(k, 4 - k, F.lit(1.0)), F.lit(0.0)) for k in ks]


def turn_hue(rgb: Sequence[Column], turn: Column) -> list[Column]:
    """Colours of 0 to 255 with their hue moved by a share of the circle; greys stay."""
    top, spread = F.greatest(*rgb), F.greatest(*rgb) - F.least(*rgb)
    return _channels(top, spread, _sixths(rgb, top, spread, turn))


def random_colour_jitter(df: DataFrame, seed: int, brightness: tuple[float, float] | None = None, contrast: tuple[float, float] | None = None, saturation: tuple[float, float] | None = None, hue: tuple[float, float] | None = None, p: float = 0.95, channels=("r", "g", "b")) -> DataFrame:
    """Brightness, contrast (against the cloud's mean grey), saturation (against the point's grey) and hue, in an order that each
    cloud draws, each with probability p and by an amount drawn for the cloud from its range; a step without a range is left out.

    Colours go from 0 to 255 and are cut to it. The mean grey is that of the colours as the steps before left them. All steps
    share the exchange by cloud. A null colour stays null and doesn't count for the mean; hue makes all three null then.
    """
    ranges = {k: r for k, r in enumerate((brightness, contrast, saturation, hue)) if r is not None}
    for k, (low, high) in ranges.items():
        if not (-0.5 <= low <= high <= 0.5 if k == 3 else 0 <= low <= high):
            raise ValueError("a range runs upwards, from -0.5 to 0.5 for hue and from 0 for the others")
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))
    rgb = [F.col(c) for c in channels]
    grey = sum((c * w for c, w in zip(rgb, GREY)), F.lit(0.0))
    steps = [F.struct(draw(seed + k, "cloud_id").alias("at"), F.when(draw(seed + 4 + k, "cloud_id") < p, k).alias("step"), (lo + draw(seed + 8 + k, "cloud_id") * (hi - lo)).alias("amount")) for k, (lo, hi) in ranges.items()]
    out = df.withColumn("_steps", F.sort_array(F.array(*steps))) if steps else df
    for place in range(len(ranges)):
        # the window parts the drawing of steps from their use, so that they are drawn once
        out = out.withColumn("_grey", grey).withColumn("_mean", F.avg("_grey").over(per_cloud()))
        now = F.get("_steps", F.lit(place))
        out = out.withColumns({"_step": now["step"], "_amount": now["amount"]})
        step, a = F.col("_step"), F.col("_amount")
        out = out.withColumn("_against", F.when(step == 0, 0.0).when(step == 1, F.col("_mean")).otherwise(F.col("_grey")))
        # what the channels share are columns of their own: written out in each of them it makes code too long to be compiled
        out = out.withColumns({"_top": F.greatest(*rgb), "_spread": F.greatest(*rgb) - F.least(*rgb)})
        out = out.withColumn("_sixth", _sixths(rgb, F.col("_top"), F.col("_spread"), a))
        hued = _channels(F.col("_top"), F.col("_spread"), F.col("_sixth"))
        out = out.withColumns({c: F.when(step.isNull(), rgb[i]).when(step == 3, hued[i]).otherwise(clip(a * rgb[i] + (1 - a) * F.col("_against"))) for i, c in enumerate(channels)})
    return out.select(df.columns)


def drop_ribs_randomly(df: DataFrame, most: int, seed: int, min_points: int = 0, label: str = "rib") -> DataFrame:
    """Drop a drawn number of rib pairs (up to most, and up to the pairs present) from a drawn end of each cloud."""
    number = F.when(F.col(label) > 12, F.col(label) - 12).when(F.col(label) > 0, F.col(label))
    out = df.withColumn("_no", number).withColumn("_present", F.size(F.collect_set("_no").over(per_cloud())))
    depth = F.least(F.floor(draw(seed, "cloud_id") * (most + 1)), F.col("_present"))
    gone = F.coalesce(F.when(draw(seed + 1, "cloud_id") < 0.5, F.col("_no") <= depth).otherwise(F.col("_no") > 12 - depth), F.lit(False))
    out = out.withColumn("_gone", gone).withColumn("_left", F.count_if(~F.col("_gone")).over(per_cloud()))
    return out.where(~F.col("_gone") | (F.col("_left") < min_points)).select(df.columns)


def rotate_target(df: DataFrame, axis: str, angles: Sequence[float], p: float, seed: int) -> DataFrame:
    """With probability p a cloud turns about its box's centre by one of the angles (in half turns), drawn for the cloud."""
    pick = F.get(F.array(*[F.lit(float(a)) for a in angles]), F.floor(draw(seed + 1, "cloud_id") * len(angles)).cast("int"))
    return rotate_clouds(df, axis, F.when(draw(seed, "cloud_id") <= p, pick * F.pi()).otherwise(0.0))


def align_rooms(df: DataFrame, rooms: DataFrame) -> DataFrame:
    """Turn each cloud about z through its box's centre by (2 - angle / 180) half turns; rooms: cloud_id, angle in degrees. A
    cloud that isn't listed stays."""
    out = df.join(rooms.select("cloud_id", F.col("angle").alias("_angle")), "cloud_id", "left")
    return rotate_clouds(out, "z", F.coalesce((2 - F.col("_angle") / 180) * F.pi(), F.lit(0.0))).drop("_angle")


#: Points whose nodes a Python call holds at once: up to 216 nodes each, where they lie scattered.
ELASTIC_POINTS = 4096


def _distinct(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of nodes, and for each column its place among them."""
    low = nodes.min(axis=1, initial=0)
    spans = [int(x) for x in nodes.max(axis=1, initial=0) - low + 1]
    if math.prod(spans) < 1 << 62:
        key = np.zeros(nodes.shape[1], np.int64)
        for row, at, span in zip(nodes, low, spans):
            key = key * span + (row - at)
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        return nodes[:, first], place
    order = np.lexsort(nodes)
    new = np.concatenate([[True], (np.diff(nodes[:, order], axis=1) != 0).any(axis=0)])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return nodes[:, order[new]], place


def _noise(nodes: np.ndarray, cloud_ids: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The three blurred normal draws at distinct nodes (rows: place among cloud_ids, and along each axis), blurred axis by axis."""
    steps = []
    for a in range(3):
        size = sizes[a][nodes[0]]
        towards = np.repeat(nodes[:, None], 5, axis=1)
        towards[a + 1] += np.arange(-2, 3)[:, None]
        near, own = towards[a + 1], nodes[a + 1]
        # how many nodes of the grid lie within one of both ends, in ninths
        weight = (np.minimum(np.minimum(near, own) + 1, size - 1) - np.maximum(np.maximum(near, own) - 1, 0) + 1) / 9.0
        inside = (near >= 0) & (near < size)
        nodes, place = _distinct(towards[:, inside])
        steps.append((weight[inside], np.nonzero(inside)[1], place, len(own)))
    keys = (cloud_ids[nodes[0]], *nodes[1:])
    field = [np.sqrt(-2 * np.log(1 - drawn(seed + k, *keys))) * np.cos(2 * math.pi * drawn(seed + k + 1000, *keys)) for k in range(3)]
    for weight, to, place, n in reversed(steps):
        field = [np.bincount(to, weight * f[place], n) for f in field]
    return np.stack(field)


def _elastic_moves(cloud_ids: np.ndarray, at: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The noise at points: at and sizes hold a row for each axis, places in nodes and the number of nodes of the point's cloud."""
    ids, first, cloud = np.unique(cloud_ids, return_index=True, return_inverse=True)
    below = np.floor(at)
    part = at - below
    node = np.where(np.isfinite(below), below, 0).astype(np.int64)
    corners = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    nodes, place = _distinct(np.concatenate([np.stack([cloud, *(row + c for row, c in zip(node, corner))]) for corner in corners], axis=1))
    noise = _noise(nodes, ids, sizes[:, first], seed)
    moves = np.zeros((3, len(cloud)))
    for corner, own in zip(corners, place.reshape(8, -1)):
        moves += math.prod(p if c else 1 - p for c, p in zip(corner, part)) * noise[:, own]
    return moves


def elastic(df: DataFrame, granularity: float, magnitude: float, seed: int, gate: Column | None = None) -> DataFrame:
    """Move points by a smooth noise field: normal draws at the nodes of a grid, blurred twice by a box of three nodes along each
    axis (zero outside the grid), and interpolated trilinearly.

    A draw depends on its node alone, so whoever needs a node draws it: the points of a batch share theirs, no grid is built and
    neither nodes nor corners are shuffled. Clouds whose ``gate`` doesn't hold stay as they are, as do points that lack a key or a
    coordinate.
    """
    low = {f"_{a}": F.min(a).over(per_cloud()) for a in "xyz"}
    size = {f"_d{a}": F.floor((F.max(a).over(per_cloud()) - F.min(a).over(per_cloud())) / granularity).cast("bigint") + 3 for a in "xyz"}
    moving = F.lit(True) if gate is None else F.coalesce(gate, F.lit(False))
    for c in ("cloud_id", "point_id", *"xyz"):
        moving = moving & F.col(c).isNotNull()
    places = [((F.col(a) - F.col(f"_{a}")) / granularity + 1).cast("double") for a in "xyz"]

    def moves(cloud_id, moving, ux, uy, uz, dx, dy, dz):
        rows = np.flatnonzero(moving.to_numpy(zero_copy_only=False))
        ids, *columns = (c.take(pa.array(rows)).to_numpy(zero_copy_only=False) for c in (cloud_id, ux, uy, uz, dx, dy, dz))
        found = np.zeros((3, len(moving)))
        for k in range(0, len(rows), ELASTIC_POINTS):
            part = slice(k, k + ELASTIC_POINTS)
            found[:, rows[part]] = _elastic_moves(ids[part], np.stack([c[part] for c in columns[:3]]), np.stack([c[part] for c in columns[3:]]), seed)
        return pa.StructArray.from_arrays([pa.array(f) for f in found], ["x", "y", "z"])

    move = F.arrow_udf(moves, "x double, y double, z double")
    out = df.withColumns(low | size)
    out = out.withColumn("_move", move(F.col("cloud_id").cast("bigint"), moving, *places, *size))
    return out.withColumns({a: F.col(a) + F.col(f"_move.{a}") * magnitude for a in "xyz"}).select(df.columns)


def elastic_rounds(df: DataFrame, rounds: Sequence[tuple[float, float]] = ((0.2, 0.4), (0.8, 1.6)), p: float = 0.95, seed: int = 0) -> DataFrame:
    """With probability p a cloud goes through one distortion after the other, each of a granularity and a magnitude, in which
    the later ones start from the points that the earlier ones moved."""
    out, gate = df, draw(seed, "cloud_id") < p
    for k, (granularity, magnitude) in enumerate(rounds):
        out = elastic(out, granularity, magnitude, seed + 1 + 3 * k, gate)
    return out


def views(df: DataFrame, seed: int, global_views: int = 2, global_scale=(0.4, 1.0), local_views: int = 4, local_scale=(0.1, 0.4), most: int = 65536, height=(0.0, 1.0)) -> DataFrame:
    """Crops of each cloud: (cloud_id, view, kind, point_id, rank), view 0 the major global one.

    A view holds the points nearest to its centre, a drawn share of the cloud's points (of at most ``most``). The major centre is drawn
    among the points of a height band, the other global centres among the major view's points, and the local ones among those of
    them that no local view covers yet (among all again once all are covered).
    """
    w = per_cloud()
    size = lambda v, scale: F.floor((scale[0] + draw(seed + 100 + v, "cloud_id") * (scale[1] - scale[0])) * F.least(F.col("_n"), F.lit(most)))
    z0, z1 = F.min("z").over(w), F.max("z").over(w)
    out = df.select("cloud_id", "point_id", "x", "y", "z").withColumns({"_n": F.count("*").over(w), "_band": F.col("z").between(z0 + (z1 - z0) * height[0], z0 + (z1 - z0) * height[1])})

    def crop(rows: DataFrame, v: int, among: Column, scale) -> DataFrame:
        centre = F.min_by(F.struct("x", "y", "z"), F.when(among, F.struct(draw(seed + v, "cloud_id", "point_id"), F.col("point_id")))).over(w)
        rows = rows.withColumn("_c", centre)
        d2 = sum(((F.col(a) - F.col(f"_c.{a}")) ** 2 for a in "xyz"), F.lit(0.0))
        rows = rows.withColumn("_d2", d2).withColumn("_r", F.row_number().over(w.orderBy("_d2", "point_id")))
        return rows.withColumn(f"_v{v}", F.when(F.col("_r") <= size(v, scale), F.col("_r"))).drop("_c", "_d2", "_r")

    out = crop(out, 0, F.col("_band"), global_scale)
    for v in range(1, global_views):
        out = crop(out, v, F.col("_v0").isNotNull(), global_scale)
    out = out.withColumn("_open", F.col("_v0").isNotNull())
    for v in range(global_views, global_views + local_views):
        out = out.withColumn("_left", F.max("_open").over(w))
        out = out.withColumn("_open", F.when(F.col("_left"), F.col("_open")).otherwise(F.col("_v0").isNotNull())).drop("_left")
        out = crop(out, v, F.col("_open"), local_scale)
        out = out.withColumn("_open", F.col("_open") & F.col(f"_v{v}").isNull())
    held = F.array(*[F.struct(F.lit(v).alias("view"), F.lit("global" if v < global_views else "local").alias("kind"), F.col(f"_v{v}").alias("rank")) for v in range(global_views + local_views)])
    return out.select("cloud_id", "point_id", F.explode(held).alias("v")).select("cloud_id", "v.view", "v.kind", "point_id", "v.rank").where("rank is not null")
