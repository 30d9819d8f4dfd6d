"""Row-wise operators on points (P*): pure column expressions, fused by Catalyst into the scan's stage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def copy_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """New columns (keys) that copy others (values)."""
    return df.withColumns({new: F.col(old) for new, old in columns.items() if old in df.columns})


def set_constants(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    """Constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def features(*columns: str | Column) -> Column:
    """Scalars and vectors as one feature vector, in order."""
    return F.array(*[F.col(c).cast("double") if isinstance(c, str) else c for c in columns])


def take_axes(vector: str | Column, axes: Sequence[int]) -> Column:
    """P5: the given components of a vector."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.array(*[v[a] for a in axes])


def binarise(label: str, classes: Sequence[int]) -> Column:
    """1 for the classes of interest, else 0."""
    return F.when(F.col(label).isin(*classes), 1).otherwise(0)


def remap(label: str, mapping: Mapping[int, int], ignore: int = -1) -> Column:
    """Look-up by a literal map; what isn't there is ignored."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(label)), F.lit(ignore))


def window_intensity(value: str, low: float, high: float) -> Column:
    """Clip to a window and scale to 0..1."""
    return (F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high)) - low) / (high - low)


def clip_points(df: DataFrame, box: Sequence[float]) -> DataFrame:
    """Clamp coordinates to (x0, y0, z0, x1, y1, z1)."""
    return df.withColumns({a: F.least(F.greatest(F.col(a), F.lit(float(box[k]))), F.lit(float(box[k + 3]))) for k, a in enumerate("xyz")})


def apply_affine(x: str, y: str, z: str, affine: Sequence[float]) -> list[Column]:
    """A row-major 4 x 4 matrix applied to voxel indices."""
    return [sum((F.col(c) * float(affine[4 * r + k]) for k, c in enumerate((x, y, z))), F.lit(float(affine[4 * r + 3]))) for r in range(3)]


def rotate(axis: str, angle: Column, centre: Mapping[str, Column]) -> dict[str, Column]:
    """Coordinates turned about an axis through a centre; the angle in radians, right-handed."""
    a, b = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}[axis]
    da, db = F.col(a) - centre[a], F.col(b) - centre[b]
    return {a: da * F.cos(angle) - db * F.sin(angle) + centre[a], b: da * F.sin(angle) + db * F.cos(angle) + centre[b]}


def yaw_of(w: Column, x: Column, y: Column, z: Column) -> Column:
    """A quaternion's rotation about the vertical axis."""
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def unproject(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> list[Column]:
    """A depth pixel as a point in the camera's frame."""
    return [(u - cx) / fx * depth, (v - cy) / fy * depth, depth]


def panorama_point(u: Column, v: Column, depth: Column, width: float, height: float) -> list[Column]:
    """A panorama pixel as a point on its viewing ray."""
    lon, lat = (u / width - 0.5) * 2 * F.pi(), (F.lit(0.5) - v / height) * F.pi()
    return [depth * F.cos(lat) * F.sin(lon), depth * F.sin(lat), depth * F.cos(lat) * F.cos(lon)]


def z_depth(u: Column, v: Column, ray: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    """The length along a pixel's ray as depth along the optical axis."""
    return ray / F.sqrt(((u - cx) / fx) ** 2 + ((v - cy) / fy) ** 2 + 1)


def voxel_key(i: Column, j: Column, k: Column, shape: Sequence[int]) -> Column:
    """One key for a voxel; an index beyond the shape is an error."""
    inside = (i >= 0) & (i < shape[0]) & (j >= 0) & (j < shape[1]) & (k >= 0) & (k < shape[2])
    return F.when(inside, (i * shape[1] + j) * shape[2] + k).otherwise(F.raise_error(F.lit("voxel index beyond the grid's shape")).cast("bigint"))


def spread_bits(v: Column, bits: int = 16) -> Column:
    """Bit b of v moved to bit 3b."""
    v = v.cast("bigint")
    return sum((F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1)), 2 * b + b) for b in range(1, bits)), v.bitwiseAND(F.lit(1)))


def morton(i: Column, j: Column, k: Column, bits: int = 16) -> Column:
    """Z-order code; i takes the highest bit of each triple."""
    return F.shiftleft(spread_bits(i, bits), 2) + F.shiftleft(spread_bits(j, bits), 1) + spread_bits(k, bits)


def morton_decode(code: Column, bits: int = 16) -> list[Column]:
    """The three indices of a z-order code."""
    gather = lambda at: sum((F.shiftleft(F.shiftright(code, 3 * b + at).bitwiseAND(F.lit(1)), b) for b in range(1, bits)), F.shiftright(code, at).bitwiseAND(F.lit(1)))
    return [gather(2), gather(1), gather(0)]


def bits_needed(top: Column) -> Column:
    """Bit length of a non-negative integer."""
    return F.when(top > 0, F.length(F.bin(top.cast("bigint")))).otherwise(0)


def grey(r: str, g: str, b: str) -> Column:
    """Luminance."""
    return 0.2989 * F.col(r) + 0.587 * F.col(g) + 0.114 * F.col(b)


def hsv(r: str, g: str, b: str) -> list[Column]:
    """Hue (0..1), saturation and value of colours of 0..255."""
    cr, cg, cb = (F.col(c) / 255.0 for c in (r, g, b))
    top, low = F.greatest(cr, cg, cb), F.least(cr, cg, cb)
    d = top - low
    hue = F.when(d == 0, F.lit(0.0)).when(top == cr, F.pmod(F.try_divide(cg - cb, d), F.lit(6.0))).when(top == cg, F.try_divide(cb - cr, d) + 2).otherwise(F.try_divide(cr - cg, d) + 4) / 6
    return [hue, F.coalesce(F.try_divide(d, top), F.lit(0.0)), top]


def gaussian_kernel(d2: Column, a: float, c: float) -> Column:
    """P64."""
    return a * F.exp(-d2 / (2 * c * c))


def natural_key(name: str, width: int = 12) -> Column:
    """A key that sorts digit runs as numbers: every run padded to a width."""
    padded = F.regexp_replace(F.col(name), r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1")


def axis_directions(codes: str) -> list[float]:
    """The row-major 3 x 3 direction matrix of axis codes such as 'RAS'."""
    rows = {"R": (0, 1.0), "L": (0, -1.0), "A": (1, 1.0), "P": (1, -1.0), "S": (2, 1.0), "I": (2, -1.0)}
    out = [0.0] * 9
    for column, c in enumerate(codes):
        row, sign = rows[c]
        out[3 * row + column] = sign
    return out


def reorientation(source: str, target: str) -> tuple[list[int], list[bool]]:
    """For each target axis, the source axis it comes from and whether it's flipped. X, Y and Z in the target take an axis in
    either direction; in the source they can't be told from a direction that is asked for."""
    same = {"R": "X", "L": "X", "X": "X", "A": "Y", "P": "Y", "Y": "Y", "S": "Z", "I": "Z", "Z": "Z"}
    for codes in (source, target):
        if sorted(same[c] for c in codes) != ["X", "Y", "Z"]:
            raise ValueError(f"{codes} doesn't name the three axes once each")
    order = [next(k for k, s in enumerate(source) if same[s] == same[t]) for t in target]
    if any(source[o] in "XYZ" and t not in "XYZ" for o, t in zip(order, target)):
        raise ValueError(f"{source} leaves a direction of {target} open")
    return order, [t not in "XYZ" and source[o] != t for o, t in zip(order, target)]


def reorient_points(df: DataFrame, source: str, target: str, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Points in the target orientation: axes permuted, and on flipped ones the cloud's least and greatest value less the own."""
    order, flip = reorientation(source, target)
    w = Window.partitionBy("cloud_id")
    new = {c: (F.min(columns[o]).over(w) + F.max(columns[o]).over(w) - F.col(columns[o])) if f else F.col(columns[o]) for c, o, f in zip(columns, order, flip)}
    return df.select(*[c for c in df.columns if c not in columns], *[v.alias(c) for c, v in new.items()])


def reorient(df: DataFrame, source: str, target: str, size: Sequence[int], columns: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """Voxel indices in the target orientation: permuted, and size - 1 - index on flipped axes."""
    order, flip = reorientation(source, target)
    new = {c: (F.lit(size[o] - 1) - F.col(columns[o])) if f else F.col(columns[o]) for c, o, f in zip(columns, order, flip)}
    return df.select(*[c for c in df.columns if c not in columns], *[v.alias(c) for c, v in new.items()])


def normalise_colour(df: DataFrame, channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """P25: colours from 0..255 to 0..1."""
    return df.withColumns({c: F.col(c) / 255 for c in channels})
