"""Curves and embeddings (P60, P61, P63, G19) and camera or pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hilbert_codes(points: np.ndarray, bits: int) -> np.ndarray:
    """Codes of integer points [n, d] along the Hilbert curve of 2^bits cells a side.

    From the top bit down each axis that has the bit set flips the lower bits of the first axis, and one that has it
    clear trades them with the first axis; a Gray code over the interleaved bits then gives the place on the curve.
    """
    x = points.astype(np.int64).copy()
    d = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for a in range(d):
            one = (x[:, a] & q) > 0
            trade = np.where(one, 0, (x[:, 0] ^ x[:, a]) & low)
            x[:, 0] ^= np.where(one, low, trade)
            x[:, a] ^= trade
        q >>= 1
    for a in range(1, d):
        x[:, a] ^= x[:, a - 1]
    turn = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[:, d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    code = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for a in range(d):
            code = (code << 1) | ((x[:, a] >> b) & 1)
    return code


def hilbert(i: Column, j: Column, k: Column, bits: int = 16) -> Column:
    """The Hilbert code of three indices below 2^bits, in Arrow batches. Swap i and j for the transposed curve."""

    @F.pandas_udf("bigint")
    def code(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_codes(np.stack([a, b, c], axis=1), bits))

    return code(i.cast("bigint"), j.cast("bigint"), k.cast("bigint"))


def hilbert_points(codes: np.ndarray, bits: int, d: int = 3) -> np.ndarray:
    """The integer points of Hilbert codes: the steps of hilbert_codes undone, from the lowest bit up."""
    x = np.zeros((len(codes), d), np.int64)
    for b in range(bits * d):
        x[:, d - 1 - b % d] |= ((codes >> b) & 1) << (b // d)
    carry = x[:, d - 1] >> 1
    for a in range(d - 1, 0, -1):
        x[:, a] ^= x[:, a - 1]
    x[:, 0] ^= carry
    for b in range(1, bits):
        q = 1 << b
        low = q - 1
        for a in range(d - 1, -1, -1):
            one = (x[:, a] & q) > 0
            trade = np.where(one, 0, (x[:, 0] ^ x[:, a]) & low)
            x[:, 0] ^= np.where(one, low, trade)
            x[:, a] ^= trade
    return x


def hilbert_decode(code: Column, bits: int = 16) -> Column:
    """The three indices of a Hilbert code, as a struct (i, j, k), in Arrow batches."""

    @F.pandas_udf("i bigint, j bigint, k bigint")
    def points(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(hilbert_points(c.to_numpy(np.int64), bits), columns=["i", "j", "k"])

    return points(code.cast("bigint"))


def serial_orders(df: DataFrame, orders: Sequence[str] = ("z", "z-trans", "hilbert", "hilbert-trans"), columns: Sequence[str] = ("cx", "cy", "cz"), bits: int = 10) -> DataFrame:
    """For each order a code and the rank along that curve in the cloud, ties by id: columns code_<order>, ord_<order>, with _ for
    the hyphen. The transposed curves take the second index first."""
    from cloudloom.operators.scalar import morton

    i, j, k = (F.col(c) for c in columns)
    out = df
    for name in orders:
        curve, _, turned = name.partition("-")
        if curve not in ("z", "hilbert") or turned not in ("", "trans"):
            raise ValueError(f"unknown order {name}")
        a, b = (j, i) if turned else (i, j)
        out = out.withColumn(f"code_{name.replace('-', '_')}", morton(a, b, k, bits=bits) if curve == "z" else hilbert(a, b, k, bits))
    rank = lambda name: F.row_number().over(Window.partitionBy("cloud_id").orderBy(f"code_{name}", "point_id")) - 1
    return out.withColumns({f"ord_{n}": rank(n) for n in (o.replace("-", "_") for o in orders)})


def with_cloud_prefix(cloud: Column, code: Column, bits: int) -> Column:
    """The cloud's number above the bits of the code."""
    return F.shiftleft(cloud.cast("bigint"), 3 * bits).bitwiseOR(code)


def split_prefix(code: Column, bits: int) -> list[Column]:
    """Cloud number and code again."""
    return [F.shiftright(code, 3 * bits), code.bitwiseAND(F.lit((1 << 3 * bits) - 1))]


def sine_embedding(df: DataFrame, columns: Sequence[str], width: int, temperature: float = 10_000.0) -> DataFrame:
    """Sines and cosines of each coordinate, normalised to its cloud's range, at ``width`` frequencies."""
    w = Window.partitionBy("cloud_id")
    parts = []
    for c in columns:
        share = F.coalesce(F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0)) * 2 * F.pi()
        for k in range(width):
            angle = share / temperature ** (k / width)
            parts += [F.sin(angle), F.cos(angle)]
    return df.withColumn("embedding", F.array(*parts))


def relative_cells(patches: DataFrame, cells: Sequence[str] = ("cx", "cy", "cz")) -> DataFrame:
    """Cell offsets of every pair of points in a patch (of bounded size)."""
    other = patches.select("cloud_id", "patch", F.col("point_id").alias("other"), *[F.col(c).alias(f"_{c}") for c in cells])
    return patches.join(other, ["cloud_id", "patch"]).select("cloud_id", "patch", "point_id", "other", *[(F.col(c) - F.col(f"_{c}")).alias(f"d{c[-1]}") for c in cells])


def compose_rigid(rotation: Sequence[Column], move: Sequence[Column], point: Sequence[Column]) -> list[Column]:
    """A row-major 3 x 3 rotation, then a translation."""
    return [sum((rotation[3 * r + c] * point[c] for c in range(3)), move[r]) for r in range(3)]


def inverse_rigid(rotation: Sequence[Column], move: Sequence[Column], point: Sequence[Column]) -> list[Column]:
    """The point in the frame of a rigid pose: translated back, then rotated by the transpose."""
    d = [p - m for p, m in zip(point, move)]
    return [sum((rotation[3 * c + r] * d[c] for c in range(3)), F.lit(0.0)) for r in range(3)]


def centre_crop(u: str, v: str, width: int, height: int, patch: int) -> Column:
    """Pixels of the centred crop whose sides are multiples of the patch."""
    w, h = width // patch * patch, height // patch * patch
    left, top = (width - w) // 2, (height - h) // 2
    return F.col(u).between(left, left + w - 1) & F.col(v).between(top, top + h - 1)


def image_normals(pixels: DataFrame) -> DataFrame:
    """Cross product of the steps to the next pixel down and right; a last row or column gives a zero vector."""
    down, right = Window.partitionBy("frame", "u").orderBy("v"), Window.partitionBy("frame", "v").orderBy("u")
    a = [F.coalesce(F.lead(c).over(down), F.col(c)) - F.col(c) for c in "xyz"]
    b = [F.coalesce(F.lead(c).over(right), F.col(c)) - F.col(c) for c in "xyz"]
    return pixels.withColumns({"nx": a[1] * b[2] - a[2] * b[1], "ny": a[2] * b[0] - a[0] * b[2], "nz": a[0] * b[1] - a[1] * b[0]})
