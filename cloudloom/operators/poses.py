"""Rigid poses as rows of twelve numbers, chains of them between sensors, and boxes in a sensor's frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.operators.curves import compose_rigid, inverse_rigid


def quaternion_matrix(q: Sequence[Column]) -> list[Column]:
    """The row-major rotation of a quaternion w, x, y, z of any length; of a zero quaternion the parts are null."""
    w, x, y, z = q
    s = F.try_divide(F.lit(2.0), w * w + x * x + y * y + z * z)
    diagonal = lambda a, b: 1 - s * (a * a + b * b)
    return [diagonal(y, z), s * (x * y - z * w), s * (x * z + y * w), s * (x * y + z * w), diagonal(x, z), s * (y * z - x * w), s * (x * z - y * w), s * (y * z + x * w), diagonal(x, y)]


def _let(values: Sequence[Column], f: Callable[..., Column]) -> Column:
    """f of the values, each worked out once however often f names it."""
    held = F.struct(*[v.alias(f"_{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(held), lambda s: f(*[s[f"_{i}"] for i in range(len(values))])), F.lit(0))


def pose(q: Sequence[Column], move: Sequence[Column]) -> Column:
    """A pose as an array: nine numbers of the rotation, row by row, then the translation. Null where any of its parts is."""

    def parts(w, x, y, z, *t):
        all_of = [*quaternion_matrix([w, x, y, z]), *t]
        whole = all_of[0].isNotNull()
        for m in t:
            whole = whole & m.isNotNull()
        return F.when(whole, F.array(*all_of))

    return _let([c.cast("double") for c in (*q, *move)], parts)


def _parts(p: Column) -> tuple[list[Column], list[Column]]:
    return [p[k] for k in range(9)], [p[k] for k in range(9, 12)]


def apply(p: Column, point: Sequence[Column]) -> list[Column]:
    """The point of a pose's own frame in the frame that the pose is given in."""
    return compose_rigid(*_parts(p), point)


def apply_inverse(p: Column, point: Sequence[Column]) -> list[Column]:
    """The point in the pose's own frame."""
    return inverse_rigid(*_parts(p), point)


def compose(outer: Column, inner: Column) -> Column:
    """First inner, then outer. Associative, so a chain may be grouped in any way."""

    def product(a, b):
        r, t = _parts(b)
        turned = [compose_rigid(_parts(a)[0], [F.lit(0.0)] * 3, [r[c], r[3 + c], r[6 + c]]) for c in range(3)]
        return F.when(a.isNotNull() & b.isNotNull(), F.array(*[turned[c][row] for row in range(3) for c in range(3)], *apply(a, t)))

    return _let([outer, inner], product)


def inverse(p: Column) -> Column:
    def turned_back(a):
        r, _ = _parts(a)
        return F.when(a.isNotNull(), F.array(*[r[3 * c + row] for row in range(3) for c in range(3)], *apply_inverse(a, [F.lit(0.0)] * 3)))

    return _let([p], turned_back)


def as_of(rows: DataFrame, history: DataFrame, by: Sequence[str], time: str, values: Sequence[str], tie: str | None = None) -> DataFrame:
    """rows with the values of the latest history row of the same keys whose time isn't later; null where there is none.

    Both sides meet in one shuffle and one ordered pass over their union, so rows times history is never formed. Of history rows of
    the same time the one of the greatest ``tie`` counts. A null time or key finds nothing.
    """
    last = F.col(tie) if tie else F.lit(None)
    held = history.where(F.col(time).isNotNull()).select(*by, time, F.struct(*values).alias("_held"), last.alias("_tie"), F.lit(None).alias("_row"))
    asked = rows.select(*by, time, F.lit(None).alias("_held"), F.lit(None).alias("_tie"), F.struct(*rows.columns).alias("_row"))
    both = held.unionByName(asked)
    w = Window.partitionBy(*by).orderBy(F.col(time).asc_nulls_first(), F.col("_row").isNotNull(), "_tie").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("_row").isNotNull()
    for b in by:
        known = known & F.col(b).isNotNull()
    found = both.withColumn("_held", F.last("_held", ignorenulls=True).over(w)).where("_row is not null")
    return found.select("_row.*", *[F.when(known, F.col(f"_held.{v}")).alias(v) for v in values])


def sensor_to_reference(records: DataFrame, calibrations: DataFrame, references: DataFrame) -> DataFrame:
    """For each record of a sensor its pose in the frame of its sample's reference sensor, as ``pose``: from the sensor to the
    vehicle and the world at the record's time, and back to the vehicle and the reference sensor at the sample's.

    records: sample, sensor and vehicle_pose (see ``as_of``); calibrations: sensor and sensor_pose, one row for each of the rig's
    sensors; references: sample, sensor and vehicle_pose. Without a calibration, pose or sample the result is null.
    """
    own = calibrations.select("sensor", "sensor_pose")
    ref = references.join(own, "sensor", "left").select("sample", inverse(compose(F.col("vehicle_pose"), F.col("sensor_pose"))).alias("_back"))
    out = records.join(own, "sensor", "left").withColumn("_world", compose(F.col("vehicle_pose"), F.col("sensor_pose")))
    out = out.join(ref, "sample", "left").withColumn("pose", compose(F.col("_back"), F.col("_world")))
    return out.drop("sensor_pose", "_back", "_world")


def box_velocity(boxes: DataFrame, instance: str, order: Sequence[str], time: str, longest: float) -> DataFrame:
    """P50: each box's velocity in the world, as ``vx``, ``vy`` and ``vz``: from the annotation before to the one after of its instance, or
    from or to itself at an end.

    Null for a lone annotation, for no time in between, and where the time is longer than ``longest`` (twice that between both
    neighbours). ``order`` should leave no ties; times are in seconds.
    """
    w = Window.partitionBy(instance).orderBy(*order)
    before, after = F.lag(F.struct("x", "y", "z", time)).over(w), F.lead(F.struct("x", "y", "z", time)).over(w)
    out = boxes.withColumns({"_b": before, "_a": after})
    ends = {c: (F.coalesce(F.col(f"_b.{c}"), F.col(c)), F.coalesce(F.col(f"_a.{c}"), F.col(c))) for c in ("x", "y", "z", time)}
    passed = ends[time][1] - ends[time][0]
    limit = F.when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), 2 * longest).otherwise(longest)
    out = out.withColumn("_t", F.when((passed > 0) & (passed <= limit), passed))
    return out.withColumns({f"v{c}": (ends[c][1] - ends[c][0]) / F.col("_t") for c in "xyz"}).drop("_a", "_b", "_t")


def boxes_in_sensor(boxes: DataFrame, references: DataFrame, calibrations: DataFrame) -> DataFrame:
    """P50: boxes of the world in the frame of their sample's reference sensor, as one row (cx, cy, cz, dx, dy, dz, yaw, vx, vy) each.

    Centre, heading and velocity go to the vehicle's frame and then to the sensor's; sizes change from width, length and height to
    length, width and height; yaw is the heading's angle about the sensor's z. boxes: sample, x, y, z, q (quaternion w, x, y, z),
    w, l, h, vx, vy, vz and n_points; boxes without points are left out, and those of a sample without a pose have null results.
    """
    frame = references.join(calibrations.select("sensor", "sensor_pose"), "sensor", "left").select("sample", F.col("vehicle_pose").alias("_v"), F.col("sensor_pose").alias("_s"))
    kept = boxes.where("n_points > 0").join(frame, "sample", "left")
    both = compose(F.col("_v"), F.col("_s"))
    kept = kept.withColumn("_p", both)
    turn = lambda v: inverse_rigid(_parts(F.col("_p"))[0], [F.lit(0.0)] * 3, v)  # noqa: E731  directions have no place
    heading = quaternion_matrix([F.col("q")[k] for k in range(4)])
    ahead = turn([heading[0], heading[3], heading[6]])
    yaw = F.atan2(ahead[1], ahead[0])
    half_turn = F.lit(1e-9) - F.pi()  # -pi and pi are one angle
    centre, v = apply_inverse(F.col("_p"), [F.col(a) for a in "xyz"]), turn([F.col(f"v{a}") for a in "xyz"])
    out = {**dict(zip(("cx", "cy", "cz"), centre)), "dx": F.col("l"), "dy": F.col("w"), "dz": F.col("h"), "yaw": F.when(yaw < half_turn, yaw + 2 * F.pi()).otherwise(yaw)}
    out |= {"sensor_vx": v[0], "sensor_vy": v[1]}
    moved = kept.withColumns(out).drop("_v", "_s", "_p", "vx", "vy", "vz", "x", "y", "z", "q", "w", "l", "h")
    return moved.withColumnsRenamed({"sensor_vx": "vx", "sensor_vy": "vy"})
