"""Queries of sensor poses: orders are a vehicle's samples, their items the records of other sensors and the annotated boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.operators import poses
from cloudloom.plans.catalog import query
from cloudloom.plans.geometry import rounded
from cloudloom.sources.fixtures import read


def calibrations(spark, d):
    """A rig of 25 sensors: one for each nation."""
    s = F.col("n_nationkey").cast("double")
    return read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("sensor"), poses.pose([F.lit(3.0), s % 2, s % 3 - 1, s % 5 - 2], [s / 10, -s / 5, F.lit(1.5)]).alias("sensor_pose"))


def samples(spark, d):
    """One sample for each order: the customer's vehicle at the order's day, seen by sensor 1."""
    k = F.col("o_orderkey").cast("double")
    at = poses.pose([1 + k % 7, k % 3 - 1, k % 5 - 2, k % 11 - 5], [F.col("o_totalprice").cast("double") / 1000, k % 100, k % 4])
    return read(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("sample"), F.lit(1).cast("bigint").alias("sensor"), F.col("o_custkey").cast("bigint").alias("vehicle"), F.col("o_orderdate").cast("date").alias("day"), at.alias("vehicle_pose"))


ITEMS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
SAMPLES = """cal AS (SELECT n_nationkey::bigint AS sensor, 3.0::double AS cw, (n_nationkey % 2)::double AS ci, (n_nationkey % 3 - 1)::double AS cj, (n_nationkey % 5 - 2)::double AS ck,
  n_nationkey/10.0::double AS tx, -n_nationkey/5.0::double AS ty, 1.5::double AS tz FROM nation),
 ego AS (SELECT o_orderkey::bigint AS sample, o_custkey::bigint AS vehicle, o_orderdate::date AS day, (1 + o_orderkey % 7)::double AS ew, (o_orderkey % 3 - 1)::double AS ei, (o_orderkey % 5 - 2)::double AS ej,
  (o_orderkey % 11 - 5)::double AS ek, (o_totalprice/1000)::double AS px, (o_orderkey % 100)::double AS py, (o_orderkey % 4)::double AS pz FROM orders)"""


def turned(q: tuple[str, str, str, str], v: tuple[str, str, str], back: bool = False) -> list[str]:
    """SQL of a vector turned by a quaternion, by two cross products."""
    w, i, j, k = q
    if back:
        i, j, k = f"(-{i})", f"(-{j})", f"(-{k})"
    x, y, z = v
    a = f"({j}*{z} - {k}*{y} + {w}*{x})", f"({k}*{x} - {i}*{z} + {w}*{y})", f"({i}*{y} - {j}*{x} + {w}*{z})"
    n = f"({w}*{w} + {i}*{i} + {j}*{j} + {k}*{k})"
    return [f"({x} + 2*({j}*{a[2]} - {k}*{a[1]})/{n})", f"({y} + 2*({k}*{a[0]} - {i}*{a[2]})/{n})", f"({z} + 2*({i}*{a[1]} - {j}*{a[0]})/{n})"]


def _step(name: str, source: str, q: str, t: tuple[str, str, str], back: bool) -> str:
    """A common table: the points u, v, w of source moved by a pose or back."""
    names, turn = ("u", "v", "w"), tuple(f"{q}{c}" for c in "wijk")
    if back:
        new = turned(turn, tuple(f"({n} - {m})" for n, m in zip(names, t)), back=True)
    else:
        new = [f"{r} + {m}" for r, m in zip(turned(turn, names), t)]
    return f"{name} AS (SELECT * EXCLUDE (u, v, w), {', '.join(f'{e} AS {n}' for e, n in zip(new, names))} FROM {source})"


@query("p49_sensor_chain", f"""WITH {SAMPLES},
 rec AS (SELECT row_number() OVER () AS rid, l_orderkey::bigint AS sample, l_linenumber::bigint AS sensor, l_partkey::bigint AS part, l_shipdate::date AS day, o.vehicle FROM lineitem JOIN ego o ON o.sample = l_orderkey),
 seen AS (SELECT rid, arg_max(e.sample, (e.day, e.sample)) AS latest FROM rec JOIN ego e ON e.vehicle = rec.vehicle AND e.day <= rec.day GROUP BY 1),
 b AS (SELECT r.rid, r.sample, r.sensor, r.part, s.latest, c.cw, c.ci, c.cj, c.ck, c.tx, c.ty, c.tz, e.ew, e.ei, e.ej, e.ek, e.px, e.py, e.pz, f.ew AS fw, f.ei AS fi, f.ej AS fj, f.ek AS fk, f.px AS qx, f.py AS qy, f.pz AS qz,
  g.cw AS gw, g.ci AS gi, g.cj AS gj, g.ck AS gk, g.tx AS sx, g.ty AS sy, g.tz AS sz, axis, (axis = 1)::int::double AS u, (axis = 2)::int::double AS v, (axis = 3)::int::double AS w
  FROM rec r LEFT JOIN seen s ON s.rid = r.rid LEFT JOIN ego e ON e.sample = s.latest LEFT JOIN cal c ON c.sensor = r.sensor JOIN ego f ON f.sample = r.sample JOIN cal g ON g.sensor = 1, range(4) t(axis)),
 {_step('s1', 'b', 'c', ('tx', 'ty', 'tz'), False)}, {_step('s2', 's1', 'e', ('px', 'py', 'pz'), False)}, {_step('s3', 's2', 'f', ('qx', 'qy', 'qz'), True)}, {_step('s4', 's3', 'g', ('sx', 'sy', 'sz'), True)}
 SELECT sample, sensor, part, latest AS pose_sample, round(max(u) FILTER (axis = 0), 5) + 0.0 AS tx, round(max(v) FILTER (axis = 0), 5) + 0.0 AS ty, round(max(w) FILTER (axis = 0), 5) + 0.0 AS tz,
  {', '.join(f'round(max({c}) FILTER (axis = {k}) - max({c}) FILTER (axis = 0), 5) + 0.0 AS r{n}{k}' for n, c in enumerate('uvw', 1) for k in (1, 2, 3))} FROM s4 GROUP BY rid, sample, sensor, part, latest""")
def _(spark, d):
    s = samples(spark, d)
    items = read(spark, d, "lineitem").selectExpr("cast(l_orderkey as bigint) sample", "cast(l_linenumber as bigint) sensor", "cast(l_partkey as bigint) part", "cast(l_shipdate as date) day")
    history = s.select("vehicle", "day", "vehicle_pose", F.col("sample").alias("pose_sample"))
    rows = poses.as_of(items.join(s.select("sample", "vehicle"), "sample"), history, ["vehicle"], "day", ["vehicle_pose", "pose_sample"], tie="pose_sample")
    out = poses.sensor_to_reference(rows, calibrations(spark, d), s)
    numbers = {f"r{r + 1}{c + 1}": F.col("pose")[3 * r + c] for r in range(3) for c in range(3)} | {f"t{a}": F.col("pose")[9 + k] for k, a in enumerate("xyz")}
    return rounded(out.withColumns(numbers).select("sample", "sensor", "part", "pose_sample", *numbers), *numbers, digits=5)


@query("p50_sensor_boxes", f"""WITH {SAMPLES},
 it AS (SELECT {ITEMS}, l_quantity::double AS x, l_discount::double * 100 AS y, l_tax::double * 100 AS z, epoch(l_shipdate::timestamp)::double AS t FROM lineitem),
 nb AS (SELECT *, lag(x) OVER o AS bx, lag(y) OVER o AS "by", lag(z) OVER o AS bz, lag(t) OVER o AS earlier, lead(x) OVER o AS ax, lead(y) OVER o AS ay, lead(z) OVER o AS az, lead(t) OVER o AS later FROM it WINDOW o AS (PARTITION BY l_partkey ORDER BY l_shipdate, {ITEMS})),
 ve AS (SELECT *, coalesce(later, t) - coalesce(earlier, t) AS dt, CASE WHEN later IS NOT NULL AND earlier IS NOT NULL THEN 2 ELSE 1 END * 8640000 AS most FROM nb),
 vx AS (SELECT *, CASE WHEN dt > 0 AND dt <= most THEN dt/86400 END AS dd FROM ve),
 b AS (SELECT l_orderkey::bigint AS sample, l_partkey::bigint AS part, l_linenumber::bigint AS line, axis, 1 + l_partkey % 3 AS bw, 2 + l_partkey % 4 AS bl, 1.5::double AS bh, ew, ei, ej, ek, px, py, pz, cw, ci, cj, ck, tx, ty, tz,
  CASE axis WHEN 0 THEN x WHEN 1 THEN px + hx WHEN 2 THEN px + (coalesce(ax, x) - coalesce(bx, x))/dd END AS u, CASE axis WHEN 0 THEN y WHEN 1 THEN py + hy WHEN 2 THEN py + (coalesce(ay, y) - coalesce("by", y))/dd END AS v,
  CASE axis WHEN 0 THEN z WHEN 1 THEN pz + hz WHEN 2 THEN pz + (coalesce(az, z) - coalesce(bz, z))/dd END AS w, rid
  FROM (SELECT *, row_number() OVER () AS rid, {', '.join(f'{e} AS h{a}' for e, a in zip(turned(('5.0::double', '(l_partkey % 2)::double', '0.0::double', '(l_suppkey % 9 - 4)::double'), ('1.0::double', '0.0::double', '0.0::double')), 'xyz'))} FROM vx WHERE l_partkey % 4 > 0) q
  JOIN ego ON sample = l_orderkey JOIN cal ON sensor = 1, range(3) r(axis)),
 {_step('s1', 'b', 'e', ('px', 'py', 'pz'), True)}, {_step('s2', '(SELECT * REPLACE (CASE axis WHEN 0 THEN tx ELSE 0 END AS tx, CASE axis WHEN 0 THEN ty ELSE 0 END AS ty, CASE axis WHEN 0 THEN tz ELSE 0 END AS tz) FROM s1)', 'c', ('tx', 'ty', 'tz'), True)}
 SELECT sample, part, line, round(max(u) FILTER (axis = 0), 5) + 0.0 AS cx, round(max(v) FILTER (axis = 0), 5) + 0.0 AS cy, round(max(w) FILTER (axis = 0), 5) + 0.0 AS cz, any_value(bl)::double AS dx, any_value(bw)::double AS dy, any_value(bh) AS dz,
  round(CASE WHEN atan2(max(v) FILTER (axis = 1), max(u) FILTER (axis = 1)) < 1e-9 - pi() THEN pi() ELSE atan2(max(v) FILTER (axis = 1), max(u) FILTER (axis = 1)) END, 5) + 0.0 AS yaw,
  round(max(u) FILTER (axis = 2), 8) + 0.0 AS vx, round(max(v) FILTER (axis = 2), 8) + 0.0 AS vy FROM s2 GROUP BY rid, sample, part, line""")
def _(spark, d):
    rows = read(spark, d, "lineitem").selectExpr(
        *ITEMS.split(", "), "cast(l_quantity as double) x", "cast(l_discount as double) * 100 y", "cast(l_tax as double) * 100 z", "cast(unix_date(cast(l_shipdate as date)) as double) t",
        "array(5D, cast(l_partkey % 2 as double), 0D, cast(l_suppkey % 9 - 4 as double)) q", "cast(1 + l_partkey % 3 as double) w", "cast(2 + l_partkey % 4 as double) l", "1.5D h", "l_partkey % 4 n_points",
        "cast(l_orderkey as bigint) sample", "cast(l_partkey as bigint) part", "cast(l_linenumber as bigint) line",
    )
    boxes = poses.box_velocity(rows, "part", ["l_shipdate", *ITEMS.split(", ")], "t", 100.0)
    out = poses.boxes_in_sensor(boxes.drop("l_linenumber"), samples(spark, d), calibrations(spark, d))
    numbers = ["cx", "cy", "cz", "yaw"]
    out = rounded(out.select("sample", "part", "line", "dx", "dy", "dz", *numbers, "vx", "vy"), *numbers, digits=5)
    return rounded(out, "vx", "vy", digits=8)
