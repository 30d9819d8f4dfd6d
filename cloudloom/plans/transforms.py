"""Queries of transforms, crops, curves, label tables and instance operators."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from cloudloom.functions.random import draw_sql
from cloudloom.functions.tables import new_folder
from cloudloom.operators import augment, cloud, cluster, curves, evaluate, fuse, grid, losses, scalar
from cloudloom.operators import neighbors as nb
from cloudloom.plans import pipeline, series
from cloudloom.plans.catalog import query
from cloudloom.plans.frames import hilbert_sql
from cloudloom.plans.evaluation import PROBS, RATES, cm, probs
from cloudloom.plans.geometry import rounded
from cloudloom.plans.labels import FACES, faces
from cloudloom.plans.matching import BALL, D2, farthest_sql
from cloudloom.plans.meshes import coloured
from cloudloom.plans.series import PR
from cloudloom.sources import formats, io
from cloudloom.sources.fixtures import metrics, points, read
from cloudloom.streaming import stateful


def normal_sql(seed: int, *keys: str) -> str:
    return f"(sqrt(-2 * ln(1 - {draw_sql(seed, *keys)})) * cos(2 * pi() * {draw_sql(seed + 1000, *keys)}))"


def voxels(spark, d):
    """Points with the integer places of their coordinates."""
    return points(spark, d).withColumns({f"c{a}": F.col(a).cast("bigint") for a in "xyz"})


# ---------------------------------------------------------------- label tables


@query("p10_inverse_remap", "SELECT cloud_id, point_id, CASE label WHEN 0 THEN 10 WHEN 1 THEN 11 WHEN 2 THEN 13 WHEN 3 THEN 18 ELSE -1 END AS label FROM pts")
def _(spark, d):
    table = spark.createDataFrame([(10, 0, False), (252, 0, False), (16, 1, False), (11, 1, True), (15, 2, False), (13, 2, False), (18, 3, False)], "raw int, label int, canonical boolean")
    return fuse.inverse_remap(points(spark, d), "label", table, -1).select("cloud_id", "point_id", "label")


@query("p15_tuple_match", "SELECT cloud_id, point_id, CASE WHEN y = 3 AND z = 4 THEN 7 WHEN y = 0 AND z = 0 THEN 1 ELSE -1 END AS semantic FROM pts")
def _(spark, d):
    table = spark.createDataFrame([(3.0, 4.0, 7), (0.0, 0.0, 1), (3.0, 4.0, 7)], "y double, z double, class int")
    return fuse.match_tuples(points(spark, d), ["y", "z"], table, "semantic").select("cloud_id", "point_id", "semantic")


@query("p16_colour_hex", "WITH c AS (SELECT cloud_id, point_id, (x*5)::bigint AS r, (y*25)::bigint AS g, (z*30)::bigint AS b FROM pts) SELECT cloud_id, point_id, (dense_rank() OVER (PARTITION BY cloud_id ORDER BY r, g, b) - 1)::int AS instance, CASE WHEN r = 50 AND g = 75 AND b = 0 THEN 4 WHEN r = 100 AND g = 250 AND b = 240 THEN 9 ELSE -1 END AS segment FROM c")
def _(spark, d):
    mapping = spark.createDataFrame([("324B00", "trashcan"), ("64faf0", "fridge"), ("FFFFFF", "unknown")], "hex string, category string")
    classes = spark.createDataFrame([("trash can", 4), ("refrigerator", 9)], "category string, class int")
    return fuse.colour_instances(coloured(spark, d), mapping, classes).select("cloud_id", "point_id", "instance", "segment")


#: Names that the ids are expected to have, with two planted faults: a wrong name and an id that isn't there.
_EXPECTED = {k: f"NATION_{k}" for k in range(25)} | {5: "ATLANTIS", 99: "NOWHERE"}


@query("p19_check_ids", f"SELECT e.fine, e.expected, n_name AS found FROM (VALUES {', '.join(map(str, _EXPECTED.items()))}) e(fine, expected) LEFT JOIN nation ON n_nationkey = e.fine WHERE n_name IS DISTINCT FROM e.expected")
def _(spark, d):
    return fuse.check_ids(read(spark, d, "nation").select(F.col("n_nationkey").alias("fine"), F.col("n_name").alias("name")), _EXPECTED)


@query("j27_missing_inputs", "WITH s AS (SELECT s_suppkey::bigint AS cloud_id, CASE WHEN s_suppkey % 3 = 0 THEN 'val' ELSE 'train' END AS split FROM supplier), a AS (SELECT DISTINCT cloud_id FROM pts WHERE rib = 7 AND label = 3), b AS (SELECT DISTINCT cloud_id FROM pts WHERE rib_pred = 9 AND z > 7), m AS (SELECT split, s.cloud_id, concat_ws(',', CASE WHEN a.cloud_id IS NULL THEN 'first' END, CASE WHEN b.cloud_id IS NULL THEN 'second' END) AS missing FROM s LEFT JOIN a ON a.cloud_id = s.cloud_id LEFT JOIN b ON b.cloud_id = s.cloud_id) SELECT * FROM m WHERE missing <> ''")
def _(spark, d):
    p = points(spark, d)
    splits = read(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("cloud_id"), F.when(F.col("s_suppkey") % 3 == 0, "val").otherwise("train").alias("split"))
    return fuse.missing_inputs(splits, {"first": p.where("rib = 7 and label = 3"), "second": p.where("rib_pred = 9 and z > 7")})


# ---------------------------------------------------------------- row-wise


@query("p25_p42_p39_colours", f"SELECT cloud_id, point_id, round(x*5*(CASE WHEN {draw_sql(42, 'cloud_id')} < 0.4 THEN 0.5 ELSE 1 END)/255, 6) AS r, round(least(greatest(y*25 + least(greatest(12.75 * {normal_sql(39, 'cloud_id', 'point_id')}, -255), 255), 0), 255), 4) AS g FROM pts")
def _(spark, d):
    df = augment.jitter(coloured(spark, d), {"g": 39}, 12.75, 255.0).withColumn("g", F.least(F.greatest("g", F.lit(0.0)), F.lit(255.0)))
    df = scalar.normalise_colour(augment.colour_drop(df, 0.4, 0.5, 42, ["r"]), ["r"])
    return rounded(rounded(df.select("cloud_id", "point_id", "r", "g"), "r"), "g", digits=4)


@query("p23_stored_stats", "WITH s AS (SELECT cloud_id, min(intensity) AS lo, max(intensity) AS hi, avg(intensity) AS m, stddev_pop(intensity) AS sd FROM pts GROUP BY 1) SELECT p.cloud_id, point_id, round((least(greatest(intensity, lo), hi) - m)/greatest(sd, 1e-6), 6) + 0.0 AS intensity FROM pts p JOIN s ON s.cloud_id = p.cloud_id")
def _(spark, d):
    p = points(spark, d)
    stored = p.groupBy("cloud_id").agg(F.min("intensity").alias("p_low"), F.max("intensity").alias("p_high"), F.avg("intensity").alias("mean"), F.stddev_pop("intensity").alias("std"))
    return rounded(cloud.normalise_intensity(p, stats=stored).select("cloud_id", "point_id", "intensity"), "intensity")


@query("p27_reorient_points", "SELECT cloud_id, point_id, min(y) OVER w + max(y) OVER w - y AS a, x AS b, min(z) OVER w + max(z) OVER w - z AS c FROM pts WINDOW w AS (PARTITION BY cloud_id)")
def _(spark, d):
    return scalar.reorient_points(points(spark, d), "RAS", "PRI").select("cloud_id", "point_id", F.col("x").alias("a"), F.col("y").alias("b"), F.col("z").alias("c"))


@query("p38_p45_noise", f"SELECT cloud_id, point_id, round(x + 0.02 * least(greatest({normal_sql(5, 'cloud_id', 'point_id')}/1.96, -1), 1), 6) AS x, round(intensity + CASE WHEN {draw_sql(44, 'cloud_id')} < 0.5 THEN 10 * {normal_sql(45, 'cloud_id', 'point_id')} ELSE 0 END, 4) AS intensity FROM pts")
def _(spark, d):
    p = augment.clip_jitter(points(spark, d), {"x": 5}, 0.02)
    return rounded(rounded(augment.density_noise(p, 10.0, 0.5, 44).select("cloud_id", "point_id", "x", "intensity"), "x"), "intensity", digits=4)


@query("p33_target_angle", f"WITH c AS (SELECT *, (min(x) OVER w + max(x) OVER w)/2 AS mx, (min(y) OVER w + max(y) OVER w)/2 AS my, CASE WHEN {draw_sql(33, 'cloud_id')} <= 0.75 THEN ([0.5, 1.0, 1.5])[floor({draw_sql(34, 'cloud_id')} * 3)::int + 1] * pi() ELSE 0 END AS a FROM pts WINDOW w AS (PARTITION BY cloud_id)) SELECT cloud_id, point_id, round((x-mx)*cos(a) - (y-my)*sin(a) + mx, 6) + 0.0 AS x, round((x-mx)*sin(a) + (y-my)*cos(a) + my, 6) + 0.0 AS y FROM c")
def _(spark, d):
    out = rounded(augment.rotate_target(points(spark, d), "z", (0.5, 1.0, 1.5), 0.75, 33).select("cloud_id", "point_id", "x", "y"), "x", "y")
    return out.withColumns({a: F.col(a) + 0.0 for a in "xy"})


@query("p34_align_rooms", "WITH c AS (SELECT *, (min(x) OVER w + max(x) OVER w)/2 AS mx, (min(y) OVER w + max(y) OVER w)/2 AS my, (2 - (cloud_id * 7 % 360)/180) * pi() AS a FROM pts WINDOW w AS (PARTITION BY cloud_id)) SELECT cloud_id, point_id, round((x-mx)*cos(a) - (y-my)*sin(a) + mx, 6) + 0.0 AS x, round((x-mx)*sin(a) + (y-my)*cos(a) + my, 6) + 0.0 AS y FROM c")
def _(spark, d):
    rooms = read(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("cloud_id"), (F.col("s_suppkey") * 7 % 360).alias("angle"))
    out = rounded(augment.align_rooms(points(spark, d), rooms).select("cloud_id", "point_id", "x", "y"), "x", "y")
    return out.withColumns({a: F.col(a) + 0.0 for a in "xy"})


@query("p52_panorama", "SELECT cloud_id, point_id, round(z*cos((0.5-y/11)*pi())*sin((x/51-0.5)*2*pi()), 6) + 0.0 AS a, round(z*sin((0.5-y/11)*pi()), 6) + 0.0 AS b, round(z*cos((0.5-y/11)*pi())*cos((x/51-0.5)*2*pi()), 6) + 0.0 AS c FROM pts")
def _(spark, d):
    at = scalar.panorama_point(F.col("x"), F.col("y"), F.col("z"), 51.0, 11.0)
    out = rounded(points(spark, d).select("cloud_id", "point_id", *[v.alias(n) for v, n in zip(at, "abc")]), "a", "b", "c")
    return out.withColumns({c: F.col(c) + 0.0 for c in "abc"})


@query("p64_gaussian", "SELECT cloud_id, point_id, round(2 * exp(-(x*x+y*y+z*z)/(2*400.0)), 8) AS g FROM pts")
def _(spark, d):
    d2 = F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2
    return rounded(points(spark, d).select("cloud_id", "point_id", scalar.gaussian_kernel(d2, 2.0, 20.0).alias("g")), "g", digits=8)


# ---------------------------------------------------------------- curves


@query("p60_hilbert_decode", "SELECT cloud_id, point_id, x::bigint AS i, y::bigint AS j, z::bigint AS k FROM pts")
def _(spark, d):
    v = voxels(spark, d).withColumn("code", curves.hilbert(F.col("cx"), F.col("cy"), F.col("cz"), 8))
    return v.withColumn("p", curves.hilbert_decode(F.col("code"), 8)).select("cloud_id", "point_id", "p.i", "p.j", "p.k")


@query("p60_hilbert_code", f"WITH {hilbert_sql('x', 'y', 'z', 8)} SELECT cloud_id, point_id, code::bigint AS code FROM hc")
def _(spark, d):
    return voxels(spark, d).select("cloud_id", "point_id", curves.hilbert(F.col("cx"), F.col("cy"), F.col("cz"), 8).alias("code"))


_MORTON = lambda a, b, c: " + ".join(f"((({a}::bigint >> {k}) & 1) << {3 * k + 2}) + ((({b}::bigint >> {k}) & 1) << {3 * k + 1}) + ((({c}::bigint >> {k}) & 1) << {3 * k})" for k in range(8))


@query("g17_k1_transposed_orders", f"WITH {hilbert_sql('y', 'x', 'z', 8)}, m AS (SELECT cloud_id, point_id, {_MORTON('y', 'x', 'z')} AS zt FROM pts) SELECT m.cloud_id, m.point_id, (row_number() OVER (PARTITION BY m.cloud_id ORDER BY zt, m.point_id) - 1)::int AS ord_z_trans, (row_number() OVER (PARTITION BY m.cloud_id ORDER BY code, m.point_id) - 1)::int AS ord_hilbert_trans FROM m JOIN hc ON hc.cloud_id = m.cloud_id AND hc.point_id = m.point_id")
def _(spark, d):
    return curves.serial_orders(voxels(spark, d), ["z-trans", "hilbert-trans"], bits=8).select("cloud_id", "point_id", "ord_z_trans", "ord_hilbert_trans")


# ---------------------------------------------------------------- crops and distortion


def _views_sql(seed: int, n_global: int, n_local: int) -> str:
    """The crops one after the other: a centre, distances and ranks in each step."""
    steps = ["v_ AS (SELECT cloud_id, point_id, x, y, z, count(*) OVER w AS n, z BETWEEN min(z) OVER w + (max(z) OVER w - min(z) OVER w) * 0.2 AND min(z) OVER w + (max(z) OVER w - min(z) OVER w) * 0.8 AS band, true AS op FROM pts WINDOW w AS (PARTITION BY cloud_id))"]
    last = "v_"
    for v in range(n_global + n_local):
        among = "band" if v == 0 else "r0 IS NOT NULL" if v < n_global else "op"
        lo, hi = (0.4, 1.0) if v < n_global else (0.1, 0.4)
        if v == n_global:
            steps.append(f"o{v} AS (SELECT * EXCLUDE (op), r0 IS NOT NULL AS op FROM {last})")
            last = f"o{v}"
        if v > n_global:
            steps.append(f"o{v} AS (SELECT * EXCLUDE (op), CASE WHEN bool_or(op) OVER (PARTITION BY cloud_id) THEN op ELSE r0 IS NOT NULL END AS op FROM {last})")
            last = f"o{v}"
        steps.append(f"c{v} AS (SELECT cloud_id, arg_min(x, (dr, point_id)) AS ox, arg_min(y, (dr, point_id)) AS oy, arg_min(z, (dr, point_id)) AS oz FROM (SELECT *, {draw_sql(seed + v, 'cloud_id', 'point_id')} AS dr FROM {last}) WHERE {among} GROUP BY 1)")
        steps.append(f"k{v} AS (SELECT l.*, row_number() OVER (PARTITION BY l.cloud_id ORDER BY (x-ox)*(x-ox)+(y-oy)*(y-oy)+(z-oz)*(z-oz), point_id) AS rk, floor(({lo}::double + {draw_sql(seed + 100 + v, 'l.cloud_id')} * ({hi}::double - {lo}::double)) * least(n, 65536)) AS sz FROM {last} l JOIN c{v} ON c{v}.cloud_id = l.cloud_id)")
        steps.append(f"v{v} AS (SELECT * EXCLUDE (rk, sz{', op' if v >= n_global else ''}), CASE WHEN rk <= sz THEN rk END AS r{v}{', op AND NOT (rk <= sz) AS op' if v >= n_global else ''} FROM k{v})")
        last = f"v{v}"
    return ", ".join(steps), last


_VIEWS, _LAST = _views_sql(60, 2, 3)


@query("r21_views", f"WITH {_VIEWS} " + " UNION ALL ".join(f"SELECT cloud_id, {v} AS view, '{'global' if v < 2 else 'local'}' AS kind, point_id, r{v}::int AS rank FROM {_LAST} WHERE r{v} IS NOT NULL" for v in range(5)))
def _(spark, d):
    return augment.views(points(spark, d), 60, 2, (0.4, 1.0), 3, (0.1, 0.4), height=(0.2, 0.8))




@query("r29_elastic", f"""WITH u AS (SELECT *, (x - min(x) OVER w)/4 + 1 AS ux, (y - min(y) OVER w)/4 + 1 AS uy, (z - min(z) OVER w)/4 + 1 AS uz, floor((max(x) OVER w - min(x) OVER w)/4)::bigint + 3 AS dx, floor((max(y) OVER w - min(y) OVER w)/4)::bigint + 3 AS dy, floor((max(z) OVER w - min(z) OVER w)/4)::bigint + 3 AS dz FROM pts WINDOW w AS (PARTITION BY cloud_id)),
 a AS (SELECT cloud_id, point_id, dx, dy, dz, floor(ux)::bigint + i AS nx, floor(uy)::bigint + j AS ny, floor(uz)::bigint + k AS nz, abs(1 - i - (ux - floor(ux))) * abs(1 - j - (uy - floor(uy))) * abs(1 - k - (uz - floor(uz))) AS wt FROM u, range(2) t1(i), range(2) t2(j), range(2) t3(k)), nd AS (SELECT DISTINCT cloud_id, nx, ny, nz, dx, dy, dz FROM a),
 sr AS (SELECT cloud_id, nx, ny, nz, sx, sy, sz, {' * '.join(f'(least(n{c}+1, s{c}+1, d{c}-1) - greatest(n{c}-1, s{c}-1, 0) + 1)/9.0::double' for c in 'xyz')} AS wt FROM (SELECT *, nx + i AS sx, ny + j AS sy, nz + k AS sz FROM nd, range(-2, 3) t1(i), range(-2, 3) t2(j), range(-2, 3) t3(k)) WHERE sx BETWEEN 0 AND dx-1 AND sy BETWEEN 0 AND dy-1 AND sz BETWEEN 0 AND dz-1),
 f AS (SELECT cloud_id, nx, ny, nz, {', '.join(f'sum(wt * {normal_sql(70 + k, "cloud_id", "sx", "sy", "sz")}) AS f{c}' for k, c in enumerate('xyz'))} FROM sr GROUP BY 1, 2, 3, 4), m AS (SELECT a.cloud_id, point_id, sum(wt * fx) AS mx, sum(wt * fy) AS my, sum(wt * fz) AS mz FROM a JOIN f ON f.cloud_id = a.cloud_id AND f.nx = a.nx AND f.ny = a.ny AND f.nz = a.nz GROUP BY 1, 2)
 SELECT p.cloud_id, p.point_id, round(x + mx * 8, 5) AS x, round(y + my * 8, 5) AS y, round(z + mz * 8, 5) AS z FROM pts p JOIN m ON m.cloud_id = p.cloud_id AND m.point_id = p.point_id""")
def _(spark, d):
    return rounded(augment.elastic(points(spark, d).select("cloud_id", "point_id", "x", "y", "z"), 4.0, 8.0, 70).select("cloud_id", "point_id", "x", "y", "z"), "x", "y", "z", digits=5)


def elastic_sql(source: str, granularity: float, magnitude: float, seed: int, n: int, gate: str = "true") -> str:
    """Common tables up to el{n}: source's cloud_id, point_id, x, y, z after a distortion; a cloud outside the gate stays."""
    t = lambda name: f"{name}{n}"
    size = lambda c: f"floor((max({c}) OVER w - min({c}) OVER w)/{granularity})::bigint + 3 AS d{c}"
    share = " * ".join(f"abs(1 - {k} - (u{c} - floor(u{c})))" for c, k in zip("xyz", "ijk"))
    near = " * ".join(f"(least(n{c}+1, s{c}+1, d{c}-1) - greatest(n{c}-1, s{c}-1, 0) + 1)/9.0::double" for c in "xyz")
    field = ", ".join(f"sum(wt * {normal_sql(seed + k, 'cloud_id', 'sx', 'sy', 'sz')}) AS f{c}" for k, c in enumerate("xyz"))
    return f"""{t("u")} AS (SELECT *, {", ".join(f"({c} - min({c}) OVER w)/{granularity} + 1 AS u{c}, {size(c)}" for c in "xyz")} FROM {source} WINDOW w AS (PARTITION BY cloud_id)),
 {t("a")} AS (SELECT cloud_id, point_id, dx, dy, dz, {", ".join(f"floor(u{c})::bigint + {k} AS n{c}" for c, k in zip("xyz", "ijk"))}, {share} AS wt FROM {t("u")}, range(2) t1(i), range(2) t2(j), range(2) t3(k) WHERE {gate}),
 {t("nd")} AS (SELECT DISTINCT cloud_id, nx, ny, nz, dx, dy, dz FROM {t("a")}),
 {t("sr")} AS (SELECT cloud_id, nx, ny, nz, sx, sy, sz, {near} AS wt FROM (SELECT *, nx + i AS sx, ny + j AS sy, nz + k AS sz FROM {t("nd")}, range(-2, 3) t1(i), range(-2, 3) t2(j), range(-2, 3) t3(k)) WHERE {" AND ".join(f"s{c} BETWEEN 0 AND d{c}-1" for c in "xyz")}),
 {t("f")} AS (SELECT cloud_id, nx, ny, nz, {field} FROM {t("sr")} GROUP BY 1, 2, 3, 4),
 {t("m")} AS (SELECT a.cloud_id, point_id, {", ".join(f"sum(wt * f{c}) AS m{c}" for c in "xyz")} FROM {t("a")} a JOIN {t("f")} f ON f.cloud_id = a.cloud_id AND f.nx = a.nx AND f.ny = a.ny AND f.nz = a.nz GROUP BY 1, 2),
 {t("el")} AS (SELECT p.cloud_id, p.point_id, {", ".join(f"{c} + coalesce(m{c}, 0) * {magnitude} AS {c}" for c in "xyz")} FROM {source} p LEFT JOIN {t("m")} m ON m.cloud_id = p.cloud_id AND m.point_id = p.point_id)"""


@query("r29_elastic_rounds", f"WITH {elastic_sql('pts', 4.0, 2.0, 292, 0, draw_sql(291, 'cloud_id') + ' < 0.6')}, {elastic_sql('el0', 16.0, 6.0, 295, 1, draw_sql(291, 'cloud_id') + ' < 0.6')} SELECT cloud_id, point_id, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in 'xyz')} FROM el1")
def _(spark, d):
    return rounded(augment.elastic_rounds(points(spark, d).select("cloud_id", "point_id", "x", "y", "z"), ((4.0, 2.0), (16.0, 6.0)), 0.6, 291).select("cloud_id", "point_id", "x", "y", "z"), "x", "y", "z", digits=5)


@query("u5_protected", "WITH c AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, floor(x/8), floor(y/8), floor(z/8) ORDER BY point_id) AS r FROM pts) SELECT cloud_id, point_id FROM c WHERE r = 1 OR rib = 5")
def _(spark, d):
    return grid.representatives(grid.cells(points(spark, d), 8.0), protected=F.col("rib") == 5).select("cloud_id", "point_id")


@query("x7_fragments", "WITH c AS (SELECT *, row_number() OVER w2 - 1 AS r, count(*) OVER (PARTITION BY cloud_id, floor(x/16), floor(y/16), floor(z/16)) AS n FROM pts WINDOW w2 AS (PARTITION BY cloud_id, floor(x/16), floor(y/16), floor(z/16) ORDER BY point_id)), m AS (SELECT *, max(n) OVER (PARTITION BY cloud_id) AS mx FROM c) SELECT cloud_id, f::int AS fragment, count(*) AS n, round(sum(x) * 2, 6) AS total FROM m, range(100000) t(f) WHERE f < mx AND f % n = r GROUP BY 1, 2")
def _(spark, d):
    out = pipeline.fragment(points(spark, d), 16.0, [{"type": "scale", "factor": 2.0}])
    return rounded(out.groupBy("cloud_id", "fragment").agg(F.count("*").alias("n"), F.sum("x").alias("total")), "total")


# ---------------------------------------------------------------- neighbours


@query("j4_random_ball", f"WITH {BALL}, r AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, src ORDER BY {draw_sql(4, 'cloud_id', 'src', 'dst')}, dst) AS rank FROM ba) SELECT cloud_id, src, dst, rank::int AS rank FROM r WHERE rank <= 3")
def _(spark, d):
    p = points(spark, d)
    return nb.random_ball_query(p, p, 3, 1.5, 4).select("cloud_id", "src", "dst", "rank")


@query("j7_view_pairs", f"WITH q AS (SELECT * FROM pts WHERE point_id % 2 = 0), t AS (SELECT * FROM pts WHERE point_id % 2 = 1), k AS (SELECT a.cloud_id, a.point_id AS src, b.point_id AS dst, {D2} AS d2, row_number() OVER (PARTITION BY a.cloud_id, a.point_id ORDER BY {D2}, b.point_id) AS rk FROM q a JOIN t b ON a.cloud_id = b.cloud_id), o AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, src ORDER BY {draw_sql(7, 'cloud_id', 'src', 'dst')}, dst) AS r FROM k WHERE rk <= 5 AND d2 <= 9), c AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY {draw_sql(8, 'cloud_id', 'src')}, src) AS c FROM o WHERE r = 1) SELECT cloud_id, src, dst FROM c WHERE c <= 50")
def _(spark, d):
    p = points(spark, d)
    return nb.pick_pairs(nb.knn(p.where("point_id % 2 = 0"), p.where("point_id % 2 = 1"), 5), 3.0, 50, 7).select("cloud_id", "src", "dst")


@query("j11_ball_group", f"WITH {BALL}, r AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, src ORDER BY {draw_sql(4, 'cloud_id', 'src', 'dst')}, dst) AS rank FROM ba) SELECT r.cloud_id, src, dst, b.x - a.x AS dx, b.intensity AS intensity FROM r JOIN pts a ON a.cloud_id = r.cloud_id AND a.point_id = src JOIN pts b ON b.cloud_id = r.cloud_id AND b.point_id = dst WHERE rank <= 3")
def _(spark, d):
    p = points(spark, d)
    return nb.ball_group(p, p, 3, 1.5, 4, ["intensity"]).select("cloud_id", "src", "dst", "dx", "intensity")


@query("j18_edge_features", "WITH e AS (SELECT vec_id % 10 AS cloud_id, vec_id AS v, embedding::double[] AS f FROM embeddings), k AS (SELECT a.cloud_id, a.v AS src, b.v AS dst, a.f AS af, b.f AS bf, row_number() OVER (PARTITION BY a.v ORDER BY round(list_sum(list_transform(list_zip(a.f, b.f), lambda p: (p[1]-p[2])*(p[1]-p[2]))), 9), b.v) AS rank FROM e a JOIN e b ON a.cloud_id = b.cloud_id) SELECT cloud_id, src, dst, round(list_sum(bf) - list_sum(af), 4) + 0.0 AS moved, round(af[1], 6) + 0.0 AS own FROM k WHERE rank <= 3")
def _(spark, d):
    e = read(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("cloud_id"), F.col("vec_id").alias("point_id"), F.transform("embedding", lambda v: v.cast("double")).alias("feat"))
    out = nb.edge_features(nb.feature_knn(e, 3), e)
    half = (F.size("edge") / 2).cast("int")
    moved = F.aggregate(F.slice("edge", F.lit(1), half), F.lit(0.0), lambda acc, v: acc + v)
    out = rounded(rounded(out.select("cloud_id", "src", "dst", moved.alias("moved"), F.element_at("edge", half + 1).alias("own")), "moved", digits=4), "own")
    return out.withColumns({c: F.col(c) + 0.0 for c in ("moved", "own")})


_NEAR = f"{farthest_sql(6)}, kn AS (SELECT fp.cloud_id, fp.rank AS patch, a.point_id AS src, b.point_id AS dst, row_number() OVER (PARTITION BY a.cloud_id, a.point_id ORDER BY {D2}, b.point_id) AS rank FROM fp JOIN pts a ON a.cloud_id = fp.cloud_id AND a.point_id = fp.point_id JOIN pts b ON a.cloud_id = b.cloud_id)"


@query("g12_pool_down", f"WITH {_NEAR} SELECT kn.cloud_id, src AS point_id, patch AS rank, round(max(intensity), 6) AS intensity FROM kn JOIN pts p ON p.cloud_id = kn.cloud_id AND p.point_id = dst WHERE kn.rank <= 8 GROUP BY 1, 2, 3")
def _(spark, d):
    return rounded(nb.pool_down(points(spark, d), 6, 8, ["intensity"]).select("cloud_id", "point_id", "rank", "intensity"), "intensity")


@query("j17_anchor_patches", f"WITH {_NEAR} SELECT kn.cloud_id, patch, dst AS point_id, kn.rank::int AS rank FROM kn JOIN pts p ON p.cloud_id = kn.cloud_id AND p.point_id = dst WHERE kn.rank <= 8")
def _(spark, d):
    return nb.anchor_patches(points(spark, d), 6, 8)


# ---------------------------------------------------------------- instances


@query("c3_shifted_centres", "SELECT cloud_id, point_id, (x + y)/4 AS x, (y + z)/4 AS y, (z + x)/4 AS z FROM pts")
def _(spark, d):
    return cluster.shifted_centres(points(spark, d).selectExpr("*", "y bx", "z by", "x bz"), ["bx", "by", "bz"], 4.0).select("cloud_id", "point_id", "x", "y", "z")


@query("c4_c10_graph_segments")
def _(spark, d):
    p = points(spark, d)
    e = nb.radius_edges(p, p, 1.5, include_self=False, carry=["intensity"]).where("src < dst")
    edges = e.select("cloud_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.abs(F.col("src_intensity") - F.col("dst_intensity")).alias("weight"))
    return cluster.attach_segments(p, cluster.segment_graph(edges, 200.0, 3)).select("cloud_id", "point_id", "segment")


@query("c7_matching")
def _(spark, d):
    p = points(spark, d).where("instance >= 0 and label > 0")
    pairs = p.groupBy("cloud_id", F.col("instance").cast("bigint").alias("guess"), F.col("label").cast("bigint").alias("truth")).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    costs = cluster.matching_costs(pairs, [(1.0, -F.col("n")), (0.5, F.abs(F.col("mx") - 25)), (0.1, F.col("my"))])
    return cluster.assignment(costs, "guess", "truth", "cost")


@query("x4_cluster_statistic", "SELECT cloud_id, instance AS cluster, count(*) AS n, round(max(intensity) - min(intensity), 6) AS score FROM pts WHERE instance >= 0 GROUP BY 1, 2")
def _(spark, d):
    p = points(spark, d).where("instance >= 0").withColumn("cluster", F.col("instance"))
    return rounded(cluster.cluster_statistic(p, F.max("intensity") - F.min("intensity"), "score"), "score")


@query("k2_by_score", "WITH i AS (SELECT cloud_id, instance, avg(intensity) AS score FROM pts WHERE instance >= 0 GROUP BY 1, 2) SELECT cloud_id, instance, round(score, 6) AS score, row_number() OVER (PARTITION BY cloud_id ORDER BY round(score, 6) DESC, instance)::int AS rank FROM i")
def _(spark, d):
    i = points(spark, d).where("instance >= 0").groupBy("cloud_id", "instance").agg(F.round(F.avg("intensity"), 6).alias("score"))
    return cluster.by_score(i, "score", "instance").select("cloud_id", "instance", "score", "rank")


# ---------------------------------------------------------------- evaluation and losses


@query("x5_selected_metrics", f"WITH {RATES} SELECT cloud_id, class, CASE WHEN class <> 0 THEN round(tp/nullif(tp+fp+fn,0), 6) END AS iou, CASE WHEN class <> 0 THEN round(tn/nullif(tn+fp,0), 6) END AS specificity FROM r")
def _(spark, d):
    return rounded(pipeline.selected_metrics(evaluate.rates(cm(spark, d), 5), ["IoU", "specificity"], [0]).select("cloud_id", "class", "iou", "specificity"), "iou", "specificity")


@query("e28_vote_copies", f"WITH {PROBS}, s AS (SELECT cloud_id, class, round(sum(p), 6) AS p FROM pr GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY p DESC, class) AS rk FROM s) SELECT cloud_id, class AS pred, p AS score FROM k WHERE rk = 1")
def _(spark, d):
    sums = probs(spark, d).groupBy("cloud_id", "class", "fragment").agg(F.sum("p").alias("p"))  # a cloud's class scores in each copy
    per = sums.groupBy("cloud_id", "class").agg(F.round(F.sum("p"), 6).alias("p"))
    return evaluate.vote(per, ["cloud_id"])


@query("e30_relabelled", "WITH n AS (SELECT label, label % 5 AS pred, count(*) AS n FROM embeddings GROUP BY 1, 2), s AS (SELECT c, sum(n) FILTER (label = c AND pred = c) AS tp, sum(n) FILTER (label = c) AS t, sum(n) FILTER (pred = c) AS g FROM n, (SELECT label AS c FROM n UNION SELECT pred FROM n) GROUP BY 1) SELECT round(sum(coalesce(tp, 0))/sum(coalesce(t, 0)), 6) AS acc, round(avg(coalesce(tp/nullif(g, 0), 0)), 6) AS precision, round(avg(coalesce(tp/nullif(t, 0), 0)), 6) AS recall, round(avg(coalesce(2*tp/nullif(coalesce(t, 0)+coalesce(g, 0), 0), 0)), 6) AS f1 FROM s")
def _(spark, d):
    e = read(spark, d, "embeddings").select("label", (F.col("label") + 100).alias("cluster"))
    mapping = e.select("cluster", (F.col("label") % 5).alias("label")).distinct()
    return rounded(evaluate.relabelled_scores(e, mapping, "cluster", "label"), "acc", "precision", "recall", "f1")


_PAIRS = f"WITH {BALL}, p AS (SELECT ba.cloud_id, src AS anchor, a.label AS class, a.label = b.label AS positive, -abs(a.intensity - b.intensity)/100 AS s FROM ba JOIN pts a ON a.cloud_id = ba.cloud_id AND a.point_id = src JOIN pts b ON b.cloud_id = ba.cloud_id AND b.point_id = dst WHERE src <> dst), k AS (SELECT cloud_id, anchor, class, sum(CASE WHEN positive THEN exp(s/0.5) ELSE 0 END) AS pp, sum(exp(s/0.5)) AS al FROM p GROUP BY 1, 2, 3)"


def contrast_pairs(spark, d):
    """Every point as an anchor with its neighbours; those of its class are its positives."""
    p = points(spark, d)
    e = nb.radius_edges(p, p, 1.5, include_self=False, carry=["label", "intensity"])
    return e.select("cloud_id", F.col("src").alias("anchor"), F.col("src_label").alias("class"), (F.col("src_label") == F.col("dst_label")).alias("positive"), (-F.abs(F.col("src_intensity") - F.col("dst_intensity")) / 100).alias("s"))


@query("l8_info_nce", f"{_PAIRS} SELECT cloud_id, round(avg(-ln(pp/al)), 5) AS loss FROM k WHERE pp > 0 GROUP BY 1")
def _(spark, d):
    return rounded(losses.info_nce(contrast_pairs(spark, d), "s", 0.5, ["cloud_id", "anchor"]), "loss", digits=5)


@query("l9_instance_info_nce", f"{_PAIRS}, c AS (SELECT cloud_id, class, avg(-ln(pp/al)) AS l FROM k WHERE pp > 0 GROUP BY 1, 2), g AS (SELECT cloud_id, avg(l) AS l FROM c GROUP BY 1) SELECT round(avg(l), 5) AS loss FROM g")
def _(spark, d):
    return rounded(losses.instance_info_nce(contrast_pairs(spark, d), "s", 0.5, ["cloud_id", "anchor"], "class"), "loss", digits=5)


@query("l2_smoothed", f"WITH {PR}, k AS (SELECT cloud_id, point_id, sum(-(CASE WHEN class = label THEN 0.9 ELSE 0.1/4 END)*ln(p)) AS l FROM pr GROUP BY 1, 2) SELECT cloud_id, round(avg(l), 6) AS loss FROM k GROUP BY 1")
def _(spark, d):
    return rounded(losses.smoothed_cross_entropy(series.probs(spark, d)), "loss")


# ---------------------------------------------------------------- sources and sinks, through files written from the tables


def _filed(spark, d, columns: dict[str, str] | None = None):
    """The points as clouds of files: named, numbered from 0, with some columns renamed."""
    rows = points(spark, d).withColumns({"cloud": F.concat(F.lit("s"), "cloud_id"), "point_id": F.col("point_id") - 1, "label": F.col("label").cast("int"), "instance": F.col("instance").cast("int")})
    return rows.withColumns({k: F.expr(v) for k, v in (columns or {}).items()})


@query("s1_scene_arrays", "SELECT 's' || cloud_id AS cloud, point_id - 1 AS point_id, x, y, z, intensity::float::double AS intensity, label::int AS label, instance::int AS instance FROM pts")
def _(spark, d):
    path = new_folder(spark)
    formats.write_clouds(_filed(spark, d).select("cloud", "point_id", "x", "y", "z", "intensity", "label", "instance"), path, "cloud_npy", points_per_part="1000")
    return formats.read_clouds(spark, path, "cloud_npy").select("cloud", "point_id", "x", "y", "z", "intensity", "label", "instance")


@query("s2_npz_clouds", "SELECT 's' || cloud_id AS cloud, point_id - 1 AS point_id, x, y, z, intensity, rib::int AS label FROM pts")
def _(spark, d):
    path, keys = new_folder(spark), '{"semantic": "label", "hu": "intensity"}'
    formats.write_clouds(_filed(spark, d).select("cloud", "point_id", "x", "y", "z", "intensity", F.col("rib").alias("label")), path, "cloud_npz", keys=keys, points_per_part="1000")
    return formats.read_clouds(spark, path, "cloud_npz", keys=keys).select("cloud", "point_id", "x", "y", "z", "intensity", "label")


@query("s3_lidar_frames", "SELECT 's' || cloud_id AS cloud, point_id - 1 AS point_id, x, y, z, ((intensity * 255)::float::double / 255)::float AS intensity, label::int AS label, (instance + 1)::int AS instance FROM pts")
def _(spark, d):
    path, form = new_folder(spark), {"fields": "5", "strength_scale": "255"}
    rows = _filed(spark, d, {"instance": "instance + 1"}).select("cloud", "point_id", "x", "y", "z", "intensity", "label", "instance")
    formats.write_clouds(rows, path, "cloud_bin", **form, points_per_part="1000")
    return formats.read_clouds(spark, path, "cloud_bin", **form).select("cloud", "point_id", "x", "y", "z", F.col("intensity").cast("float").alias("intensity"), "label", "instance")


@query("s4_text_points", "SELECT 'room' || cloud_id AS cloud, CASE WHEN rib < 9 THEN 'chair' ELSE 'lamp' END AS class, dense_rank() OVER (PARTITION BY cloud_id ORDER BY CASE WHEN rib < 9 THEN 'chair_' ELSE 'lamp_' END || rib % 2) - 1 AS instance, x, y, z FROM pts")
def _(spark, d):
    path = new_folder(spark)
    named = points(spark, d).withColumn("cloud", F.expr("concat('room', cloud_id, '/', if(rib < 9, 'chair_', 'lamp_'), rib % 2)"))
    place = F.row_number().over(Window.partitionBy("cloud").orderBy("point_id")).cast("bigint") - 1
    formats.write_clouds(named.select("cloud", place.alias("point_id"), "x", "y", "z"), path, "cloud_txt")
    return io.text_points(spark, f"{path}/*/*.txt", ["x", "y", "z"]).select("cloud", "class", F.col("instance").cast("bigint").alias("instance"), "x", "y", "z")


@query("s5_mesh_tables", f"WITH {FACES} SELECT f.cloud_id, face_id, v0, v1, v2 FROM f JOIN pts a ON a.cloud_id = f.cloud_id AND a.point_id = v0 AND a.rib < 24 JOIN pts b ON b.cloud_id = f.cloud_id AND b.point_id = v1 AND b.rib < 24 JOIN pts c ON c.cloud_id = f.cloud_id AND c.point_id = v2 AND c.rib < 24")
def _(spark, d):
    return io.mesh_tables(points(spark, d).where("rib < 24").withColumnRenamed("point_id", "vertex_id"), faces(spark, d))[1]


@query("s19_s21_published", "SELECT cloud_id, point_id, pred::int AS pred, label::int AS label, x::bigint AS i, y::bigint AS j, z::bigint AS k FROM pts")
def _(spark, d):
    path = new_folder(spark)
    io.publish(points(spark, d).selectExpr("cloud_id", "point_id", "pred", "label", "cast(x as bigint) i", "cast(y as bigint) j", "cast(z as bigint) k"), path)
    return spark.read.parquet(path)


def _arriving(spark, source: str, schema, per_batch: int = 1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)


@query("t4_incremental_build", "SELECT cloud_id, count(*) AS n, sum(point_id)::bigint AS ids FROM pts GROUP BY 1")
def _(spark, d):
    source, target, done = new_folder(spark), new_folder(spark), new_folder(spark)
    p = points(spark, d).select("cloud_id", "point_id")
    build = lambda df: df.groupBy("cloud_id").agg(F.count("*").alias("n"), F.sum("point_id").alias("ids"))
    for part in ("cloud_id % 3 = 0", "cloud_id % 3 = 1 and point_id % 2 = 0", "cloud_id % 3 = 1 and point_id % 2 = 1 or cloud_id % 3 = 2"):  # a run for each; the last amends clouds of the one before
        p.where(part).write.mode("append").parquet(source)
        stateful.incremental_build(_arriving(spark, source, p.schema, 1000), build, target, done).awaitTermination()
    return stateful.newest(spark, target, "cloud_id bigint, n bigint, ids bigint", ["cloud_id"])


@query("t1_confusion_stream", "SELECT label::int AS label, pred::int AS pred, count(*)::bigint AS n FROM pts GROUP BY 1, 2")
def _(spark, d):
    source, target, done = new_folder(spark), new_folder(spark), new_folder(spark)
    counts = evaluate.confusion(points(spark, d)).select("cloud_id", F.col("label").cast("int").alias("label"), F.col("pred").cast("int").alias("pred"), "n", F.lit("2026-01-01").cast("timestamp").alias("ts"))
    for half in (0, 1):  # every cell of the second half arrives twice
        rows = counts.where(F.col("cloud_id") % 2 == half)
        (rows.unionByName(rows) if half else rows).coalesce(2).write.mode("append").parquet(source)
    stateful.running_totals(_arriving(spark, source, counts.schema), target, done).awaitTermination()
    return stateful.newest(spark, target, "label int, pred int, n bigint", ["label", "pred"])


@query("t2_t3_series_stream", """SELECT run, name, event_id, iter, round(avg(value) OVER w, 8) AS mean, round(median(value) OVER w, 8) AS median, greatest(value, coalesce(max(value) OVER b, value)) AS best, coalesce(value > max(value) OVER b, true) AS new_best
 FROM metrics WINDOW w AS (PARTITION BY run, name ORDER BY iter ROWS 19 PRECEDING), b AS (PARTITION BY run, name ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    source, target, done = new_folder(spark), new_folder(spark), new_folder(spark)
    rows = metrics(spark, d).select("run", "name", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first).total_seconds() / 4 + 1
    # four files in the order of time, but every third event comes up to a third of a file late; a closing mark lets the last rows through
    late = (F.unix_micros("ts") - F.unix_micros(F.lit(first))) / 1e6 + F.when(F.col("event_id") % 3 == 0, step / 3).otherwise(0)
    for k in range(4):
        rows.where(F.least(F.floor(late / step), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(source)
    rows.limit(1).withColumns({"run": F.lit(-1).cast("bigint"), "ts": F.lit(last + (last - first) * 2 + timedelta(days=1))}).coalesce(1).write.mode("append").parquet(source)
    smooth = stateful.series_stream(_arriving(spark, source, rows.schema), 20, f"{int(step / 2) + 1} seconds")
    stateful.start(smooth, target, done).awaitTermination()
    return rounded(stateful.all_batches(spark, target, stateful.SERIES).drop("batch"), "mean", "median", digits=8)
