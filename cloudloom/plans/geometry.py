"""Queries of row-wise operators, per-cloud aggregates and crops."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cloudloom.functions.random import draw_sql
from cloudloom.operators import cloud, scalar
from cloudloom.plans.catalog import query
from cloudloom.sources.fixtures import points

BOX = "min({0}) over (partition by cloud_id)", "max({0}) over (partition by cloud_id)"


def rounded(df, *columns, digits=6):
    """Round floats for comparison; adding 0.0 turns a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})


@query("p1_p2_p4_p5_features", "SELECT cloud_id, point_id, x AS x_copy, 7 AS tag, [x, y, z, intensity][2] AS f1, [x, y, z, intensity][4] AS f3 FROM pts")
def _(spark, d):
    df = scalar.set_constants(scalar.copy_columns(points(spark, d), {"x_copy": "x"}), {"tag": 7})
    picked = scalar.take_axes(scalar.features("x", "y", "z", "intensity"), [1, 3])
    return df.select("cloud_id", "point_id", "x_copy", "tag", picked[0].alias("f1"), picked[1].alias("f3"))


@query("p3_collect_counts", "SELECT cloud_id, count(*) AS n, sum(x + y + z) AS total FROM pts GROUP BY 1")
def _(spark, d):
    df = points(spark, d).withColumn("feat", scalar.features("x", "y", "z"))
    return df.groupBy("cloud_id").agg(F.count("*").alias("n"), F.sum(F.expr("feat[0] + feat[1] + feat[2]")).alias("total"))


@query("p6_p7_casts", "SELECT cloud_id, point_id, CAST(trunc(intensity) AS INTEGER) AS whole, CAST(trunc(-intensity) AS INTEGER) AS neg, [z][1] AS axis0 FROM pts")
def _(spark, d):
    return points(spark, d).select("cloud_id", "point_id", F.col("intensity").cast("int").alias("whole"), (-F.col("intensity")).cast("int").alias("neg"), scalar.features("z")[0].alias("axis0"))


@query("p8_binarise", "SELECT label, CASE WHEN label IN (1, 3) THEN 1 ELSE 0 END AS fg, count(*) AS n FROM pts GROUP BY 1, 2")
def _(spark, d):
    return points(spark, d).withColumn("fg", scalar.binarise("label", [1, 3])).groupBy("label", "fg").agg(F.count("*").alias("n"))


@query("p9_remap", "SELECT cloud_id, point_id, CASE rib WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 13 THEN 10 ELSE -1 END AS mapped, CASE label WHEN 0 THEN 2 WHEN 4 THEN 7 ELSE -1 END AS back FROM pts")
def _(spark, d):
    return points(spark, d).select("cloud_id", "point_id", scalar.remap("rib", {1: 10, 2: 20, 13: 10}).alias("mapped"), scalar.remap("label", {0: 2, 4: 7}).alias("back"))


@query("p22_p67_windows", "SELECT cloud_id, point_id, round((least(greatest(intensity, 100), 400) - 100) / 300, 9) AS w0, round((least(greatest(intensity, 0), 1000) - 0) / 1000, 9) AS w1, round((least(greatest(intensity, 200), 250) - 200) / 50, 9) AS w2 FROM pts")
def _(spark, d):
    df = points(spark, d).select("cloud_id", "point_id", *[scalar.window_intensity("intensity", a, b).alias(f"w{k}") for k, (a, b) in enumerate([(100, 400), (0, 1000), (200, 250)])])
    return rounded(df, "w0", "w1", "w2", digits=9)


@query("p24_clip", "SELECT cloud_id, point_id, least(greatest(x, 5), 40) AS x, least(greatest(y, 1), 8) AS y, least(greatest(z, 2), 6) AS z FROM pts")
def _(spark, d):
    return scalar.clip_points(points(spark, d), [5, 1, 2, 40, 8, 6]).select("cloud_id", "point_id", "x", "y", "z")


@query("p26_affine", "SELECT cloud_id, point_id, 2*x + 0.5*y + 10 AS px, -1.5*y + 3 AS py, x + 0.25*z - 7 AS pz FROM pts")
def _(spark, d):
    p = scalar.apply_affine("x", "y", "z", [2, 0.5, 0, 10, 0, -1.5, 0, 3, 1, 0, 0.25, -7, 0, 0, 0, 1])
    return points(spark, d).select("cloud_id", "point_id", *[c.alias(n) for c, n in zip(p, ("px", "py", "pz"))])


@query("p28_reorient", "SELECT cloud_id, point_id, CAST(10 - y AS BIGINT) AS i, CAST(x AS BIGINT) AS j, CAST(8 - z AS BIGINT) AS k FROM pts")
def _(spark, d):
    grid = points(spark, d).select("cloud_id", "point_id", *[F.col(a).cast("bigint").alias(b) for a, b in zip("xyz", "ijk")])
    return scalar.reorient(grid, "RAS", "PRI", (51, 11, 9))


@query("p29_p30_spacing", "SELECT cloud_id, point_id, x * 0.7 AS px, -(y * 0.8) AS py, z * 2.5 AS pz FROM pts")
def _(spark, d):
    m = scalar.axis_directions("RPS")
    spacing = (0.7, 0.8, 2.5)
    affine = [m[3 * r + c] * spacing[c] if c < 3 else 0.0 for r in range(3) for c in range(4)]
    p = scalar.apply_affine("x", "y", "z", affine)
    return points(spark, d).select("cloud_id", "point_id", *[(c + 0.0).alias(n) for c, n in zip(p, ("px", "py", "pz"))])


@query("p31_flip", f"SELECT cloud_id, point_id, CASE WHEN {draw_sql(1, 'cloud_id')} < 0.5 THEN -x ELSE x END + 0.0 AS x, CASE WHEN {draw_sql(2, 'cloud_id')} < 0.5 THEN -y ELSE y END + 0.0 AS y FROM pts")
def _(spark, d):
    from cloudloom.operators.augment import flip

    return flip(points(spark, d), 0.5, seed=1).select("cloud_id", "point_id", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))


@query("p32_rotate", f"""WITH b AS (SELECT *, (min(x) over w + max(x) over w)/2 AS cx, (min(y) over w + max(y) over w)/2 AS cy FROM pts WINDOW w AS (PARTITION BY cloud_id))
 SELECT cloud_id, point_id, round((x-cx)*cos({math.pi}/6) - (y-cy)*sin({math.pi}/6) + cx, 6) + 0.0 AS x, round((x-cx)*sin({math.pi}/6) + (y-cy)*cos({math.pi}/6) + cy, 6) + 0.0 AS y, z FROM b""")
def _(spark, d):
    from cloudloom.operators.augment import rotate_clouds

    return rounded(rotate_clouds(points(spark, d), "z", F.lit(math.pi / 6)).select("cloud_id", "point_id", "x", "y", "z"), "x", "y")


@query("p35_p36_scale_shift", f"""SELECT cloud_id, point_id, round(x * (0.9 + {draw_sql(5, 'cloud_id')} * 0.2) + (-1 + {draw_sql(9, 'cloud_id')} * 2), 6) AS x FROM pts""")
def _(spark, d):
    from cloudloom.operators.augment import scale_clouds, shift_clouds

    df = shift_clouds(scale_clouds(points(spark, d), 0.9, 1.1, seed=5), {"x": (-1, 1)}, seed=9)
    return rounded(df.select("cloud_id", "point_id", "x"), "x")


@query("p37_jitter", f"""SELECT cloud_id, point_id, round(x + least(greatest(0.01 * sqrt(-2 * ln(1 - {draw_sql(3, 'cloud_id', 'point_id')})) * cos(2 * pi() * {draw_sql(1003, 'cloud_id', 'point_id')}), -0.02), 0.02), 6) AS x FROM pts""")
def _(spark, d):
    from cloudloom.operators.augment import jitter

    return rounded(jitter(points(spark, d), {"x": 3}, sigma=0.01, clip=0.02).select("cloud_id", "point_id", "x"), "x")


@query("p41_p43_colour", """WITH c AS (SELECT cloud_id, point_id, x*5 AS r, y*25 AS g, z*30 AS b FROM pts),
 e AS (SELECT *, greatest(r,g,b)/255 AS v, (greatest(r,g,b)-least(r,g,b))/255 AS dd FROM c)
 SELECT cloud_id, point_id, round(0.2989*r + 0.587*g + 0.114*b, 6) AS grey, round(v, 6) AS v, round(CASE WHEN v = 0 THEN 0 ELSE dd/v END, 6) AS s,
 round(CASE WHEN dd = 0 THEN 0 WHEN v = r/255 THEN ((((g-b)/255/dd) % 6) + 6) % 6 WHEN v = g/255 THEN (b-r)/255/dd + 2 ELSE (r-g)/255/dd + 4 END / 6, 6) AS h FROM e""")
def _(spark, d):
    c = points(spark, d).selectExpr("cloud_id", "point_id", "x*5 r", "y*25 g", "z*30 b")
    h, s, v = scalar.hsv("r", "g", "b")
    return rounded(c.select("cloud_id", "point_id", scalar.grey("r", "g", "b").alias("grey"), v.alias("v"), s.alias("s"), h.alias("h")), "grey", "v", "s", "h")


@query("p48_yaw", "SELECT seq_id, frame_id, round(atan2(2*cos(radians(yaw_deg)/2)*sin(radians(yaw_deg)/2), 1 - 2*sin(radians(yaw_deg)/2)*sin(radians(yaw_deg)/2)), 6) + 0.0 AS yaw FROM frames WHERE yaw_deg <> 180")
def _(spark, d):
    from cloudloom.sources.fixtures import frames

    half = F.radians("yaw_deg") / 2
    df = frames(spark, d).where("yaw_deg <> 180").select("seq_id", "frame_id", scalar.yaw_of(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half)).alias("yaw"))
    return rounded(df, "yaw")


@query("p51_p53_unproject", """SELECT cloud_id, point_id, round((x - 25)/500*intensity, 9) + 0.0 AS px, round((y - 5)/400*intensity, 9) + 0.0 AS py,
 round(intensity / sqrt(((x-25)/500)*((x-25)/500) + ((y-5)/400)*((y-5)/400) + 1), 9) AS depth, round(intensity*cos((0.5 - y/10)*pi())*sin((x/50 - 0.5)*2*pi()), 4) + 0.0 AS qx, round(intensity*sin((0.5 - y/10)*pi()), 4) + 0.0 AS qy FROM pts""")
def _(spark, d):
    p = points(spark, d)
    a = scalar.unproject(F.col("x"), F.col("y"), F.col("intensity"), 500, 400, 25, 5)
    q = scalar.panorama_point(F.col("x"), F.col("y"), F.col("intensity"), 50, 10)
    z = scalar.z_depth(F.col("x"), F.col("y"), F.col("intensity"), 500, 400, 25, 5)
    return rounded(rounded(p.select("cloud_id", "point_id", a[0].alias("px"), a[1].alias("py"), z.alias("depth"), q[0].alias("qx"), q[1].alias("qy")), "px", "py", "depth", digits=9), "qx", "qy", digits=4)


@query("p56_strength", "SELECT cloud_id, point_id, round(tanh(intensity/100), 6) AS t, round(intensity/255, 6) AS s FROM pts")
def _(spark, d):
    return rounded(points(spark, d).select("cloud_id", "point_id", F.tanh(F.col("intensity") / 100).alias("t"), (F.col("intensity") / 255).alias("s")), "t", "s")


@query("p57_voxel_key", "SELECT cloud_id, point_id, CAST((x*11 + y)*9 + z AS BIGINT) AS k FROM pts")
def _(spark, d):
    i, j, k = (F.col(a).cast("bigint") for a in "xyz")
    return points(spark, d).select("cloud_id", "point_id", scalar.voxel_key(i, j, k, (51, 11, 9)).alias("k"))


@query("p59_morton", "SELECT cloud_id, point_id, CAST((" + " + ".join(f"((x::bigint >> {b}) & 1) * {4 << 3 * b} + ((y::bigint >> {b}) & 1) * {2 << 3 * b} + ((z::bigint >> {b}) & 1) * {1 << 3 * b}" for b in range(7)) + ") AS BIGINT) AS code, x::bigint AS i, y::bigint AS j, z::bigint AS k FROM pts")
def _(spark, d):
    i, j, k = (F.col(a).cast("bigint") for a in "xyz")
    df = points(spark, d).withColumn("code", scalar.morton(i, j, k))
    return df.select("cloud_id", "point_id", "code", *[c.alias(n) for c, n in zip(scalar.morton_decode(F.col("code")), "ijk")])


@query("p62_depth", "SELECT cloud_id, CAST(length(bin(max(greatest(x,y,z))::bigint)) AS INTEGER) + 1 AS depth FROM pts GROUP BY 1")
def _(spark, d):
    return points(spark, d).groupBy("cloud_id").agg((scalar.bits_needed(F.max(F.greatest("x", "y", "z"))) + 1).alias("depth"))


@query("p65_natural_sort", "SELECT p_partkey::bigint AS part, row_number() OVER (ORDER BY p_partkey) AS rn FROM part")
def _(spark, d):
    from cloudloom.functions.ranking import global_rank
    from cloudloom.sources.fixtures import read

    named = read(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("part"), F.concat(F.lit("cloud_"), F.col("p_partkey").cast("string")).alias("name"))
    return global_rank(named, [scalar.natural_key("name")], "rn").select("part", F.col("rn").cast("bigint").alias("rn"))


@query("p68_offset_target", "SELECT cloud_id, point_id, round(avg(x) OVER w - x, 6) + 0.0 AS dx, round(avg(y) OVER w - y, 6) + 0.0 AS dy FROM pts WHERE instance >= 0 WINDOW w AS (PARTITION BY cloud_id, instance)")
def _(spark, d):
    df = cloud.parse_instances(points(spark, d), []).where("instance >= 0")
    return rounded(df.select("cloud_id", "point_id", (F.col("cx") - F.col("x")).alias("dx"), (F.col("cy") - F.col("y")).alias("dy")), "dx", "dy")


@query("a1_centre_shift", "SELECT cloud_id, point_id, x - (min(x) OVER w + max(x) OVER w)/2 AS x, y - (min(y) OVER w + max(y) OVER w)/2 AS y, z - min(z) OVER w AS z FROM pts WINDOW w AS (PARTITION BY cloud_id)")
def _(spark, d):
    return cloud.centre_shift(points(spark, d)).select("cloud_id", "point_id", "x", "y", "z")


@query("a2_positive_shift", "SELECT cloud_id, point_id, x - min(x) OVER w AS x, y - min(y) OVER w AS y, z - min(z) OVER w AS z FROM pts WINDOW w AS (PARTITION BY cloud_id)")
def _(spark, d):
    return cloud.positive_shift(points(spark, d)).select("cloud_id", "point_id", "x", "y", "z")


@query("a3_unit_sphere", """WITH c AS (SELECT cloud_id, point_id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM pts WINDOW w AS (PARTITION BY cloud_id))
 SELECT cloud_id, point_id, round(x / max(sqrt(x*x+y*y+z*z)) OVER w, 6) + 0.0 AS x, round(y / max(sqrt(x*x+y*y+z*z)) OVER w, 6) + 0.0 AS y, round(z / max(sqrt(x*x+y*y+z*z)) OVER w, 6) + 0.0 AS z FROM c WINDOW w AS (PARTITION BY cloud_id)""")
def _(spark, d):
    return rounded(cloud.unit_sphere(points(spark, d)).select("cloud_id", "point_id", "x", "y", "z"), "x", "y", "z")


STATS_SQL = """q AS (SELECT cloud_id, quantile_cont(intensity, 0.005) AS lo, quantile_cont(intensity, 0.995) AS hi FROM pts GROUP BY 1),
 s AS (SELECT p.cloud_id, any_value(lo) AS lo, any_value(hi) AS hi, avg(least(greatest(intensity, lo), hi)) AS m, stddev_pop(least(greatest(intensity, lo), hi)) AS sd FROM pts p JOIN q ON p.cloud_id = q.cloud_id GROUP BY 1)"""


@query("a8_stats", f"WITH {STATS_SQL} SELECT cloud_id, round(lo, 4) AS p_low, round(hi, 4) AS p_high, round(m, 4) AS mean, round(sd, 4) AS std FROM s")
def _(spark, d):
    return rounded(cloud.intensity_stats(points(spark, d)), "p_low", "p_high", "mean", "std", digits=4)


@query("a4_normalise_intensity", f"WITH {STATS_SQL} SELECT p.cloud_id, point_id, round((least(greatest(intensity, lo), hi) - m) / greatest(sd, 1e-6), 5) + 0.0 AS intensity FROM pts p JOIN s ON p.cloud_id = s.cloud_id")
def _(spark, d):
    return rounded(cloud.normalise_intensity(points(spark, d)).select("cloud_id", "point_id", "intensity"), "intensity", digits=5)


@query("a5_auto_contrast", "SELECT cloud_id, point_id, round(0.5*x + 0.5*(x - min(x) OVER w)*255/(max(x) OVER w - min(x) OVER w), 6) AS x FROM pts WINDOW w AS (PARTITION BY cloud_id)")
def _(spark, d):
    return rounded(cloud.auto_contrast(points(spark, d), ["x"], 0.5).select("cloud_id", "point_id", "x"), "x")


@query("a6_intensity_variation", "SELECT cloud_id, point_id, round(pow((intensity - min(intensity) OVER w)/(max(intensity) OVER w - min(intensity) OVER w), 0.8)*(max(intensity) OVER w - min(intensity) OVER w)*1.1 + min(intensity) OVER w + 20, 4) AS v FROM pts WINDOW w AS (PARTITION BY cloud_id)")
def _(spark, d):
    return rounded(cloud.intensity_variation(points(spark, d), 20, 1.1, 0.8).select("cloud_id", "point_id", F.col("intensity").alias("v")), "v", digits=4)


@query("a7_instances", """WITH k AS (SELECT *, CASE WHEN label IN (0) OR instance < 0 THEN NULL ELSE instance END AS kp FROM pts),
 r AS (SELECT *, CASE WHEN kp IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY cloud_id ORDER BY kp NULLS LAST) - 1 END AS inst FROM k)
 SELECT cloud_id, CAST(inst AS INTEGER) AS instance, (min(x)+max(x))/2 AS bx, max(x)-min(x) AS sx, (min(y)+max(y))/2 AS "by", max(y)-min(y) AS sy, (min(z)+max(z))/2 AS bz, max(z)-min(z) AS sz,
 arg_min(label, point_id) AS class, count(*) AS n FROM r WHERE inst >= 0 GROUP BY 1, 2""")
def _(spark, d):
    return cloud.instance_boxes(cloud.parse_instances(points(spark, d), [0]))


@query("a12_histogram", "SELECT label AS class, count(*) AS points, count(DISTINCT cloud_id) AS clouds, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM pts GROUP BY 1")
def _(spark, d):
    return rounded(cloud.class_histogram(points(spark, d)), "share")


@query("a13_totals", "SELECT cloud_id, count(*) AS n, round(avg(CASE WHEN label > 0 THEN 1.0 ELSE 0.0 END), 6) AS fg FROM pts GROUP BY 1")
def _(spark, d):
    return rounded(points(spark, d).groupBy("cloud_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("label") > 0, 1.0).otherwise(0.0)).alias("fg")), "fg")


@query("a14_sparse_shape", "SELECT cloud_id, CAST(max(x) AS BIGINT) + 96 AS sx, CAST(max(y) AS BIGINT) + 96 AS sy, CAST(max(z) AS BIGINT) + 96 AS sz FROM pts GROUP BY 1")
def _(spark, d):
    return points(spark, d).groupBy("cloud_id").agg(*[(F.max(a).cast("bigint") + 96).alias(f"s{a}") for a in "xyz"])
