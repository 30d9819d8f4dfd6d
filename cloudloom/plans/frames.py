"""Queries of curves, poses, pixels and star joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.operators import curves, grid
from cloudloom.operators import neighbors as nb
from cloudloom.plans.catalog import query
from cloudloom.plans.geometry import rounded
from cloudloom.sources.fixtures import frames, points, read


def hilbert_sql(i: str, j: str, k: str, bits: int) -> str:
    """The code of three indices by the curve's state machine, as a recursive query over the bits; v: cloud_id, point_id and indices."""
    return f"""hb AS (WITH RECURSIVE h(cloud_id, point_id, q, a, b, c) AS (SELECT cloud_id, point_id, {1 << (bits - 1)}::bigint, {i}::bigint, {j}::bigint, {k}::bigint FROM pts UNION ALL
 SELECT cloud_id, point_id, q >> 1, CASE WHEN c2 & q > 0 THEN xor(a2, q-1) ELSE xor(a2, xor(a2, c2) & (q-1)) END, b2, CASE WHEN c2 & q > 0 THEN c2 ELSE xor(c2, xor(a2, c2) & (q-1)) END FROM (SELECT cloud_id, point_id, q, CASE WHEN b1 & q > 0 THEN xor(a1, q-1) ELSE xor(a1, xor(a1, b1) & (q-1)) END AS a2, CASE WHEN b1 & q > 0 THEN b1 ELSE xor(b1, xor(a1, b1) & (q-1)) END AS b2, c1 AS c2 FROM (SELECT cloud_id, point_id, q, CASE WHEN a & q > 0 THEN xor(a, q-1) ELSE a END AS a1, b AS b1, c AS c1 FROM h WHERE q > 1)))
 SELECT cloud_id, point_id, a, xor(b, a) AS b, xor(c, xor(b, a)) AS c FROM h WHERE q = 1),
 ht AS (SELECT *, {' '.join(f'xor(CASE WHEN (c & {1 << b}) > 0 THEN {(1 << b) - 1} ELSE 0 END,' for b in range(1, bits))} 0{')' * (bits - 1)} AS t FROM hb), hc AS (SELECT cloud_id, point_id, {' + '.join(f'(((xor(a, t) >> {b}) & 1) << {3 * b + 2}) + (((xor(b, t) >> {b}) & 1) << {3 * b + 1}) + (((xor(c, t) >> {b}) & 1) << {3 * b})' for b in range(bits))} AS code FROM ht)"""


@query("p60_hilbert", f"WITH {hilbert_sql('x', 'y', 'z', 6)} SELECT cloud_id, point_id, code::bigint AS code FROM hc")
def _(spark, d):
    i, j, k = (F.col(a) for a in "xyz")
    return points(spark, d).select("cloud_id", "point_id", curves.hilbert(i, j, k, 6).alias("code"))


@query("p61_prefix_code", "SELECT cloud_id, point_id, (cloud_id << 30) | (x::bigint * 100 + y::bigint) AS code, cloud_id AS cloud, x::bigint * 100 + y::bigint AS inner_code FROM pts")
def _(spark, d):
    code = F.col("x").cast("bigint") * 100 + F.col("y").cast("bigint")
    df = points(spark, d).withColumn("code", curves.with_cloud_prefix(F.col("cloud_id"), code, 10))
    cloud, inner = curves.split_prefix(F.col("code"), 10)
    return df.select("cloud_id", "point_id", "code", cloud.alias("cloud"), inner.alias("inner_code"))


@query("p63_sine_embedding", "WITH s AS (SELECT cloud_id, point_id, (x - min(x) OVER w)/(max(x) OVER w - min(x) OVER w)*2*pi() AS a FROM pts WINDOW w AS (PARTITION BY cloud_id)) SELECT cloud_id, point_id, round(sin(a), 6) + 0.0 AS s0, round(cos(a/pow(10000, 0.5)), 6) + 0.0 AS c1 FROM s")
def _(spark, d):
    e = curves.sine_embedding(points(spark, d), ["x"], 2)
    return rounded(e.select("cloud_id", "point_id", F.col("embedding")[0].alias("s0"), F.col("embedding")[3].alias("c1")), "s0", "c1")


@query("p47_align_pose", "SELECT a.seq_id, a.frame_id, round(cos(radians(a.yaw_deg))*(b.tx - a.tx), 6) + 0.0 AS px, round(-sin(radians(a.yaw_deg))*(b.tx - a.tx), 6) + 0.0 AS py FROM frames a JOIN frames b ON a.seq_id = b.seq_id AND b.frame_idx = a.frame_idx + 1")
def _(spark, d):
    a = frames(spark, d)
    b = a.select("seq_id", (F.col("frame_idx") - 1).alias("frame_idx"), F.col("tx").alias("bx"))
    c, s, o, i = F.cos(F.radians("yaw_deg")), F.sin(F.radians("yaw_deg")), F.lit(0.0), F.lit(1.0)
    p = curves.inverse_rigid([c, -s, o, s, c, o, o, o, i], [F.col("tx"), o, o], [F.col("bx"), o, o])
    return rounded(a.join(b, ["seq_id", "frame_idx"]).select("seq_id", "frame_id", p[0].alias("px"), p[1].alias("py")), "px", "py")


@query("p54_centre_crop", "SELECT cloud_id, count(*) AS n FROM pts WHERE x BETWEEN 1 AND 48 AND y BETWEEN 1 AND 8 GROUP BY 1")
def _(spark, d):
    return points(spark, d).where(curves.centre_crop("x", "y", 50, 10, 8)).groupBy("cloud_id").agg(F.count("*").alias("n"))


@query("p55_image_normals", """WITH g AS (SELECT cloud_id AS frame, x::bigint AS u, y::bigint AS v, x, y, avg(z) AS z FROM pts GROUP BY ALL),
 s AS (SELECT *, coalesce(lead(x) OVER d, x) - x ax, coalesce(lead(y) OVER d, y) - y ay, coalesce(lead(z) OVER d, z) - z az, coalesce(lead(x) OVER r, x) - x bx, coalesce(lead(y) OVER r, y) - y "by", coalesce(lead(z) OVER r, z) - z bz FROM g WINDOW d AS (PARTITION BY frame, u ORDER BY v), r AS (PARTITION BY frame, v ORDER BY u))
 SELECT frame, u, v, round(ay*bz - az*"by", 6) + 0.0 AS nx, round(az*bx - ax*bz, 6) + 0.0 AS ny, round(ax*"by" - ay*bx, 6) + 0.0 AS nz FROM s""")
def _(spark, d):
    g = points(spark, d).groupBy(F.col("cloud_id").alias("frame"), F.col("x").cast("bigint").alias("u"), F.col("y").cast("bigint").alias("v"), "x", "y").agg(F.avg("z").alias("z"))
    return rounded(curves.image_normals(g).select("frame", "u", "v", "nx", "ny", "nz"), "nx", "ny", "nz")


@query("g19_relative_cells", "WITH c AS (SELECT cloud_id, point_id, x::bigint cx, y::bigint cy, z::bigint cz, floor((point_id - 1)/16)::bigint AS patch FROM pts) SELECT a.cloud_id, a.patch, count(*) AS n, sum(abs(a.cx - b.cx))::bigint AS dx FROM c a JOIN c b ON a.cloud_id = b.cloud_id AND a.patch = b.patch GROUP BY 1, 2")
def _(spark, d):
    p = points(spark, d).withColumns({**{f"c{a}": F.col(a).cast("bigint") for a in "xyz"}, "patch": F.floor((F.col("point_id") - 1) / 16)})
    return curves.relative_cells(p).groupBy("cloud_id", "patch").agg(F.count("*").alias("n"), F.sum(F.abs("dx")).alias("dx"))


@query("g7_g11_fused_voxels", "SELECT floor(x/4)::bigint AS vx, floor(y/4)::bigint AS vy, floor(z/4)::bigint AS vz, round(avg(x), 6) AS x, max(intensity) AS top, count(*) AS n FROM pts GROUP BY 1, 2, 3")
def _(spark, d):
    v = grid.fused_voxels(points(spark, d), 4.0, ["x"], ["intensity"]).withColumnRenamed("intensity", "top")
    return rounded(v, "x")


@query("j9_j35_feature_transfer", "WITH s AS (SELECT * FROM pts WHERE point_id % 7 = 0), k AS (SELECT a.cloud_id, a.point_id, b.intensity AS feature, row_number() OVER (PARTITION BY a.cloud_id, a.point_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.point_id) AS rk FROM pts a JOIN s b ON a.cloud_id = b.cloud_id) SELECT cloud_id, point_id, feature FROM k WHERE rk = 1")
def _(spark, d):
    p = points(spark, d)
    coarse = p.where("point_id % 7 = 0")
    return nb.gather(nb.knn(p, coarse, 1), coarse, ["intensity"]).select("cloud_id", F.col("src").alias("point_id"), F.col("intensity").alias("feature"))


@query("j34_star_join", "SELECT o_orderkey::bigint AS sample, any_value(c_mktsegment) AS scene, count(l_orderkey) AS annotations, coalesce(sum(l_quantity), 0)::double AS total FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 10 GROUP BY 1")
def _(spark, d):
    o, c, li = (read(spark, d, t) for t in ("orders", "customer", "lineitem"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(li.where("l_quantity > 10"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.groupBy(F.col("o_orderkey").cast("bigint").alias("sample")).agg(F.first("c_mktsegment").alias("scene"), F.count("l_orderkey").alias("annotations"), F.coalesce(F.sum("l_quantity"), F.lit(0.0)).cast("double").alias("total"))


@query("r18_downsample_sizes", "SELECT cloud_id, (floor(count(*)*0.25) + 1)::bigint AS by_ratio, (count(*) // 8)::bigint AS by_scale FROM pts GROUP BY 1")
def _(spark, d):
    return grid.downsample_sizes(points(spark, d), 0.25, 8)


@query("g17_k1_orders", "SELECT cloud_id, point_id, (row_number() OVER (PARTITION BY cloud_id ORDER BY z, y, x, point_id) - 1)::int AS ord, (row_number() OVER (PARTITION BY cloud_id ORDER BY x, y, z, point_id) - 1)::int AS trans FROM pts")
def _(spark, d):
    return grid.axis_orders(points(spark, d), {"ord": "zyx", "trans": "xyz"}).select("cloud_id", "point_id", "ord", "trans")


@query("g6_superpoint_broadcast", "SELECT cloud_id, point_id, round(avg(x) OVER (PARTITION BY cloud_id, rib), 6) AS mean_x FROM pts")
def _(spark, d):
    p = points(spark, d)
    m = grid.segment_mean(p, "rib", ["x"]).select("cloud_id", "rib", F.col("x").alias("mean_x"))
    return rounded(p.join(m, ["cloud_id", "rib"]).select("cloud_id", "point_id", "mean_x"), "mean_x")
