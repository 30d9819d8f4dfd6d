"""Queries of filters, crops and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions.random import draw_sql
from cloudloom.operators import augment, cloud, fuse
from cloudloom.plans.catalog import ORACLE_SQL, query
from cloudloom.plans.geometry import rounded
from cloudloom.sources.fixtures import points

DRAW = draw_sql(7, "cloud_id", "point_id")


@query("r1_drop_classes", "SELECT cloud_id, label, count(*) AS n FROM pts WHERE label NOT IN (0, 1) GROUP BY 1, 2")
def _(spark, d):
    return cloud.drop_classes(points(spark, d), [0, 1]).groupBy("cloud_id", "label").agg(F.count("*").alias("n"))


@query("r2_dilated_cloud", """WITH v AS (SELECT DISTINCT cloud_id, x::bigint i, y::bigint j, z::bigint k FROM pts), s AS (SELECT DISTINCT cloud_id, x::bigint i, y::bigint j, z::bigint k FROM pts WHERE label = 3 AND rib = 3),
 g AS (SELECT DISTINCT v.* FROM v JOIN s ON v.cloud_id = s.cloud_id AND abs(v.i-s.i)+abs(v.j-s.j)+abs(v.k-s.k) <= 2), h AS (SELECT DISTINCT cloud_id, x::bigint i, y::bigint j, z::bigint k FROM pts WHERE intensity > 400 AND label IN (1, 3)) SELECT * FROM g UNION SELECT * FROM h""")
def _(spark, d):
    from cloudloom.operators import voxels

    p = points(spark, d).withColumns({b: F.col(a).cast("bigint") for a, b in zip("xyz", "ijk")})
    return voxels.threshold_or_dilated(p, F.col("intensity") > 400, F.col("label").isin(1, 3), (F.col("label") == 3) & (F.col("rib") == 3), 2)


@query("r3_patch", f"""WITH c AS (SELECT *, arg_min(x, ({DRAW}, point_id)) OVER w AS px, arg_min(y, ({DRAW}, point_id)) OVER w AS py, arg_min(z, ({DRAW}, point_id)) OVER w AS pz, min(x) OVER w x0, max(x) OVER w x1, min(y) OVER w y0, max(y) OVER w y1, min(z) OVER w z0, max(z) OVER w z1 FROM pts WINDOW w AS (PARTITION BY cloud_id)),
 s AS (SELECT *, greatest(x0, least(px - 10, x1 - 20)) sx, greatest(y0, least(py - 2.5, y1 - 5)) sy, greatest(z0, least(pz - 2, z1 - 4)) sz FROM c)
 SELECT cloud_id, point_id FROM s WHERE (x1-x0 <= 20 OR (x >= sx AND x < sx + 20)) AND (y1-y0 <= 5 OR (y >= sy AND y < sy + 5)) AND (z1-z0 <= 4 OR (z >= sz AND z <= sz + 4))""")
def _(spark, d):
    return cloud.patch(points(spark, d), (20, 5, 4), 7).select("cloud_id", "point_id")


@query("r4_sphere_crop", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) AS r, count(*) OVER (PARTITION BY cloud_id) AS n FROM pts), c AS (SELECT cloud_id, x cx, y cy, z cz FROM n WHERE r = floor(n/2) + 1),
 k AS (SELECT p.*, row_number() OVER (PARTITION BY p.cloud_id ORDER BY (x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz), point_id) AS rk FROM pts p JOIN c ON p.cloud_id = c.cloud_id) SELECT cloud_id, point_id FROM k WHERE rk <= 100""")
def _(spark, d):
    return cloud.sphere_crop(points(spark, d), 100).select("cloud_id", "point_id")


@query("r5_drop_ribs", "WITH k AS (SELECT *, count(*) FILTER (rib NOT IN (1, 13, 2, 14)) OVER (PARTITION BY cloud_id) AS l FROM pts) SELECT cloud_id, point_id FROM k WHERE rib NOT IN (1, 13, 2, 14) OR l < 500")
def _(spark, d):
    return cloud.drop_ribs(points(spark, d), 2, "first", 500).select("cloud_id", "point_id")


NUMBER = "CASE WHEN rib > 12 THEN rib - 12 ELSE rib END"


@query("r7_truncate", f"""WITH k AS (SELECT *, avg(x) FILTER ({NUMBER} = 3) OVER (PARTITION BY cloud_id) AS m FROM pts), i AS (SELECT *, CASE WHEN m IS NULL THEN rib = 0 OR {NUMBER} > 3 ELSE x < m END AS a FROM k), c AS (SELECT *, count(*) FILTER (a) OVER (PARTITION BY cloud_id) AS n FROM i) SELECT cloud_id, point_id FROM c WHERE a OR n < 200""")
def _(spark, d):
    return cloud.truncate_at_rib(points(spark, d), 3, "s", "m", "x", 200).select("cloud_id", "point_id")


@query("r7_truncate_border", f"""WITH k AS (SELECT *, max(intensity) FILTER ({NUMBER} = 10) OVER (PARTITION BY cloud_id) AS m FROM pts), i AS (SELECT *, CASE WHEN m IS NULL THEN rib = 0 OR {NUMBER} < 10 ELSE intensity > m END AS a FROM k), c AS (SELECT *, count(*) FILTER (a) OVER (PARTITION BY cloud_id) AS n FROM i) SELECT cloud_id, point_id FROM c WHERE a OR n < 3""")
def _(spark, d):
    return cloud.truncate_at_rib(points(spark, d), 3, "i", "b", "intensity", 3).select("cloud_id", "point_id")


@query("r8_random_truncate", f"""WITH s AS (SELECT cloud_id, list_sort(list(DISTINCT rib)) AS st FROM pts GROUP BY 1), h AS (SELECT cloud_id, st, len(st) // 2 AS pairs, {draw_sql(20, 'cloud_id')} < 0.8 AND len(st) // 2 >= 2 AS ok, CASE WHEN {draw_sql(22, 'cloud_id')} < 0.5 THEN 's' ELSE 'i' END AS bg, CASE WHEN {draw_sql(24, 'cloud_id')} < 0.5 THEN 'm' ELSE 'b' END AS ps FROM s),
 e AS (SELECT *, floor({draw_sql(21, 'cloud_id')} * least(pairs - 1, 4)) + 1 AS depth FROM h), o AS (SELECT *, list_filter(st, lambda q: q > 0 AND CASE WHEN bg = 's' THEN (CASE WHEN q > 12 THEN q - 12 ELSE q END) <= depth ELSE (CASE WHEN q > 12 THEN q - 12 ELSE q END) > 12 - depth END) AS ot FROM e),
 n AS (SELECT *, CASE WHEN ok AND len(ot) > 0 THEN ot[floor({draw_sql(23, 'cloud_id')} * len(ot))::int + 1] END AS anchor FROM o), k AS (SELECT p.*, bg, ps, avg(x) FILTER (rib = anchor) OVER w AS av, min(x) FILTER (rib = anchor) OVER w AS mi, max(x) FILTER (rib = anchor) OVER w AS ma FROM pts p JOIN n ON p.cloud_id = n.cloud_id WINDOW w AS (PARTITION BY p.cloud_id)),
 c AS (SELECT *, CASE WHEN ps = 'm' THEN av WHEN bg = 's' THEN mi ELSE ma END AS cut FROM k), i AS (SELECT *, CASE WHEN cut IS NULL THEN true WHEN bg = 's' THEN x < cut ELSE x > cut END AS a FROM c), f AS (SELECT *, count(*) FILTER (a) OVER (PARTITION BY cloud_id) AS n FROM i) SELECT cloud_id, point_id FROM f WHERE a OR n < 20""")
def _(spark, d):
    return cloud.random_truncate(points(spark, d), 4, 20, p=0.8, axis="x", min_points=20).select("cloud_id", "point_id")


RANK = f"k AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY {DRAW}, point_id) AS r, count(*) OVER (PARTITION BY cloud_id) AS n FROM pts)"


@query("r9_dropout", f"WITH {RANK} SELECT cloud_id, point_id FROM k WHERE r <= floor(n * 0.75) OR label = 3")
def _(spark, d):
    return cloud.dropout(points(spark, d), 0.25, 7, F.col("label") == 3).select("cloud_id", "point_id")


@query("r10_limit", f"WITH {RANK} SELECT cloud_id, point_id FROM k WHERE r <= 300")
def _(spark, d):
    return cloud.limit_points(points(spark, d), 300, 7).select("cloud_id", "point_id")


@query("r11_sample", f"WITH {RANK}, a AS (SELECT cloud_id, r AS slot, point_id FROM k WHERE r <= 620), s AS (SELECT DISTINCT cloud_id, n FROM k WHERE n < 620), m AS (SELECT cloud_id, slot, floor({draw_sql(8, 'cloud_id', 'slot')} * n)::bigint + 1 AS r FROM s, range(1, 621) t(slot) WHERE slot > n) SELECT cloud_id, slot::int AS slot, point_id FROM a UNION ALL SELECT m.cloud_id, slot::int, point_id FROM m JOIN k ON m.cloud_id = k.cloud_id AND m.r = k.r")
def _(spark, d):
    return cloud.sample_points(points(spark, d), 620, 7).select("cloud_id", "slot", "point_id")


@query("r10_r11_range_samples", ORACLE_SQL["r11_sample"])
def _(spark, d):
    return cloud.sample_points(points(spark, d), 620, 7, large=True).select("cloud_id", "slot", "point_id")


@query("r12_shuffle", f"WITH {RANK} SELECT cloud_id, point_id, r::int AS ord FROM k")
def _(spark, d):
    return cloud.shuffle_points(points(spark, d), 7).select("cloud_id", "point_id", "ord")


@query("r20_two_views", f"SELECT cloud_id, point_id, v::int AS view, round(x * (0.9 + CASE WHEN v = 0 THEN {draw_sql(21, 'cloud_id')} ELSE {draw_sql(22, 'cloud_id')} END * 0.2), 6) AS x FROM pts, range(2) t(v)")
def _(spark, d):
    p = points(spark, d)
    views = [augment.scale_clouds(p, 0.9, 1.1, seed=21 + v).withColumn("view", F.lit(v)) for v in (0, 1)]
    return rounded(views[0].unionByName(views[1]).select("cloud_id", "point_id", "view", "x"), "x")


@query("r22_patch_mask", f"WITH c AS (SELECT *, floor(x/8)::bigint AS cx, floor(y/4)::bigint AS cy FROM pts), u AS (SELECT DISTINCT cloud_id, cx, cy FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY {draw_sql(5, 'cloud_id', 'cx', 'cy')}, cx, cy) AS r, count(*) OVER (PARTITION BY cloud_id) AS n FROM u) SELECT c.cloud_id, c.point_id, r <= floor(n * 0.4) AS masked FROM c JOIN k USING (cloud_id, cx, cy)")
def _(spark, d):
    from cloudloom.operators import voxels

    p = points(spark, d).withColumns({"cx": F.floor(F.col("x") / 8), "cy": F.floor(F.col("y") / 4)})
    return voxels.mask_patches(p, ["cx", "cy"], 0.4, 5).select("cloud_id", "point_id", "masked")


@query("r25_boxes_with_points", "SELECT cloud_id, rib, count(*) FILTER (intensity > 500) AS n FROM pts WHERE rib > 0 GROUP BY 1, 2 HAVING n > 0")
def _(spark, d):
    return points(spark, d).where("rib > 0").groupBy("cloud_id", "rib").agg(F.count_if(F.col("intensity") > 500).alias("n")).where("n > 0")


@query("r26_k6_largest", "SELECT cloud_id, count(*) AS n FROM pts GROUP BY 1 ORDER BY n DESC, cloud_id LIMIT 20")
def _(spark, d):
    return points(spark, d).groupBy("cloud_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cloud_id").limit(20)


@query("r27_r28_every_kth_frame", "SELECT seq_id, frame_id, frame_idx FROM frames WHERE frame_idx % 3 = 0 AND yaw_deg <> 90")
def _(spark, d):
    from cloudloom.sources.fixtures import frames

    return fuse.every_kth(frames(spark, d), 3, F.col("yaw_deg") != 90).select("seq_id", "frame_id", "frame_idx")


@query("r30_mix_pairs", "WITH t AS (SELECT floor(cloud_id/2)::bigint AS m, max(instance) AS top FROM pts WHERE cloud_id % 2 = 0 GROUP BY 1) SELECT floor(p.cloud_id/2)::bigint AS mix_id, p.cloud_id, point_id, (CASE WHEN p.cloud_id % 2 = 1 AND instance >= 0 THEN instance + coalesce(top, -1) + 1 ELSE instance END)::int AS instance FROM pts p LEFT JOIN t ON floor(p.cloud_id/2)::bigint = m")
def _(spark, d):
    return cloud.mix_pairs(points(spark, d)).select("mix_id", "cloud_id", "point_id", "instance")


@query("r31_p46_gates", f"SELECT cloud_id, point_id, CASE WHEN {draw_sql(31, 'cloud_id')} < 0.3 THEN x + 100 ELSE x END AS x, CASE WHEN floor({draw_sql(32, 'cloud_id')} * 2) = 0 THEN -y ELSE y * 2 END + 0.0 AS y FROM pts")
def _(spark, d):
    p = cloud.with_probability(points(spark, d), 0.3, 31, lambda df: df.withColumn("x", F.col("x") + 100))
    p = augment.choose_one(p, [lambda df: df.withColumn("y", -F.col("y")), lambda df: df.withColumn("y", F.col("y") * 2)], 32)
    return p.select("cloud_id", "point_id", "x", (F.col("y") + 0.0).alias("y"))


@query("r32_swap_views", "SELECT cloud_id, point_id, (1 - point_id % 2)::int AS view FROM pts")
def _(spark, d):
    return points(spark, d).withColumn("view", (F.col("point_id") % 2).cast("int")).withColumn("view", 1 - F.col("view")).select("cloud_id", "point_id", "view")


@query("j24_voxel_lookup", "WITH g AS (SELECT cloud_id, x, y, z, max(rib) AS value FROM pts WHERE point_id % 3 = 0 GROUP BY ALL) SELECT p.cloud_id, point_id, coalesce(value, -1)::int AS value FROM pts p LEFT JOIN g ON p.cloud_id=g.cloud_id AND p.x=g.x AND p.y=g.y AND p.z=g.z")
def _(spark, d):
    from cloudloom.operators import voxels

    p = points(spark, d).withColumns({b: F.col(a).cast("bigint") for a, b in zip("xyz", "ijk")})
    g = p.where("point_id % 3 = 0").groupBy("cloud_id", "i", "j", "k").agg(F.max("rib").alias("value"))
    return voxels.look_up(p, g, "value", -1).select("cloud_id", "point_id", F.col("value").cast("int").alias("value"))


@query("j25_raster", "SELECT cloud_id, x::bigint AS i, y::bigint AS j, z::bigint AS k, (arg_max(pred, point_id) > 0)::int AS fg FROM pts GROUP BY ALL")
def _(spark, d):
    from cloudloom.operators import voxels

    p = points(spark, d).withColumns({b: F.col(a).cast("bigint") for a, b in zip("xyz", "ijk")})
    return voxels.rasterise(p, "pred")


def _surface_sql(name: str, rows: str) -> str:
    steps = " UNION ALL ".join(f"SELECT cloud_id, i{'+1' if a == 0 else '-1' if a == 1 else ''} AS i, j{'+1' if a == 2 else '-1' if a == 3 else ''} AS j, k{'+1' if a == 4 else '-1' if a == 5 else ''} AS k FROM {name}0" for a in range(6))
    return f"{name}0 AS (SELECT DISTINCT cloud_id, x::bigint AS i, y::bigint AS j, z::bigint AS k FROM pts WHERE {rows}), {name}6 AS (SELECT cloud_id, i, j, k FROM ({steps}) GROUP BY ALL HAVING count(*) = 6), {name} AS (SELECT * FROM {name}0 EXCEPT SELECT * FROM {name}6)"


@query("e11_surface_distance", f"""WITH {_surface_sql('tr', 'label = 3')}, {_surface_sql('pd', 'pred = 3')}, pr AS (SELECT a.cloud_id, a.i AS ai, a.j AS aj, a.k AS ak, b.i AS bi, b.j AS bj, b.k AS bk, sqrt((a.i-b.i)**2 + (a.j-b.j)**2 + (a.k-b.k)**2) AS d FROM tr a JOIN pd b ON a.cloud_id = b.cloud_id),
 ds AS (SELECT cloud_id, 0 AS way, min(d) AS d FROM pr GROUP BY cloud_id, ai, aj, ak UNION ALL SELECT cloud_id, 1, min(d) FROM pr GROUP BY cloud_id, bi, bj, bk), f AS (SELECT cloud_id, max(d) AS hd, quantile_cont(d, 0.95) AS hd95, avg(d) FILTER (way = 1) AS asd, (avg(d) FILTER (way = 0) + avg(d) FILTER (way = 1))/2 AS assd FROM ds GROUP BY 1)
 SELECT c.cloud_id, round(hd, 5) AS hd, round(hd95, 5) AS hd95, round(asd, 5) AS asd, round(assd, 5) AS assd FROM (SELECT cloud_id FROM tr0 UNION SELECT cloud_id FROM pd0) c LEFT JOIN f ON f.cloud_id = c.cloud_id""")
def _(spark, d):
    from cloudloom.operators import voxels

    p = points(spark, d).withColumns({b: F.col(a).cast("bigint") for a, b in zip("xyz", "ijk")})
    return rounded(voxels.surface_distances(p.where("label = 3"), p.where("pred = 3"), (1.0, 1.0, 1.0)), "hd", "hd95", "asd", "assd", digits=5)
