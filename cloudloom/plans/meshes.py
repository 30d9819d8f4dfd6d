"""Queries of meshes, colours, masks and window pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions.random import draw_sql
from cloudloom.operators import augment, cluster, fuse, voxels
from cloudloom.plans.catalog import query
from cloudloom.plans.geometry import rounded
from cloudloom.plans.labels import FACES, faces
from cloudloom.sources.fixtures import points


def coloured(spark, d):
    return points(spark, d).selectExpr("cloud_id", "point_id", "x*5 r", "y*25 g", "z*30 b")


@query("p40_colour_shift", f"SELECT cloud_id, point_id, round(CASE WHEN {draw_sql(40, 'cloud_id')} < 0.6 THEN least(greatest(x*5 + ({draw_sql(41, 'cloud_id')} - 0.5)*2*255*0.1, 0), 255) ELSE x*5 END, 6) AS r FROM pts")
def _(spark, d):
    return rounded(augment.colour_shift(coloured(spark, d), 0.6, 0.1, 40).select("cloud_id", "point_id", "r"), "r")


@query("p44_colour_jitter", """WITH a AS (SELECT cloud_id, point_id, least(greatest(x*5*1.2,0),255) r, least(greatest(y*25*1.2,0),255) g, least(greatest(z*30*1.2,0),255) b FROM pts), m AS (SELECT *, avg(0.2989*r+0.587*g+0.114*b) OVER (PARTITION BY cloud_id) mg FROM a),
 c AS (SELECT cloud_id, point_id, least(greatest(r*0.8+mg*0.2,0),255) r, least(greatest(g*0.8+mg*0.2,0),255) g, least(greatest(b*0.8+mg*0.2,0),255) b FROM m), s AS (SELECT *, 0.2989*r+0.587*g+0.114*b AS gr FROM c) SELECT cloud_id, point_id, round(least(greatest(r*1.5-gr*0.5,0),255), 4) + 0.0 AS r, round(least(greatest(b*1.5-gr*0.5,0),255), 4) + 0.0 AS b FROM s""")
def _(spark, d):
    return rounded(augment.colour_jitter(coloured(spark, d), 1.2, 0.8, 1.5).select("cloud_id", "point_id", "r", "b"), "r", "b", digits=4)


def jittered_sql(ranges, p, seed):
    """Common tables up to j4: the steps in a drawn order, hue by the six sectors of the colour circle."""
    at = lambda k: draw_sql(seed + k, "cloud_id")
    drawn = [f"{' + '.join(f'({at(o)} < {at(k)})::int' for o in range(4) if o != k)} AS p{k}, {at(4 + k)} < {p} AS on{k}, {lo} + {at(8 + k)} * ({hi} - {lo}) AS a{k}" for k, (lo, hi) in enumerate(ranges)]
    tables = [f"j0 AS (SELECT cloud_id, point_id, x*5 AS r, y*25 AS g, z*30 AS b, {', '.join(drawn)} FROM pts)"]
    for n in range(4):
        on = lambda k: f"p{k} = {n} AND on{k}"  # noqa: E731, B023
        tables.append(f"g{n} AS (SELECT *, avg(gr) OVER (PARTITION BY cloud_id) AS mg, CASE WHEN mx = mn THEN 0 WHEN mx = r THEN (g - b)/(mx - mn) WHEN mx = g THEN 2 + (b - r)/(mx - mn) ELSE 4 + (r - g)/(mx - mn) END/6 + a3 AS hx FROM (SELECT *, 0.2989*r + 0.587*g + 0.114*b AS gr, greatest(r, g, b)::double AS mx, least(r, g, b)::double AS mn FROM j{n}))")
        tables.append(f"h{n} AS (SELECT *, floor(h6)::int AS sector, mx - (mx - mn)*(h6 - floor(h6)) AS fall, mx - (mx - mn)*(1 - h6 + floor(h6)) AS rise FROM (SELECT *, 6*(hx - floor(hx)) AS h6 FROM g{n}))")
        sectors = {"r": ("mx", "fall", "mn", "mn", "rise", "mx"), "g": ("rise", "mx", "mx", "fall", "mn", "mn"), "b": ("mn", "mn", "rise", "mx", "mx", "fall")}
        step = lambda c: f"CASE WHEN {on(0)} THEN least(greatest(a0*{c}, 0), 255) WHEN {on(1)} THEN least(greatest(a1*{c} + (1 - a1)*mg, 0), 255) WHEN {on(2)} THEN least(greatest(a2*{c} + (1 - a2)*gr, 0), 255) WHEN {on(3)} THEN CASE sector {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(sectors[c]))} ELSE {sectors[c][0]} END ELSE {c} END"  # noqa: E731, B023
        tables.append(f"j{n + 1} AS (SELECT cloud_id, point_id, {', '.join(f'{step(c)} AS {c}' for c in 'rgb')}, {', '.join(f'p{k}, on{k}, a{k}' for k in range(4))} FROM h{n})")
    return ", ".join(tables)


JITTER = ((0.6, 1.4), (0.6, 1.4), (0.5, 1.5), (-0.3, 0.3))


@query("p44_random_colour_jitter", f"WITH {jittered_sql(JITTER, 0.7, 440)} SELECT cloud_id, point_id, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in 'rgb')} FROM j4")
def _(spark, d):
    return rounded(augment.random_colour_jitter(coloured(spark, d), 440, *JITTER, p=0.7), "r", "g", "b", digits=4)


@query("p66_box_edges", """WITH bx AS (SELECT cloud_id AS id, min(x)::bigint x0, min(y)::bigint y0, min(z)::bigint z0, max(x)::bigint x1, max(y)::bigint y1, max(z)::bigint z1 FROM pts WHERE instance = 3 GROUP BY 1),
 g AS (SELECT id, x, y, z, (x IN (x0,x1))::int + (y IN (y0,y1))::int + (z IN (z0,z1))::int AS k FROM bx, range(0, 60) a(x), range(0, 12) b(y), range(0, 12) c(z) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1) SELECT id, x, y, z FROM g WHERE k >= 2""")
def _(spark, d):
    ends = [f(a).cast("bigint").alias(f"{a}{k}") for a in "xyz" for k, f in enumerate((F.min, F.max))]
    return fuse.box_edges(points(spark, d).where("instance = 3").groupBy(F.col("cloud_id").alias("id")).agg(*ends))


@query("a11_surface_samples", f"WITH {FACES}, n AS (SELECT f.cloud_id, sqrt(pow((b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y),2) + pow((b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z),2) + pow((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x),2))/2 AS ar FROM f JOIN pts a ON a.cloud_id=f.cloud_id AND a.point_id=v0 JOIN pts b ON b.cloud_id=f.cloud_id AND b.point_id=v1 JOIN pts c ON c.cloud_id=f.cloud_id AND c.point_id=v2) SELECT cloud_id, round(sum(ar), 4) AS area, floor(sum(ar)/0.25)::bigint AS samples FROM n GROUP BY 1")
def _(spark, d):
    v = points(spark, d).withColumnRenamed("point_id", "vertex_id")
    return rounded(fuse.surface_sample_sizes(fuse.face_normals(faces(spark, d), v), 0.5), "area", digits=4)


@query("j33_barycentric", f"WITH {FACES} SELECT f.cloud_id, face_id AS sample_id, round(0.5*a.intensity + 0.25*b.intensity + 0.25*c.intensity, 8) AS intensity FROM f JOIN pts a ON a.cloud_id=f.cloud_id AND a.point_id=v0 JOIN pts b ON b.cloud_id=f.cloud_id AND b.point_id=v1 JOIN pts c ON c.cloud_id=f.cloud_id AND c.point_id=v2")
def _(spark, d):
    f = faces(spark, d)
    corner = f.select("cloud_id", "face_id", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "point_id"))
    corners = corner.join(points(spark, d).select("cloud_id", "point_id", "intensity"), ["cloud_id", "point_id"]).drop("point_id")
    samples = f.select("cloud_id", "face_id", F.col("face_id").alias("sample_id"), F.lit(0.25).alias("u"), F.lit(0.25).alias("v"))
    return rounded(fuse.barycentric(samples, corners, ["intensity"]), "intensity", digits=8)


@query("j23_label_slots", """WITH lb AS (SELECT cloud_id, (x::bigint * 11 + y::bigint) AS vertex_id, point_id AS o, label, instance FROM pts WHERE instance >= 0), s AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, vertex_id ORDER BY o) AS sl FROM lb), k AS (SELECT *, count(*) OVER (PARTITION BY cloud_id, instance) AS sz FROM s WHERE sl <= 3),
 mm AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, vertex_id ORDER BY sz, sl) = 1 AS mn FROM k), q AS (SELECT *, max(CASE WHEN mn THEN sl END) OVER (PARTITION BY cloud_id, vertex_id) AS to_slot FROM mm) SELECT cloud_id, vertex_id, (CASE WHEN mn THEN 1 WHEN sl = 1 THEN to_slot ELSE sl END)::int AS slot, label, instance FROM q""")
def _(spark, d):
    p = points(spark, d).where("instance >= 0").selectExpr("cloud_id", "cast(x as bigint) * 11 + cast(y as bigint) vertex_id", "point_id ord", "label", "instance")
    return fuse.vertex_label_slots(p)


@query("j19_window_pairs", """WITH w AS (SELECT cloud_id, point_id, floor(x/2) wx, floor(y/2) wy, floor(z/2) wz, floor(x/4) dx, floor(y/4) dy, floor(z/4) dz FROM pts),
 a AS (SELECT p.cloud_id, p.point_id FROM w p JOIN w q ON p.cloud_id=q.cloud_id AND p.wx=q.wx AND p.wy=q.wy AND p.wz=q.wz UNION ALL SELECT p.cloud_id, p.point_id FROM w p JOIN w q ON p.cloud_id=q.cloud_id AND p.dx=q.dx AND p.dy=q.dy AND p.dz=q.dz AND q.point_id % 4 = 0 AND NOT (p.wx=q.wx AND p.wy=q.wy AND p.wz=q.wz)) SELECT cloud_id, point_id, count(*) AS n FROM a GROUP BY 1, 2""")
def _(spark, d):
    return voxels.window_pairs(points(spark, d), 2.0, F.col("point_id") % 4 == 0).groupBy("cloud_id", "point_id").agg(F.count("*").alias("n"))


@query("r23_cross_masks", f"WITH c AS (SELECT cloud_id, point_id, (point_id % 2)::int AS view, floor(x/8)::bigint cx, floor(y/4)::bigint cy FROM pts), u AS (SELECT DISTINCT cloud_id, cx, cy FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY {draw_sql(6, 'cloud_id', 'cx', 'cy')}, cx, cy) r, floor(count(*) OVER (PARTITION BY cloud_id)*0.3) n FROM u) SELECT c.cloud_id, point_id, CASE WHEN r <= n THEN 1 WHEN r <= 2*n THEN 2 ELSE 0 END = view + 1 AS masked FROM c JOIN k USING (cloud_id, cx, cy)")
def _(spark, d):
    p = points(spark, d).withColumns({"cx": F.floor(F.col("x") / 8), "cy": F.floor(F.col("y") / 4), "view": (F.col("point_id") % 2).cast("int")})
    return voxels.cross_masks(p, ["cx", "cy"], 0.3, 6).select("cloud_id", "point_id", "masked")


@query("r6_random_rib_drop", f"""WITH n AS (SELECT *, CASE WHEN rib > 12 THEN rib - 12 WHEN rib > 0 THEN rib END AS no FROM pts), pr AS (SELECT cloud_id, count(DISTINCT no) AS pres FROM n GROUP BY 1),
 g AS (SELECT n.*, coalesce(CASE WHEN {draw_sql(62, 'n.cloud_id')} < 0.5 THEN no <= least(floor({draw_sql(61, 'n.cloud_id')}*5), pres) ELSE no > 12 - least(floor({draw_sql(61, 'n.cloud_id')}*5), pres) END, false) AS gone FROM n JOIN pr ON n.cloud_id = pr.cloud_id) SELECT cloud_id, point_id FROM g WHERE NOT gone""")
def _(spark, d):
    return augment.drop_ribs_randomly(points(spark, d), 4, 61).select("cloud_id", "point_id")


@query("r24_depth_filter", "SELECT cloud_id, point_id FROM pts WHERE abs(x*z + y*y + z) / (sqrt(x*x+y*y+z*z)*sqrt(z*z+y*y+1)) > 0.15 AND intensity < 655.35 AND label > 0")
def _(spark, d):
    p = points(spark, d).withColumn("one", F.lit(1.0))
    return voxels.visible(p, "xyz", ["z", "y", "one"], 0.15, (F.col("intensity") < 655.35) & (F.col("label") > 0)).select("cloud_id", "point_id")


@query("c6_select_instances", """WITH sc AS (SELECT DISTINCT cloud_id, instance::bigint AS query, c::int AS class, (instance + 1) * (c + 2) / 24.0 AS score FROM pts, range(2) t(c) WHERE instance >= 0), mk AS (SELECT cloud_id, instance::bigint AS query, point_id, 0.3 + z/16 AS p FROM pts WHERE instance >= 0),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY score DESC, query, class) r FROM sc) WHERE r <= 8), i AS (SELECT cloud_id, query, avg(p) m, count(*) points FROM mk WHERE p > 0.5 GROUP BY 1, 2) SELECT b.cloud_id, b.query, class, round(score*m, 6) AS score, points FROM b JOIN i ON b.cloud_id=i.cloud_id AND b.query=i.query WHERE score*m >= 0.1 AND points >= 5""")
def _(spark, d):
    p = points(spark, d).where("instance >= 0")
    s = p.select("cloud_id", F.col("instance").cast("bigint").alias("query")).distinct().withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(1))))
    s = s.withColumn("score", (F.col("query") + 1) * (F.col("class") + 2) / 24.0)
    masks = p.select("cloud_id", F.col("instance").cast("bigint").alias("query"), "point_id", (0.3 + F.col("z") / 16).alias("p"))
    return rounded(cluster.select_instances(s, masks, 8, 0.1, 5).drop("rank"), "score")
