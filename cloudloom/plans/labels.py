"""Queries of sources, splits, label tables, frames and staged predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions.random import draw, draw_sql
from cloudloom.operators import fuse
from cloudloom.operators.cloud import per_cloud
from cloudloom.plans.catalog import query
from cloudloom.plans.geometry import rounded
from cloudloom.sources.fixtures import frames, points, read


def clouds(spark, d):
    return read(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("cloud_id"))


SPLIT = "CASE WHEN s_suppkey % 10 < 8 THEN 'train' WHEN s_suppkey % 10 = 8 THEN 'val' ELSE 'test' END"


@query("s6_split_listing", f"SELECT s_suppkey::bigint AS cloud_id, {SPLIT} AS split FROM supplier")
def _(spark, d):
    k = F.col("cloud_id") % 10
    return clouds(spark, d).withColumn("split", F.when(k < 8, "train").when(k == 8, "val").otherwise("test"))


@query("s7_labelled_subset", "SELECT cloud_id, point_id, (CASE WHEN point_id % 50 = 0 THEN label ELSE -1 END)::int AS label FROM pts")
def _(spark, d):
    p = points(spark, d)
    return fuse.keep_labelled(p, p.where("point_id % 50 = 0")).select("cloud_id", "point_id", "label")


@query("s8_s9_s11_evaluation_set", "SELECT DISTINCT cloud_id FROM pts WHERE (cloud_id % 10 = 9 OR cloud_id IN (SELECT cloud_id FROM pts GROUP BY 1 HAVING count(DISTINCT rib_pred) < 25)) AND cloud_id NOT IN (9, 19)")
def _(spark, d):
    p = points(spark, d)
    excluded = spark.createDataFrame([(9,), (19,)], "cloud_id bigint")
    return fuse.evaluation_set(p.where("cloud_id % 10 = 9"), fuse.incomplete(p, "rib_pred", 25), excluded)


@query("s10_incomplete", "SELECT cloud_id, count(DISTINCT instance) AS classes FROM pts WHERE z < 2 AND x > 40 GROUP BY 1 HAVING count(DISTINCT instance) < 7")
def _(spark, d):
    return fuse.incomplete(points(spark, d).where("z < 2 and x > 40"), "instance", 7)


@query("s12_ratio_split", f"WITH k AS (SELECT s_suppkey::bigint AS cloud_id, row_number() OVER (ORDER BY {draw_sql(12, 's_suppkey')}, s_suppkey) AS r, count(*) OVER () AS n FROM supplier) SELECT cloud_id, CASE WHEN r <= round(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM k")
def _(spark, d):
    return fuse.split_by_ratio(clouds(spark, d), "cloud_id", 0.2, draw(12, "cloud_id"))


@query("s13_s14_weighted_union", "SELECT s_suppkey::bigint AS cloud_id, p::int AS pass, 0 AS source FROM supplier, range(2) t(p) WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey::bigint, p::int, 1 FROM supplier, range(3) t(p) WHERE s_suppkey % 2 = 1")
def _(spark, d):
    c = clouds(spark, d)
    return fuse.weighted_union([(c.where("cloud_id % 2 = 0"), 2), (c.where("cloud_id % 2 = 1"), 3)])


@query("s15_shards", "SELECT s_suppkey::bigint AS cloud_id, ((row_number() OVER (ORDER BY s_suppkey) - 1) % 7)::int AS shard FROM supplier")
def _(spark, d):
    return fuse.shard(clouds(spark, d), "cloud_id", 7)


@query("s16_s17_integral", "SELECT cloud_id, bool_and(intensity = round(intensity)) AS whole, min(intensity) AS least, max(intensity) AS most FROM pts GROUP BY 1")
def _(spark, d):
    return fuse.integral(points(spark, d), "intensity")


@query("s18_resume", "SELECT DISTINCT cloud_id FROM pts WHERE cloud_id % 3 <> 0")
def _(spark, d):
    p = points(spark, d)
    return fuse.still_to_do(p, p.where("cloud_id % 3 = 0"))


@query("s20_underfilled", "SELECT cloud_id, count(*) AS n FROM pts GROUP BY 1 HAVING count(*) < 590")
def _(spark, d):
    return fuse.underfilled(points(spark, d), 590)


@query("s22_inverse_map", "SELECT cloud_id, point_id, CASE pred WHEN 0 THEN 40 WHEN 1 THEN 48 WHEN 3 THEN 70 ELSE 0 END AS code FROM pts")
def _(spark, d):
    from cloudloom.operators.scalar import remap

    return points(spark, d).select("cloud_id", "point_id", remap("pred", {0: 40, 1: 48, 3: 70}, 0).alias("code"))


@query("s23_run_lengths", "WITH g AS (SELECT cloud_id, instance, point_id, point_id - row_number() OVER (PARTITION BY cloud_id, instance ORDER BY point_id) AS g FROM pts WHERE instance >= 0), r AS (SELECT cloud_id, instance, g, min(point_id) s, count(*) n FROM g GROUP BY ALL) SELECT cloud_id, instance, string_agg(s || ' ' || n, ' ' ORDER BY s) AS rle FROM r GROUP BY 1, 2")
def _(spark, d):
    return fuse.run_lengths(points(spark, d).where("instance >= 0"), "instance")


@query("s24_json_records", "SELECT event_id::bigint AS event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return read(spark, d, "events").select(F.col("event_id").cast("bigint").alias("event_id"), F.from_json("props", "k bigint")["k"].alias("k"))


@query("s25_pair_threshold", "WITH v AS (SELECT DISTINCT cloud_id // 20 AS s, cloud_id AS c, floor(x/8) i, floor(y/4) j FROM pts), p AS (SELECT a.s, a.c AS a, b.c AS b, count(*) AS n FROM v a JOIN v b ON a.s = b.s AND a.c < b.c AND a.i = b.i AND a.j = b.j GROUP BY ALL) SELECT a, b, n FROM p WHERE n > 18")
def _(spark, d):
    v = points(spark, d).select(F.floor(F.col("cloud_id") / 20).alias("s"), F.col("cloud_id").alias("c"), F.floor(F.col("x") / 8).alias("i"), F.floor(F.col("y") / 4).alias("j")).distinct()
    pairs = v.join(v.withColumnRenamed("c", "d"), ["s", "i", "j"]).where("c < d").groupBy(F.col("c").alias("a"), F.col("d").alias("b")).agg(F.count("*").alias("n"))
    return fuse.over_threshold(pairs, "n", 18)


@query("s26_fill_cache", "WITH g AS (SELECT cloud_id, x, y, z, max(rib_pred) AS aux FROM pts WHERE point_id % 2 = 0 GROUP BY ALL) SELECT p.cloud_id, round(avg((coalesce(aux, 0) BETWEEN 1 AND 24)::int), 9) AS rib_fraction, count(*) FILTER (aux IS NULL) AS missing FROM pts p LEFT JOIN g ON p.cloud_id=g.cloud_id AND p.x=g.x AND p.y=g.y AND p.z=g.z GROUP BY 1 ORDER BY rib_fraction, cloud_id LIMIT 10")
def _(spark, d):
    p = points(spark, d)
    g = p.where("point_id % 2 = 0").groupBy("cloud_id", "x", "y", "z").agg(F.max("rib_pred").alias("aux"))
    out = p.join(g, ["cloud_id", "x", "y", "z"], "left").groupBy("cloud_id").agg(F.round(F.avg(F.coalesce("aux", F.lit(0)).between(1, 24).cast("int")), 9).alias("rib_fraction"), F.count_if(F.col("aux").isNull()).alias("missing"))
    return out.orderBy("rib_fraction", "cloud_id").limit(10)


KINDS = [("STANDARD", 1), ("SMALL", 2), ("LARGE", 3)]


@query("p17_p18_taxonomy", "WITH t AS (SELECT p_partkey::bigint AS part, p_type, CASE WHEN p_type LIKE 'STANDARD%' THEN 1 WHEN p_type LIKE 'SMALL%' THEN 2 WHEN p_type LIKE 'LARGE%' THEN 3 ELSE 0 END AS coarse FROM part) SELECT part, coarse, row_number() OVER (ORDER BY coarse, part)::int AS fine FROM t")
def _(spark, d):
    named = read(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("part"), "p_type")
    return fuse.fine_ids(fuse.by_prefix(named, KINDS, "p_type", "coarse"), "coarse", "part").select("part", "coarse", "fine")


@query("p11_p12_p13_lookups", "SELECT n_nationkey::bigint AS nation, coalesce(r_name, 'clutter') AS region FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON n_regionkey = r_regionkey")
def _(spark, d):
    r = read(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return read(spark, d, "nation").join(r, "n_regionkey", "left").select(F.col("n_nationkey").cast("bigint").alias("nation"), F.coalesce("r_name", F.lit("clutter")).alias("region"))


@query("p14_filter_map", "SELECT cloud_id, point_id, CASE rib WHEN 1 THEN 101 WHEN 2 THEN 102 ELSE rib END::int AS rib FROM pts WHERE rib <> 3")
def _(spark, d):
    table = spark.createDataFrame([(1, 101, 0), (1, 999, 1), (2, 102, 2), (3, None, 3)], "src int, dst int, ord int")
    return fuse.map_classes(points(spark, d), table, "rib").select("cloud_id", "point_id", "rib")


@query("p20_p21_combine_labels", "SELECT cloud_id, point_id, CASE WHEN l > 0 THEN l ELSE CASE p WHEN 5 THEN 30 WHEN 6 THEN 31 ELSE 0 END END AS combined FROM (SELECT cloud_id, point_id, CASE WHEN rib IN (2, 4) THEN 0 ELSE rib END AS l, rib_pred AS p FROM pts)")
def _(spark, d):
    p = points(spark, d).withColumn("manual", fuse.suppress("rib", [2, 4]))
    return p.select("cloud_id", "point_id", fuse.combine_labels("manual", "rib_pred", {5: 30, 6: 31}).alias("combined"))


@query("j20_sweeps", "SELECT seq_id, frame_id, coalesce(lag(frame_id) OVER w, frame_id) AS sweep1, coalesce(lag(frame_id, 2) OVER w, lag(frame_id) OVER w, frame_id) AS sweep2, (day - coalesce(lag(day) OVER w, day))::int AS lag1, (day - coalesce(lag(day, 2) OVER w, lag(day) OVER w, day))::int AS lag2 FROM frames WINDOW w AS (PARTITION BY seq_id ORDER BY frame_idx)")
def _(spark, d):
    return fuse.sweeps(frames(spark, d), 2).select("seq_id", "frame_id", "sweep1", "sweep2", "lag1", "lag2")


@query("j21_fuse_frames", """SELECT a.seq_id, a.frame_id, o AS "offset", b.frame_id AS ref_id, round((b.tx - a.tx)*cos(radians(-a.yaw_deg)), 6) + 0.0 AS dx, round((b.tx - a.tx)*sin(radians(-a.yaw_deg)), 6) + 0.0 AS dy, b.yaw_deg - a.yaw_deg AS dyaw FROM frames a, (VALUES (-1), (-3), (2)) t(o), frames b WHERE b.seq_id = a.seq_id AND b.frame_idx = a.frame_idx + o""")
def _(spark, d):
    return rounded(fuse.fuse_frames(frames(spark, d), [-1, -3, 2]), "dx", "dy")


@query("j22_segment_labels", "WITH g AS (SELECT cloud_id, instance AS o, max(label) AS gl, list(DISTINCT x::int) AS segs FROM pts WHERE instance >= 0 GROUP BY 1, 2), e AS (SELECT cloud_id, o, gl, unnest(segs) AS seg FROM g), l AS (SELECT cloud_id, seg, arg_max(gl, o) AS gl FROM e GROUP BY 1, 2) SELECT p.cloud_id, point_id, coalesce(gl, -1)::int AS group_label FROM pts p LEFT JOIN l ON p.cloud_id = l.cloud_id AND p.x::int = l.seg")
def _(spark, d):
    p = points(spark, d).withColumn("seg", F.col("x").cast("int"))
    g = p.where("instance >= 0").groupBy("cloud_id", F.col("instance").alias("ord")).agg(F.max("label").alias("label"), F.collect_set("seg").alias("segments"))
    return fuse.segment_labels(p, g, "seg").select("cloud_id", "point_id", F.col("group_label").cast("int").alias("group_label"))


@query("j26_combine", "SELECT cloud_id, point_id, (CASE WHEN pred > 0 AND point_id % 9 <> 0 THEN rib_pred ELSE 0 END)::int AS pred, (pred > 0)::int AS fg FROM pts")
def _(spark, d):
    p = points(spark, d)
    first = p.withColumn("pred", (F.col("pred") > 0).cast("int"))
    second = p.where("pred > 0 and point_id % 9 <> 0").withColumn("pred", F.col("rib_pred"))
    return fuse.combine_stages(p.select("cloud_id", "point_id"), first, second).select("cloud_id", "point_id", "pred", "fg")


@query("j26_faults", "SELECT 0::bigint AS cache_only, 0::bigint AS first_only, 0::bigint AS second_only, (SELECT count(*) FROM pts WHERE NOT (pred > 0) AND point_id % 100 = 0) AS second_in_background")
def _(spark, d):
    p = points(spark, d)
    first = p.withColumn("pred", (F.col("pred") > 0).cast("int"))
    return fuse.stage_faults(p, first, p.where("pred > 0 or point_id % 100 = 0"))


FACES = "f AS (SELECT cloud_id, point_id AS face_id, point_id AS v0, point_id + 1 AS v1, point_id + 2 AS v2, label FROM (SELECT *, count(*) OVER (PARTITION BY cloud_id) AS own FROM pts) WHERE point_id % 2 = 1 AND point_id + 2 <= own)"


def faces(spark, d):
    """A strip of faces over all points of each cloud: every other point begins one with the two after it."""
    p = points(spark, d).withColumn("own", F.count("*").over(per_cloud()))
    return p.where((F.col("point_id") % 2 == 1) & (F.col("point_id") + 2 <= F.col("own"))).selectExpr("cloud_id", "point_id face_id", "point_id v0", "point_id + 1 v1", "point_id + 2 v2", "label")


@query("a9_face_normals", f"WITH {FACES} SELECT f.cloud_id, face_id, (b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y) + 0.0 AS nx, (b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z) + 0.0 AS ny, (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) + 0.0 AS nz FROM f JOIN pts a ON a.cloud_id=f.cloud_id AND a.point_id=v0 JOIN pts b ON b.cloud_id=f.cloud_id AND b.point_id=v1 JOIN pts c ON c.cloud_id=f.cloud_id AND c.point_id=v2")
def _(spark, d):
    v = points(spark, d).withColumnRenamed("point_id", "vertex_id")
    n = fuse.face_normals(faces(spark, d), v)
    return n.select("cloud_id", "face_id", *[(F.col(c) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


@query("a9_vertex_normals", f"""WITH {FACES}, n AS (SELECT f.cloud_id, v0, v1, v2, (b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y) AS nx, (b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z) AS ny, (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) AS nz FROM f JOIN pts a ON a.cloud_id=f.cloud_id AND a.point_id=v0 JOIN pts b ON b.cloud_id=f.cloud_id AND b.point_id=v1 JOIN pts c ON c.cloud_id=f.cloud_id AND c.point_id=v2),
 s AS (SELECT cloud_id, vertex_id, sum(nx) nx, sum(ny) ny, sum(nz) nz FROM (SELECT cloud_id, unnest([v0, v1, v2]) AS vertex_id, nx, ny, nz FROM n) GROUP BY 1, 2) SELECT cloud_id, vertex_id, round(nx/(sqrt(nx*nx+ny*ny+nz*nz)+1e-8), 6) + 0.0 AS nx, round(ny/(sqrt(nx*nx+ny*ny+nz*nz)+1e-8), 6) + 0.0 AS ny, round(nz/(sqrt(nx*nx+ny*ny+nz*nz)+1e-8), 6) + 0.0 AS nz FROM s""")
def _(spark, d):
    v = points(spark, d).withColumnRenamed("point_id", "vertex_id")
    out = rounded(fuse.vertex_normals(fuse.face_normals(faces(spark, d), v)), "nx", "ny", "nz")
    return out.withColumns({c: F.col(c) + 0.0 for c in ("nx", "ny", "nz")})


@query("a10_vertex_majority", f"WITH {FACES}, e AS (SELECT cloud_id, unnest([v0, v1, v2]) AS vertex_id, label FROM f), c AS (SELECT cloud_id, vertex_id, label, count(*) n FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, vertex_id ORDER BY n DESC, label) r FROM c) SELECT cloud_id, vertex_id, (label - 1)::int AS label FROM k WHERE r = 1")
def _(spark, d):
    return fuse.vertex_majority(faces(spark, d), "label").withColumn("label", F.col("label").cast("int"))


@query("u1_u7_set_operations", "WITH a AS (SELECT DISTINCT cloud_id, rib AS c FROM pts WHERE z > 5), b AS (SELECT DISTINCT cloud_id, rib_pred AS c FROM pts WHERE z <= 5) SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'bag', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def _(spark, d):
    p = points(spark, d)
    a, b = p.where("z > 5").select("cloud_id", F.col("rib").alias("c")).distinct(), p.where("z <= 5").select("cloud_id", F.col("rib_pred").alias("c")).distinct()
    parts = {"both": a.intersect(b), "only": a.exceptAll(b), "any": a.union(b).distinct(), "bag": a.unionByName(b)}
    out = None
    for kind, df in parts.items():
        one = df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
