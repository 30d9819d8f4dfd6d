"""Queries of neighbourhoods, clusters and instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions.random import draw_sql
from cloudloom.functions.tables import materialise
from cloudloom.operators import cluster, farthest
from cloudloom.operators import neighbors as nb
from cloudloom.operators.spacetree import neighbour_lists
from cloudloom.plans.catalog import ORACLE_SQL, query
from cloudloom.plans.geometry import rounded
from cloudloom.sources.fixtures import points

D2 = "((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
KNN = f"kn AS (SELECT a.cloud_id, a.point_id AS src, b.point_id AS dst, {D2} AS d2, row_number() OVER (PARTITION BY a.cloud_id, a.point_id ORDER BY {D2}, b.point_id) AS rank FROM pts a JOIN pts b ON a.cloud_id = b.cloud_id), k4 AS (SELECT * FROM kn WHERE rank <= 4)"
BALL = f"ba AS (SELECT a.cloud_id, a.point_id AS src, b.point_id AS dst, {D2} AS d2 FROM pts a JOIN pts b ON a.cloud_id = b.cloud_id AND {D2} < 2.25)"


def knn4(spark, d):
    p = points(spark, d)
    return p, nb.knn(p, p, 4)


@query("j1_knn", f"WITH {KNN} SELECT cloud_id, src, dst, d2, rank::int AS rank FROM k4")
def _(spark, d):
    return knn4(spark, d)[1]


@query("j2_feature_knn", "WITH e AS (SELECT vec_id % 10 AS cloud_id, vec_id AS v, embedding::double[] AS f FROM embeddings), k AS (SELECT a.cloud_id, a.v AS src, b.v AS dst, row_number() OVER (PARTITION BY a.v ORDER BY round(list_sum(list_transform(list_zip(a.f, b.f), lambda p: (p[1]-p[2])*(p[1]-p[2]))), 9), b.v) AS rank FROM e a JOIN e b ON a.cloud_id = b.cloud_id) SELECT cloud_id, src, dst, rank::int AS rank FROM k WHERE rank <= 5")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") % 10).alias("cloud_id"), F.col("vec_id").alias("point_id"), F.col("embedding").alias("feat"))
    return nb.feature_knn(e, 5)


@query("j3_j5_radius", f"WITH {BALL} SELECT cloud_id, src, count(*) AS n, sum(dst)::bigint AS ids, sum(d2) AS total FROM ba GROUP BY 1, 2")
def _(spark, d):
    p = points(spark, d)
    return nb.radius_edges(p, p, 1.5).groupBy("cloud_id", "src").agg(F.count("*").alias("n"), F.sum("dst").alias("ids"), F.sum("d2").alias("total"))


@query("j3_ball_query", f"""WITH {BALL}, r AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, src ORDER BY d2, dst) - 1 AS r, count(*) OVER (PARTITION BY cloud_id, src) AS n FROM ba),
 s AS (SELECT cloud_id, src, i::int + 1 AS rank, CASE WHEN n <= 3 THEN i ELSE floor(i*n/3)::bigint END AS want, n FROM (SELECT DISTINCT cloud_id, src, n FROM r), range(3) t(i) WHERE i < n) SELECT s.cloud_id, s.src, r.dst, s.rank, r.d2 FROM s JOIN r ON r.cloud_id = s.cloud_id AND r.src = s.src AND r.r = s.want""")
def _(spark, d):
    p = points(spark, d)
    return nb.ball_query(p, p, 3, 1.5).select("cloud_id", "src", "dst", "rank", "d2")


@query("j6_match_within", f"WITH q AS (SELECT * FROM pts WHERE label = 0), t AS (SELECT * FROM pts WHERE label = 3), k AS (SELECT a.cloud_id, a.point_id AS src, b.point_id AS dst, {D2} AS d2, row_number() OVER (PARTITION BY a.cloud_id, a.point_id ORDER BY {D2}, b.point_id) AS rk FROM q a JOIN t b ON a.cloud_id = b.cloud_id) SELECT cloud_id, src, dst, d2 FROM k WHERE rk = 1 AND d2 <= 4")
def _(spark, d):
    p = points(spark, d)
    return nb.match_within(nb.knn(p.where("label = 0"), p.where("label = 3"), 1), 2.0).select("cloud_id", "src", "dst", "d2")


@query("j8_skeleton", f"WITH s AS (SELECT * FROM pts WHERE point_id % 20 = 0 AND instance >= 0), k AS (SELECT a.cloud_id, a.point_id, b.point_id AS sk, row_number() OVER (PARTITION BY a.cloud_id, a.point_id ORDER BY {D2}, b.point_id) AS rk FROM pts a JOIN s b ON a.cloud_id = b.cloud_id AND a.instance = b.instance) SELECT p.cloud_id, p.point_id, coalesce(sk, -1) AS skeleton_id FROM pts p LEFT JOIN k ON p.cloud_id = k.cloud_id AND p.point_id = k.point_id AND rk = 1")
def _(spark, d):
    p = points(spark, d)
    return nb.nearest_skeleton(p, p.where("point_id % 20 = 0 and instance >= 0"))


@query("j10_relative", f"WITH {KNN} SELECT k.cloud_id, src, dst, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM k4 k JOIN pts a ON a.cloud_id = k.cloud_id AND a.point_id = src JOIN pts b ON b.cloud_id = k.cloud_id AND b.point_id = dst")
def _(spark, d):
    p, e = knn4(spark, d)
    return nb.relative(e, p, p).select("cloud_id", "src", "dst", "dx", "dy", "dz")


@query("j12_dilated", f"WITH {KNN} SELECT cloud_id, src, dst, ((rank - 1) / 2 + 1)::int AS rank FROM kn WHERE rank <= 5 AND (rank - 1) % 2 = 0")
def _(spark, d):
    p = points(spark, d)
    return nb.dilated(nb.knn(p, p, 5), 3, 1).select("cloud_id", "src", "dst", "rank")


@query("j13_interpolate", f"WITH {KNN} SELECT k.cloud_id, src, round(sum(intensity/(sqrt(d2)+0.001))/sum(1/(sqrt(d2)+0.001)), 4) AS intensity FROM k4 k JOIN pts b ON b.cloud_id = k.cloud_id AND b.point_id = dst GROUP BY 1, 2")
def _(spark, d):
    p, e = knn4(spark, d)
    return rounded(nb.interpolate(e, p, "intensity", 0.001), "intensity", digits=4)


@query("j14_differences", f"WITH {KNN} SELECT k.cloud_id, src, dst, round(b.intensity - a.intensity, 5) + 0.0 AS difference FROM k4 k JOIN pts a ON a.cloud_id = k.cloud_id AND a.point_id = src JOIN pts b ON b.cloud_id = k.cloud_id AND b.point_id = dst")
def _(spark, d):
    p, e = knn4(spark, d)
    return rounded(nb.differences(e, p, "intensity").select("cloud_id", "src", "dst", "difference"), "difference", digits=5)


@query("j15_weighted_sum", f"WITH {KNN} SELECT k.cloud_id, src, round(sum((floor(intensity) + 1)/rank), 6) AS intensity FROM k4 k JOIN pts b ON b.cloud_id = k.cloud_id AND b.point_id = dst GROUP BY 1, 2")
def _(spark, d):
    p, e = knn4(spark, d)
    return rounded(nb.weighted_sum(e, p.withColumn("intensity", F.floor("intensity")), "intensity", 1 / F.col("rank"), 1.0), "intensity", digits=6)


@query("j16_attention", f"WITH {KNN}, s AS (SELECT k.cloud_id, src, exp(a.y*b.z/10) AS ex, b.x AS v FROM k4 k JOIN pts a ON a.cloud_id = k.cloud_id AND a.point_id = src JOIN pts b ON b.cloud_id = k.cloud_id AND b.point_id = dst) SELECT cloud_id, src, round(sum(ex*v)/sum(ex), 5) AS fused FROM s GROUP BY 1, 2")
def _(spark, d):
    p, e = knn4(spark, d)
    return rounded(nb.attention(e, p.withColumn("q", F.col("y") / 10), "q", "z", "x"), "fused", digits=5)


@query("j1_r19_leaves", f"WITH {KNN} SELECT cloud_id, src, dst, d2, rank::int AS rank FROM k4")
def _(spark, d):
    p = points(spark, d)
    return nb.exploded(neighbour_lists(p, p, 4, leaf=64))


@query("r19_outliers", f"WITH {KNN}, m AS (SELECT cloud_id, src, avg(sqrt(d2)) AS dm FROM k4 GROUP BY 1, 2), l AS (SELECT cloud_id, avg(dm) + 1.0*stddev_samp(dm) AS lim FROM m GROUP BY 1) SELECT m.cloud_id, src AS point_id FROM m JOIN l ON m.cloud_id = l.cloud_id WHERE dm > 0 AND dm < lim")
def _(spark, d):
    p, e = knn4(spark, d)
    return nb.statistical_outliers(p, e, 1.0).select("cloud_id", "point_id")


@query("j30_partitions", f"WITH {BALL} SELECT cloud_id, CASE WHEN sqrt(d2) <= 0.5 THEN 0 WHEN sqrt(d2) <= 1.2 THEN CASE WHEN dst > src THEN 1 ELSE 2 END WHEN dst > src THEN 3 ELSE 4 END::int AS part, count(*) AS n FROM ba GROUP BY 1, 2")
def _(spark, d):
    p = points(spark, d)
    e = nb.distance_partitions(nb.radius_edges(p, p, 1.5), 0.5, 1.2, F.col("dst") - F.col("src"))
    return e.groupBy("cloud_id", "part").agg(F.count("*").alias("n"))


@query("j31_pair_mining", f"""WITH a0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, label ORDER BY {draw_sql(31, 'cloud_id', 'point_id')}, point_id) AS dr FROM pts) WHERE dr <= 2), p AS (SELECT b.cloud_id, b.point_id AS anchor, a.point_id, a.label = b.label AS positive, {D2} AS d2 FROM pts a JOIN a0 b ON a.cloud_id = b.cloud_id AND a.point_id <> b.point_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, anchor, positive ORDER BY CASE WHEN positive THEN -d2 ELSE d2 END, point_id) AS rank FROM p), t AS (SELECT *, count(*) FILTER (rank = 1) OVER (PARTITION BY cloud_id, anchor) AS kinds FROM r) SELECT cloud_id, anchor, point_id, positive, d2, rank::int AS rank FROM t WHERE rank <= 3 AND kinds = 2""")
def _(spark, d):
    p = points(spark, d)
    return nb.mine_pairs(p, nb.drawn_anchors(p, 2, 31), 3)


@query("j31_mining_by_boxes", ORACLE_SQL["j31_pair_mining"])
def _(spark, d):
    p = points(spark, d)
    return nb.mine_pairs_by_boxes(p, nb.drawn_anchors(p, 2, 31), 3, leaf=64)


@query("j8_skeleton_by_leaves", ORACLE_SQL["j8_skeleton"])
def _(spark, d):
    p = points(spark, d)
    return nb.nearest_skeleton_by_leaves(p, p.where("point_id % 20 = 0 and instance >= 0"))


@query("j28_j29_overlap", """WITH v AS (SELECT cloud_id // 5 AS scene, cloud_id AS frame, floor(x/4) vx, floor(y/4) vy, floor(z/4) vz, avg(x) x, avg(y) y, avg(z) z FROM pts GROUP BY ALL), n AS (SELECT scene, frame, count(*) n FROM v GROUP BY ALL),
 h AS (SELECT a.scene, a.frame fa, b.frame fb, count(DISTINCT (a.vx, a.vy, a.vz)) h FROM v a JOIN v b ON a.scene = b.scene AND a.frame <> b.frame AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 4 GROUP BY ALL)
 SELECT h.scene, least(fa, fb) AS a, greatest(fa, fb) AS b, round(max(h/n), 6) AS overlap FROM h JOIN n ON h.scene = n.scene AND h.fa = n.frame GROUP BY ALL""")
def _(spark, d):
    f = points(spark, d).select(F.floor(F.col("cloud_id") / 5).alias("scene"), F.col("cloud_id").alias("frame"), "x", "y", "z")
    return rounded(nb.overlap_ratios(f, 4.0, 0.5), "overlap")


def _components_sql(label: str, rows: str) -> str:
    """Clusters cl (cloud_id, point_id, root, cluster) of five points or more: the least point that each point reaches."""
    return f"""nd AS (SELECT cloud_id, point_id, x, y, z, {label} AS l FROM pts WHERE {rows}), eg AS (SELECT a.cloud_id, a.point_id AS src, b.point_id AS dst FROM nd a JOIN nd b ON a.cloud_id = b.cloud_id AND a.l = b.l AND a.point_id <> b.point_id AND {D2} < 2.25),
 cc AS (WITH RECURSIVE r(cloud_id, point_id, root) USING KEY (cloud_id, point_id) AS (SELECT cloud_id, point_id, point_id FROM nd UNION (SELECT eg.cloud_id, eg.dst, min(r.root) FROM r JOIN eg ON eg.cloud_id = r.cloud_id AND eg.src = r.point_id JOIN recurring.r AS o ON o.cloud_id = eg.cloud_id AND o.point_id = eg.dst WHERE r.root < o.root GROUP BY 1, 2)) SELECT * FROM r),
 cl AS (SELECT *, (dense_rank() OVER (PARTITION BY cloud_id ORDER BY root) - 1)::int AS cluster FROM (SELECT *, count(*) OVER (PARTITION BY cloud_id, root) AS sz FROM cc) WHERE sz >= 5)"""


@query("c1_components", f"WITH {_components_sql('label', 'label > 0')} SELECT cloud_id, cluster, count(*) AS n, min(point_id) AS first FROM cl GROUP BY 1, 2")
def _(spark, d):
    p = points(spark, d).where("label > 0")
    return cluster.label_components(p, 1.5, 5).groupBy("cloud_id", "cluster").agg(F.count("*").alias("n"), F.min("point_id").alias("first"))


@query("c2_proposals", f"WITH {_components_sql('pred', 'pred > 0')} SELECT cl.cloud_id, cluster, arg_min(pred, cl.point_id) AS class, round(avg(0.5 + z/20), 6) AS score, count(*) AS n FROM cl JOIN pts p ON p.cloud_id = cl.cloud_id AND p.point_id = cl.point_id GROUP BY 1, 2")
def _(spark, d):
    p = points(spark, d).where("pred > 0").withColumn("score", 0.5 + F.col("z") / 20)
    return rounded(cluster.proposals(cluster.label_components(p, 1.5, 5, label="pred"), "pred", "score"), "score")


@query("c5_matrix_nms", """WITH mk AS (SELECT cloud_id, instance::bigint AS inst_id, point_id FROM pts WHERE instance >= 0 UNION ALL SELECT cloud_id, instance + 10, point_id FROM pts WHERE instance >= 0 AND z > 3), i AS (SELECT DISTINCT cloud_id, inst_id, (inst_id % 2)::int AS class, 1 - inst_id/20 AS score FROM mk),
 bt AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY score DESC, inst_id) AS r FROM i QUALIFY r <= 50), m AS (SELECT mk.*, class, r FROM mk JOIN bt ON bt.cloud_id = mk.cloud_id AND bt.inst_id = mk.inst_id), sz AS (SELECT cloud_id, r, count(*) AS n FROM m GROUP BY 1, 2),
 it AS (SELECT a.cloud_id, a.r, b.r AS q, count(*) AS n FROM m a JOIN m b ON a.cloud_id = b.cloud_id AND a.point_id = b.point_id AND a.class = b.class AND b.r < a.r GROUP BY 1, 2, 3), iu AS (SELECT it.cloud_id, it.r, it.q, it.n/(s1.n + s2.n - it.n) AS u FROM it JOIN sz s1 ON s1.cloud_id = it.cloud_id AND s1.r = it.r JOIN sz s2 ON s2.cloud_id = it.cloud_id AND s2.r = it.q),
 cp AS (SELECT cloud_id, r AS q, max(u) AS c FROM iu GROUP BY 1, 2), dc AS (SELECT iu.cloud_id, iu.r, min(coalesce((1-u)/nullif(1-coalesce(c, 0), 0), 1)) AS d FROM iu LEFT JOIN cp ON cp.cloud_id = iu.cloud_id AND cp.q = iu.q GROUP BY 1, 2),
 o AS (SELECT bt.cloud_id, inst_id, class, score * least(coalesce(d, 1), 1) AS score FROM bt LEFT JOIN dc ON dc.cloud_id = bt.cloud_id AND dc.r = bt.r) SELECT cloud_id, inst_id, class, round(score, 6) AS score, row_number() OVER (PARTITION BY cloud_id ORDER BY score DESC, inst_id)::int AS rank FROM o WHERE score >= 0.05 QUALIFY rank <= 100""")
def _(spark, d):
    p = points(spark, d)
    masks = p.where("instance >= 0").select("cloud_id", F.col("instance").cast("bigint").alias("inst_id"), "point_id").unionByName(
        p.where("instance >= 0 and z > 3").select("cloud_id", (F.col("instance") + 10).cast("bigint").alias("inst_id"), "point_id")
    )
    inst = masks.select("cloud_id", "inst_id").distinct().withColumns({"class": (F.col("inst_id") % 2).cast("int"), "score": 1.0 - F.col("inst_id") / 20})
    return rounded(cluster.matrix_nms(inst, masks, 50, 0.05, 100), "score")


@query("c8_relabel")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.lit(0).cast("bigint").alias("cloud_id"), F.col("vec_id").alias("point_id"), (F.col("vec_id") % 12).alias("cluster"), "label")
    return cluster.best_assignment(e, "cluster", "label")


def _sides_sql(rounds: int = 8) -> str:
    """The rounds of 2-means as common table expressions, one for each."""
    steps = ["s0 AS (SELECT *, min(cx) OVER w AS a, max(cx) OVER w AS b, median(cx) OVER w AS med, count(*) OVER w AS n, true AS m FROM inst WINDOW w AS (PARTITION BY cloud_id))"]
    for k in range(rounds):
        steps.append(f"m{k} AS (SELECT * EXCLUDE (m), coalesce(abs(cx-a) <= abs(cx-b), false) AS m FROM s{k}), c{k} AS (SELECT *, count(*) FILTER (m) OVER (PARTITION BY cloud_id) AS k FROM m{k}), f{k} AS (SELECT * EXCLUDE (m, k), CASE WHEN k = 0 OR k = n THEN cx <= med ELSE m END AS m FROM c{k})")
        steps.append(f"s{k + 1} AS (SELECT * EXCLUDE (a, b), avg(cx) FILTER (m) OVER (PARTITION BY cloud_id) AS a, avg(cx) FILTER (NOT m) OVER (PARTITION BY cloud_id) AS b FROM f{k})")
    return ", ".join(steps)


@query("c9_anatomical", f"""WITH inst AS (SELECT cloud_id, rib AS instance, avg(x) AS cx, avg(intensity) AS ci FROM pts WHERE rib > 0 GROUP BY 1, 2), {_sides_sql()}, r AS (SELECT *, CASE WHEN coalesce(b > a, true) THEN m ELSE NOT m END AS rgt FROM s8),
 k AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, rgt ORDER BY ci DESC, instance DESC) AS rk FROM r) SELECT cloud_id, instance, (rk + CASE WHEN rgt THEN 12 ELSE 0 END)::int AS rib FROM k WHERE rk <= 12""")
def _(spark, d):
    inst = points(spark, d).where("rib > 0").groupBy("cloud_id", F.col("rib").alias("instance")).agg(F.avg("x").alias("cx"), F.avg("intensity").alias("ci"))
    return cluster.anatomical_labels(inst, "cx", "ci")


def farthest_sql(n: int) -> str:
    """Farthest points fp (cloud_id, point_id, rank): every step keeps each point's least distance to those chosen."""
    step = "(x-px)*(x-px) + (y-py)*(y-py) + (z-pz)*(z-pz)"
    return f"""fp AS (WITH RECURSIVE f(cloud_id, point_id, x, y, z, n, d2, step, pick) AS (SELECT cloud_id, point_id, x, y, z, n, {step}, 1, pick FROM (SELECT *, count(*) OVER w AS n, min(point_id) OVER w AS pick, arg_min(x, point_id) OVER w AS px, arg_min(y, point_id) OVER w AS py, arg_min(z, point_id) OVER w AS pz FROM pts WINDOW w AS (PARTITION BY cloud_id)) UNION ALL
 SELECT cloud_id, point_id, x, y, z, n, least(d2, {step}), step + 1, pick FROM (SELECT cloud_id, point_id, x, y, z, n, d2, step, arg_max(point_id, (d2, -point_id)) OVER w AS pick, arg_max(x, (d2, -point_id)) OVER w AS px, arg_max(y, (d2, -point_id)) OVER w AS py, arg_max(z, (d2, -point_id)) OVER w AS pz FROM f WHERE step < least(n, {n}) WINDOW w AS (PARTITION BY cloud_id))) SELECT DISTINCT cloud_id, pick AS point_id, step::int AS rank FROM f)"""


@query("r17_farthest_points", f"WITH {farthest_sql(16)} SELECT p.cloud_id, fp.point_id, rank FROM fp JOIN pts p ON p.cloud_id = fp.cloud_id AND p.point_id = fp.point_id")
def _(spark, d):
    return cluster.farthest_points(points(spark, d), 16)


@query("r17_farthest_by_leaves", f"WITH {farthest_sql(6)} SELECT p.cloud_id, fp.point_id, rank FROM fp JOIN pts p ON p.cloud_id = fp.cloud_id AND p.point_id = fp.point_id")
def _(spark, d):
    return farthest.farthest_points(points(spark, d), 6, leaf=64, top=8)


@query("e24_associations", "WITH v AS (SELECT cloud_id, instance, count(*) AS size, arg_min(label, point_id) AS class FROM pts WHERE instance >= 0 GROUP BY 1, 2), g AS (SELECT cloud_id, rib AS gt, count(*) AS gt_size FROM pts WHERE rib > 0 GROUP BY 1, 2), x AS (SELECT cloud_id, instance, rib AS gt, count(*) AS inter FROM pts WHERE instance >= 0 AND rib > 0 GROUP BY ALL) SELECT x.cloud_id, x.instance AS inst, x.gt, inter, size, gt_size, class, round(inter/(size+gt_size-inter), 6) AS iou FROM x JOIN v USING (cloud_id, instance) JOIN g USING (cloud_id, gt)")
def _(spark, d):
    return rounded(cluster.associate(points(spark, d), "instance", "rib"), "iou")


@query("e25_average_precision", """WITH gp AS (SELECT *, CASE WHEN z > 1 THEN rib ELSE 0 END AS guess FROM pts), gt AS (SELECT cloud_id, rib AS gt, arg_min(label, point_id) AS class, count(*) AS n FROM gp WHERE rib > 0 GROUP BY 1, 2), gu AS (SELECT cloud_id, guess AS inst, arg_min(label, point_id) AS class, count(*) AS n, 1.0::double/(1+guess) AS score FROM gp WHERE guess > 0 GROUP BY 1, 2),
 t AS (SELECT unnest([0.25, 0.5, 0.75]::double[]) AS threshold), p AS (SELECT gu.*, threshold, gt.gt IS NOT NULL AND gt.class = gu.class AND gu.n/gt.n > threshold AS own FROM gu CROSS JOIN t LEFT JOIN gt ON gt.cloud_id = gu.cloud_id AND gt.gt = gu.inst), tot AS (SELECT class, count(*) AS truth FROM gt GROUP BY 1),
 s AS (SELECT threshold, class, score, count(*) FILTER (own) AS h, count(*) AS c FROM p GROUP BY ALL), cv AS (SELECT s.threshold, s.class, score, sum(h) OVER w / sum(c) OVER w AS pr, sum(h) OVER w / truth AS rc FROM s JOIN tot ON tot.class = s.class WINDOW w AS (PARTITION BY threshold, s.class ORDER BY score ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 l AS (SELECT *, coalesce(lag(rc) OVER k, rc) AS bef, lead(rc) OVER k AS aft FROM cv WINDOW k AS (PARTITION BY threshold, class ORDER BY score)), a AS (SELECT threshold, class, sum(pr*(bef-coalesce(aft, 0))/2 + CASE WHEN aft IS NULL THEN rc/2 ELSE 0 END) AS ap FROM l GROUP BY 1, 2), cl AS (SELECT class FROM gt UNION SELECT class FROM gu)
 SELECT t.threshold, cl.class, round(CASE WHEN truth > 0 THEN coalesce(ap, 0) END, 6) AS ap FROM cl CROSS JOIN t LEFT JOIN tot ON tot.class = cl.class LEFT JOIN a ON a.class = cl.class AND a.threshold = t.threshold""")
def _(spark, d):
    p = points(spark, d).withColumn("guess", F.when(F.col("z") > 1, F.col("rib")).otherwise(F.lit(0)))
    met = materialise(p.groupBy("cloud_id", "guess", "rib").agg(F.min(F.struct("point_id", "label")).alias("first"), F.count("*").alias("n")))  # the points are read once
    one = lambda name: met.where(f"{name} > 0").groupBy("cloud_id", name).agg(F.min("first")["label"].alias("class"), F.sum("n").alias("size"))
    guesses = one("guess").withColumnRenamed("guess", "inst").withColumns({"score": 1.0 / (1 + F.col("inst")), "void": F.lit(0)})
    overlaps = met.where("guess > 0 and rib > 0").select("cloud_id", F.col("guess").alias("inst"), F.col("rib").alias("gt"), F.col("n").alias("inter"))
    return rounded(cluster.average_precision(guesses, one("rib").withColumnRenamed("rib", "gt"), overlaps, [0.25, 0.5, 0.75]), "ap")
