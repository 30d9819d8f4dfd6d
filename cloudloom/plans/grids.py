"""Queries of grids, pooling and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions.random import draw_sql
from cloudloom.operators import grid
from cloudloom.plans.catalog import ORACLE_SQL, query
from cloudloom.plans.geometry import rounded
from cloudloom.sources.fixtures import points

CELLS = "c AS (SELECT *, floor(x/4)::bigint - min(floor(x/4)::bigint) OVER w AS cx, floor(y/4)::bigint - min(floor(y/4)::bigint) OVER w AS cy, floor(z/4)::bigint - min(floor(z/4)::bigint) OVER w AS cz FROM pts WINDOW w AS (PARTITION BY cloud_id))"


def celled(spark, d):
    return grid.cells(points(spark, d), 4.0)


@query("r13_grid_sample", f"WITH {CELLS}, k AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, cx, cy, cz ORDER BY {draw_sql(4, 'cloud_id', 'point_id')}, point_id) AS rk FROM c) SELECT cloud_id, cx, cy, cz, point_id FROM k WHERE rk = 1")
def _(spark, d):
    return grid.representatives(celled(spark, d), seed=4).select("cloud_id", "cx", "cy", "cz", "point_id")


@query("r13_inverse_map", f"WITH {CELLS} SELECT cloud_id, point_id, min(point_id) OVER (PARTITION BY cloud_id, cx, cy, cz) AS rep, round(x/4 - floor(x/4) - 0.5, 6) + 0.0 AS dx FROM c")
def _(spark, d):
    cells = celled(spark, d)
    reps = grid.representatives(cells).select(*grid.CELL, F.col("point_id").alias("rep"))
    return rounded(grid.to_points(grid.displacement(cells, 4.0), reps).select("cloud_id", "point_id", "rep", "dx"), "dx")


@query("r14_fragments", f"WITH {CELLS}, k AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, cx, cy, cz ORDER BY point_id) - 1 AS r, count(*) OVER (PARTITION BY cloud_id, cx, cy, cz) AS n FROM c), m AS (SELECT *, max(n) OVER (PARTITION BY cloud_id) AS mx FROM k) SELECT cloud_id, f::int AS fragment, count(*) AS n, sum(point_id)::bigint AS ids FROM m, unnest(range(r, mx, n)) u(f) GROUP BY 1, 2")
def _(spark, d):
    return grid.fragments(celled(spark, d)).groupBy("cloud_id", "fragment").agg(F.count("*").alias("n"), F.sum("point_id").alias("ids"))


@query("r15_first_in_cell", f"WITH {CELLS} SELECT cloud_id, cx, cy, cz, min(point_id) AS point_id FROM c GROUP BY ALL")
def _(spark, d):
    return grid.representatives(celled(spark, d)).select("cloud_id", "cx", "cy", "cz", "point_id")


@query("r16_tiles", """WITH b AS (SELECT *, x - min(x) OVER w AS px, y - min(y) OVER w AS py, max(x) OVER w - min(x) OVER w AS wx, max(y) OVER w - min(y) OVER w AS wy FROM pts WINDOW w AS (PARTITION BY cloud_id)),
 t AS (SELECT b.*, i AS tx, j AS ty FROM b, range(0, 60) a(i), range(0, 60) e(j) WHERE i*10 <= px AND px < i*10 + 15 AND i <= floor(wx/10) AND j*10 <= py AND py < j*10 + 15 AND j <= floor(wy/10)),
 k AS (SELECT *, count(*) OVER (PARTITION BY cloud_id, tx, ty) AS n FROM t), q AS (SELECT *, dense_rank() OVER (PARTITION BY cloud_id ORDER BY tx, ty) - 1 AS chunk FROM k WHERE n >= 100) SELECT cloud_id, chunk::int AS chunk, count(*) AS n FROM q GROUP BY 1, 2""")
def _(spark, d):
    return grid.tiles(points(spark, d), 15, 10, 100).groupBy("cloud_id", "chunk").agg(F.count("*").alias("n"))


@query("g1_grid_pool", f"WITH {CELLS} SELECT cloud_id, cx, cy, cz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, max(intensity) AS intensity, count(*) AS n FROM c GROUP BY ALL")
def _(spark, d):
    return rounded(grid.pool(celled(spark, d), ["intensity"]), "x", "y", "z")


@query("g2_serial_pool", """WITH s AS (SELECT *, (""" + " + ".join(f"((x::bigint >> {b}) & 1) * {4 << 3 * b} + ((y::bigint >> {b}) & 1) * {2 << 3 * b} + ((z::bigint >> {b}) & 1) * {1 << 3 * b}" for b in range(10)) + """) AS code FROM pts)
 SELECT cloud_id, (code >> 6)::bigint AS cell, round(avg(x), 6) AS x, arg_min(point_id, code * 100000 + point_id) AS head, count(*) AS n FROM s GROUP BY 1, 2""")
def _(spark, d):
    df = points(spark, d).withColumns({f"c{a}": F.col(a).cast("bigint") for a in "xyz"})
    return rounded(grid.serial_pool(grid.serialise(df), 2).drop("y", "z"), "x")


@query("g3_unpool", f"WITH {CELLS}, p AS (SELECT cloud_id, cx, cy, cz, max(intensity) AS top FROM c GROUP BY ALL) SELECT c.cloud_id, point_id, round(intensity + top, 6) AS fused FROM c JOIN p ON c.cloud_id=p.cloud_id AND c.cx=p.cx AND c.cy=p.cy AND c.cz=p.cz")
def _(spark, d):
    cells = celled(spark, d)
    top = cells.groupBy(*grid.CELL).agg(F.max("intensity").alias("top"))
    return rounded(grid.to_points(cells, top).select("cloud_id", "point_id", (F.col("intensity") + F.col("top")).alias("fused")), "fused")


@query("g4_segment_mean", "SELECT cloud_id, rib, round(avg(floor(intensity)), 8) AS intensity, round(avg(x), 6) AS x, count(*) AS n FROM pts GROUP BY 1, 2")
def _(spark, d):
    return rounded(rounded(grid.segment_mean(points(spark, d).withColumn("intensity", F.floor("intensity")), "rib", ["intensity", "x"]), "x"), "intensity", digits=8)


@query("g5_segment_instances", """WITH s AS (SELECT *, count(*) OVER (PARTITION BY cloud_id, x::int) AS sz FROM pts), p AS (SELECT cloud_id, x::int AS seg, instance, count(*) / max(sz) AS share FROM s WHERE instance >= 0 GROUP BY ALL), k AS (SELECT cloud_id, instance, max(label)::int AS class FROM pts WHERE instance >= 0 GROUP BY ALL)
 SELECT p.cloud_id, p.instance, seg, round(share, 6) AS share, class FROM p JOIN k ON p.cloud_id=k.cloud_id AND p.instance=k.instance WHERE share > 0.3""")
def _(spark, d):
    return rounded(grid.segment_instances(points(spark, d).withColumn("seg", F.col("x").cast("int")), "seg", 0.3), "share")


@query("g8_g9_interpolate", """WITH v AS (SELECT cloud_id, floor(x/4)::bigint cx, floor(y/4)::bigint cy, floor(z/4)::bigint cz, max(floor(intensity)) AS v FROM pts GROUP BY ALL),
 k AS (SELECT p.cloud_id, point_id, floor(x/4)::bigint + i AS cx, floor(y/4)::bigint + j AS cy, floor(z/4)::bigint + k AS cz,
 (CASE WHEN i=1 THEN x/4-floor(x/4) ELSE 1-(x/4-floor(x/4)) END)*(CASE WHEN j=1 THEN y/4-floor(y/4) ELSE 1-(y/4-floor(y/4)) END)*(CASE WHEN k=1 THEN z/4-floor(z/4) ELSE 1-(z/4-floor(z/4)) END) AS w FROM pts p, range(2) a(i), range(2) b(j), range(2) e(k))
 SELECT k.cloud_id, point_id, round(sum(w*v)/sum(w), 5) AS intensity FROM k JOIN v USING (cloud_id, cx, cy, cz) WHERE w > 0 GROUP BY 1, 2""")
def _(spark, d):
    df = points(spark, d)
    values = grid.cells(df, 4.0, relative=False).groupBy(*grid.CELL).agg(F.max(F.floor("intensity")).cast("double").alias("intensity"))
    return rounded(grid.interpolate_cells(df, values, 4.0, "intensity"), "intensity", digits=5)


@query("g10_nearest_to_mean", f"""WITH {CELLS}, q AS (SELECT *, round((x-avg(x) OVER w)*(x-avg(x) OVER w) + (y-avg(y) OVER w)*(y-avg(y) OVER w) + (z-avg(z) OVER w)*(z-avg(z) OVER w), 9) AS d2 FROM c WINDOW w AS (PARTITION BY cloud_id, cx, cy, cz)),
 k AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, cx, cy, cz ORDER BY d2, point_id) AS rk FROM q) SELECT cloud_id, cx, cy, cz, point_id FROM k WHERE rk = 1""")
def _(spark, d):
    return grid.nearest_to_mean(celled(spark, d)).select("cloud_id", "cx", "cy", "cz", "point_id")


OCC = "o AS (SELECT cloud_id, s::int AS stage, count(DISTINCT (floor(x/(1.5*pow(2,s))), floor(y/(1.5*pow(2,s))), floor(z/(1.5*pow(2,s))))) AS cells FROM pts, range(4) r(s) GROUP BY ALL)"


@query("g13_occupancy", f"WITH {OCC} SELECT * FROM o")
def _(spark, d):
    return grid.occupancy(points(spark, d), 1.5, 2, 4)


@query("g13_suggested_cap", f"WITH {OCC} SELECT stage, round(avg(cells), 6) AS mean, median(cells) AS median, round(quantile_cont(cells, 0.99), 6) AS high, CAST(ceil(quantile_cont(cells, 0.99)/1000)*1000 AS BIGINT) AS cap FROM o GROUP BY 1")
def _(spark, d):
    return rounded(grid.suggested_cap(grid.occupancy(points(spark, d), 1.5, 2, 4)), "mean", "high")


@query("g14_cell_softmax", f"WITH {CELLS}, e AS (SELECT *, exp(x/10 - max(x/10) OVER w) AS ex FROM c WINDOW w AS (PARTITION BY cloud_id, cx, cy, cz)), f AS (SELECT *, ex/sum(ex) OVER w AS weight FROM e WINDOW w AS (PARTITION BY cloud_id, cx, cy, cz)) SELECT cloud_id, point_id, round(weight, 6) AS weight, round(sum(weight*intensity) OVER w, 2) AS fused FROM f WINDOW w AS (PARTITION BY cloud_id, cx, cy, cz)")
def _(spark, d):
    out = grid.cell_softmax(celled(spark, d).withColumn("score", F.col("x") / 10), "score", "intensity")
    return rounded(rounded(out.select("cloud_id", "point_id", "weight", "fused"), "weight"), "fused", digits=2)


@query("g15_prototypes", "SELECT label, i::int AS axis, round(avg(embedding[i + 1]::double), 6) + 0.0 AS v FROM embeddings, range(64) r(i) GROUP BY 1, 2")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rounded(grid.class_prototypes(e, "embedding", "label"), "v")


@query("g16_octree", "SELECT cloud_id, l::int AS level, count(DISTINCT (x::bigint >> (6-l), y::bigint >> (6-l), z::bigint >> (6-l))) AS nodes FROM pts, range(0, 7) r(l) GROUP BY 1, 2")
def _(spark, d):
    return grid.octree_levels(points(spark, d).withColumns({f"c{a}": F.col(a).cast("bigint") for a in "xyz"}), 6)


SERIAL = "s AS (SELECT *, (" + " + ".join(f"((x::bigint >> {b}) & 1) * {4 << 3 * b} + ((y::bigint >> {b}) & 1) * {2 << 3 * b} + ((z::bigint >> {b}) & 1) * {1 << 3 * b}" for b in range(10)) + ") AS code FROM pts), o AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY code, point_id) - 1 AS ord, count(*) OVER (PARTITION BY cloud_id) AS n FROM s)"


def serialised(spark, d):
    return grid.serialise(points(spark, d).withColumns({f"c{a}": F.col(a).cast("bigint") for a in "xyz"}))


@query("g17_serialise", f"WITH {SERIAL} SELECT cloud_id, point_id, code::bigint AS code, ord::int AS ord FROM o")
def _(spark, d):
    return serialised(spark, d).select("cloud_id", "point_id", "code", "ord")


@query("g18_patches", f"WITH {SERIAL}, b AS (SELECT cloud_id, point_id, floor(ord/128)::bigint AS patch, false AS borrowed FROM o UNION ALL SELECT cloud_id, point_id, floor((n-1)/128)::bigint, true FROM o WHERE n > 128 AND n % 128 > 0 AND ord >= n - 128 AND ord < floor((n-1)/128)*128) SELECT * FROM b")
def _(spark, d):
    return grid.patches(serialised(spark, d), 128).select("cloud_id", "point_id", "patch", "borrowed")


@query("g17_g18_range_patches", ORACLE_SQL["g18_patches"])
def _(spark, d):
    s = grid.serialise(points(spark, d).withColumns({f"c{a}": F.col(a).cast("bigint") for a in "xyz"}), large=True)
    return grid.patches(s, 128, large=True).select("cloud_id", "point_id", "patch", "borrowed")


@query("g20_windows", "WITH b AS (SELECT *, floor((x - min(x) OVER w + 4)/8)::bigint AS wx, floor((y - min(y) OVER w + 4)/8)::bigint AS wy, floor((z - min(z) OVER w + 4)/8)::bigint AS wz FROM pts WINDOW w AS (PARTITION BY cloud_id)) SELECT cloud_id, point_id, wx, wy, wz, (row_number() OVER (PARTITION BY cloud_id, wx, wy, wz ORDER BY point_id) - 1)::int AS ord FROM b")
def _(spark, d):
    return grid.windows(points(spark, d), 8.0, shifted=True).select("cloud_id", "point_id", "wx", "wy", "wz", "ord")
