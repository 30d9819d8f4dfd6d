"""Queries of losses, metric series and window forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.operators import losses
from cloudloom.plans.catalog import query
from cloudloom.plans.geometry import rounded
from cloudloom.sources.fixtures import metrics, points
from cloudloom.streaming import metrics as stream

PR = "pr AS (SELECT cloud_id, point_id, label, c::int AS class, CASE WHEN c = pred THEN 0.6 ELSE 0.1 END + (point_id % 3)/100.0 AS p FROM pts, range(5) b(c))"


def probs(spark, d):
    p = points(spark, d).withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return p.select("cloud_id", "point_id", "label", "class", (F.when(F.col("class") == F.col("pred"), 0.6).otherwise(0.1) + (F.col("point_id") % 3) / 100.0).alias("p"))


@query("l1_cross_entropy", f"WITH {PR} SELECT cloud_id, round(sum(-(CASE WHEN class = label THEN 0.9 ELSE 0 END + 0.1/5)*ln(p))/sum(CASE WHEN class = label THEN 1.0 ELSE 0 END), 6) AS loss FROM pr WHERE label <> 4 GROUP BY 1")
def _(spark, d):
    return rounded(losses.cross_entropy(probs(spark, d), ignore=4, smoothing=0.1), "loss")


@query("l3_l4_focal", f"WITH {PR}, q AS (SELECT cloud_id, CASE WHEN class = label THEN p ELSE 1 - p END AS pt FROM pr) SELECT cloud_id, round(avg(-0.5*pow(1 - pt, 2)*ln(pt)), 6) AS loss FROM q GROUP BY 1")
def _(spark, d):
    return rounded(losses.focal(probs(spark, d)), "loss")


@query("l5_dice", f"WITH {PR}, k AS (SELECT cloud_id, class, 1 - (2*sum(CASE WHEN class = label THEN p ELSE 0 END) + 1)/(sum(p*p + CASE WHEN class = label THEN 1.0 ELSE 0 END) + 1) AS l FROM pr GROUP BY 1, 2) SELECT cloud_id, round(avg(l), 6) AS loss FROM k GROUP BY 1")
def _(spark, d):
    return rounded(losses.dice(probs(spark, d)), "loss")


@query("l6_lovasz", f"""WITH {PR}, e AS (SELECT cloud_id, point_id, class, (class = label)::int::double AS fg, abs((class = label)::int - p) AS e FROM pr),
 c AS (SELECT *, sum(fg) OVER (PARTITION BY cloud_id, class ORDER BY e DESC, point_id ROWS UNBOUNDED PRECEDING) AS cs, row_number() OVER (PARTITION BY cloud_id, class ORDER BY e DESC, point_id) AS n, sum(fg) OVER (PARTITION BY cloud_id, class) AS t FROM e),
 j AS (SELECT *, 1 - (t - cs)/(t + n - cs) AS j FROM c WHERE t > 0), s AS (SELECT *, j - coalesce(lag(j) OVER (PARTITION BY cloud_id, class ORDER BY e DESC, point_id), 0) AS st FROM j), k AS (SELECT cloud_id, class, sum(e*st) AS l FROM s GROUP BY 1, 2) SELECT cloud_id, round(avg(l), 5) AS loss FROM k GROUP BY 1""")
def _(spark, d):
    return rounded(losses.lovasz_softmax(probs(spark, d)), "loss", digits=5)


@query("l7_offsets", "SELECT cloud_id, round(avg(abs(x-y)+abs(y-z)+abs(z-x)), 6) AS l1, round(avg(-(x*y+y*z+z*x)/((sqrt(x*x+y*y+z*z)+1e-8)*(sqrt(x*x+y*y+z*z)+1e-8))), 6) AS cosine FROM pts GROUP BY 1")
def _(spark, d):
    return rounded(losses.offset_terms(points(spark, d), ("x", "y", "z"), ("y", "z", "x")), "l1", "cosine")


def _sinkhorn_sql(rounds: int = 3) -> str:
    steps = ["s0 AS (SELECT cloud_id, point_id, class, p AS v FROM pr)"]
    for k in range(rounds):
        steps.append(f"c{k} AS (SELECT cloud_id, point_id, class, v/sum(v) OVER (PARTITION BY cloud_id, class) AS v FROM s{k}), s{k + 1} AS (SELECT cloud_id, point_id, class, v/sum(v) OVER (PARTITION BY cloud_id, point_id) AS v FROM c{k})")
    return ", ".join(steps)


@query("l10_sinkhorn", f"WITH {PR}, {_sinkhorn_sql()} SELECT cloud_id, point_id, class, round(v, 6) AS v FROM s3")
def _(spark, d):
    return rounded(losses.sinkhorn(probs(spark, d).withColumn("v", F.col("p")), "point_id", "class", "v").select("cloud_id", "point_id", "class", "v"), "v")


@query("l11_masks", f"WITH {PR} SELECT cloud_id, class, round(1 - (2*sum(CASE WHEN class=label THEN p ELSE 0 END)+1)/(sum(p)+sum((class=label)::int)+1), 6) AS dice, round(avg(CASE WHEN class=label THEN -ln(p) ELSE -ln(1-p) END), 6) AS bce, round(sum((p > 0.5 AND class=label)::int)/nullif(sum((p > 0.5 OR class=label)::int), 0), 6) AS iou FROM pr GROUP BY 1, 2")
def _(spark, d):
    df = probs(spark, d).withColumn("t", F.col("class") == F.col("label"))
    return rounded(losses.mask_terms(df, "p", "t", ["cloud_id", "class"]), "dice", "bce", "iou")


@query("l12_total", f"WITH {PR}, a AS (SELECT cloud_id, avg(-ln(p)) AS ce FROM pr WHERE class = label GROUP BY 1) SELECT cloud_id, round(ce*0.7 + 0.3, 6) AS loss FROM a")
def _(spark, d):
    ce = losses.cross_entropy(probs(spark, d)).withColumn("one", F.lit(1.0))
    return rounded(ce.select("cloud_id", losses.weighted_total({"loss": 0.7, "one": 0.3}).alias("loss")), "loss")


@query("t2_w7_smoothed", "SELECT run, name, iter, round(avg(value) OVER w, 8) AS mean, round(median(value) OVER w, 8) AS median FROM metrics WINDOW w AS (PARTITION BY run, name ORDER BY iter ROWS 19 PRECEDING)")
def _(spark, d):
    return rounded(stream.smoothed(metrics(spark, d), 20).select("run", "name", "iter", "mean", "median"), "mean", "median", digits=8)


@query("t3_w8_best_so_far", "SELECT run, name, iter, greatest(value, max(value) OVER w) AS best, coalesce(value > max(value) OVER w, true) AS new_best FROM metrics WINDOW w AS (PARTITION BY run, name ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    return stream.best_so_far(metrics(spark, d)).select("run", "name", "iter", "best", "new_best")


@query("t1_confusion_totals", "SELECT label::int AS label, pred::int AS pred, count(*)::bigint AS n FROM pts GROUP BY 1, 2")
def _(spark, d):
    from cloudloom.operators.evaluate import confusion

    counts = confusion(points(spark, d)).withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    return stream.running_confusion(counts.unionByName(counts))


@query("e33_running_mean", "SELECT run, name, iter, round(sum(value*(iter+1)) OVER w / sum(iter+1) OVER w, 7) AS mean FROM metrics WINDOW w AS (PARTITION BY run, name ORDER BY iter ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("run", "name").orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("iter") + 1
    return rounded(metrics(spark, d).select("run", "name", "iter", (F.sum(F.col("value") * n).over(w) / F.sum(n).over(w)).alias("mean")), "mean", digits=7)


@query("x1_x2_pipeline", "SELECT cloud_id, point_id, round(least(greatest((x - min(x) OVER w) / 2, 1), 20), 6) AS x FROM pts WHERE label NOT IN (4) WINDOW w AS (PARTITION BY cloud_id)")
def _(spark, d):
    from cloudloom.plans.pipeline import compose

    steps = [{"type": "drop_classes", "classes": [4]}, {"type": "positive_shift"}, {"type": "scale", "factor": 0.5}, {"type": "clip", "box": [1, 0, 0, 20, 99, 99]}]
    return rounded(compose(steps)(points(spark, d)).select("cloud_id", "point_id", "x"), "x")


@query("x8_test_time_copies", "SELECT cloud_id, a::int AS aug, count(*) AS n, round(sum(x * CASE a WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0.5 END), 3) + 0.0 AS total FROM pts, range(3) t(a) GROUP BY 1, 2")
def _(spark, d):
    from cloudloom.plans.pipeline import test_time

    out = test_time(points(spark, d), [lambda df: df, lambda df: df.withColumn("x", -F.col("x")), lambda df: df.withColumn("x", F.col("x") * 0.5)])
    return rounded(out.groupBy("cloud_id", "aug").agg(F.count("*").alias("n"), F.sum("x").alias("total")), "total", digits=3)
