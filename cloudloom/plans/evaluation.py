"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions.random import draw_sql
from cloudloom.operators import evaluate as ev
from cloudloom.operators import grid
from cloudloom.plans.catalog import query
from cloudloom.plans.geometry import rounded
from cloudloom.sources.fixtures import points

RATES = """cm AS (SELECT cloud_id, label, pred, count(*) AS n FROM pts GROUP BY ALL),
 g AS (SELECT DISTINCT cloud_id, c FROM cm, range(5) r(c)),
 r AS (SELECT g.cloud_id, g.c::int AS class, coalesce(sum(n) FILTER (label = c AND pred = c), 0)::bigint AS tp, coalesce(sum(n) FILTER (label <> c AND pred = c), 0)::bigint AS fp,
 coalesce(sum(n) FILTER (label = c AND pred <> c), 0)::bigint AS fn, coalesce(sum(n) FILTER (label <> c AND pred <> c), 0)::bigint AS tn FROM g JOIN cm ON g.cloud_id = cm.cloud_id GROUP BY 1, 2)"""
RIB_CM = "cm AS (SELECT cloud_id, rib AS label, rib_pred AS pred, count(*) AS n FROM pts GROUP BY ALL)"


def cm(spark, d):
    return ev.confusion(points(spark, d))


def rib_cm(spark, d):
    return ev.confusion(points(spark, d), "rib", "rib_pred")


@query("e1_confusion", "SELECT cloud_id, label::int AS label, pred::int AS pred, count(*) AS n FROM pts GROUP BY ALL")
def _(spark, d):
    return cm(spark, d)


@query("e2_rates", f"WITH {RATES} SELECT * FROM r")
def _(spark, d):
    return ev.rates(cm(spark, d), 5)


@query("e3_e4_class_metrics", f"""WITH {RATES} SELECT cloud_id, class, round(tp/nullif(tp+fp+fn,0), 6) AS iou, round(2*tp/nullif(2*tp+fp+fn,0), 6) AS dice, round(tp/nullif(tp+fn,0), 6) AS recall,
 round(tp/nullif(tp+fp,0), 6) AS precision, round(tn/nullif(tn+fp,0), 6) AS specificity, round((tp+tn)/nullif(tp+fp+fn+tn,0), 6) AS accuracy FROM r""")
def _(spark, d):
    return rounded(ev.class_metrics(ev.rates(cm(spark, d), 5)).drop("tp", "fp", "fn", "tn"), "iou", "dice", "recall", "precision", "specificity", "accuracy")


@query("e3_summable", f"""WITH {RATES} SELECT class, round(coalesce(sum(tp/nullif(tp+fp+fn,0)), 0), 5) AS iou_sum, count(tp/nullif(tp+fp+fn,0)) AS iou_n, round(coalesce(sum(2*tp/nullif(2*tp+fp+fn,0)), 0), 5) AS dice_sum, count(2*tp/nullif(2*tp+fp+fn,0)) AS dice_n FROM r GROUP BY 1""")
def _(spark, d):
    return rounded(ev.summable(ev.class_metrics(ev.rates(cm(spark, d), 5)), ["iou", "dice"]), "iou_sum", "dice_sum", digits=5)


@query("e5_e6_mean_iou", f"WITH {RATES}, t AS (SELECT class, sum(tp) tp, sum(fp) fp, sum(fn) fn FROM r GROUP BY 1) SELECT round(avg(tp/(tp+fp+fn+1e-10)), 6) AS miou, round(avg(tp/(tp+fn+1e-10)), 6) AS macc, round(sum(tp)/(sum(tp+fn)+1e-10), 6) AS all_acc FROM t")
def _(spark, d):
    return rounded(ev.mean_iou(ev.rates(ev.confusion(points(spark, d), by=()), 5, by=())), "miou", "macc", "all_acc")


@query("e7_f_beta", f"WITH {RATES}, t AS (SELECT class, sum(tp) tp, sum(fp) fp, sum(fn) fn FROM r GROUP BY 1) SELECT class, round(5*tp/(5*tp+4*fn+fp+1e-10), 6) AS f FROM t")
def _(spark, d):
    return rounded(ev.f_beta(ev.rates(ev.confusion(points(spark, d), by=()), 5, by=()), 2.0).select("class", "f"), "f")


@query("e8_cloud_iou", f"WITH {RATES} SELECT cloud_id, round(avg(tp/(tp+fp+fn)), 6) AS miou FROM r WHERE tp+fp+fn > 0 GROUP BY 1")
def _(spark, d):
    return rounded(ev.class_metrics(ev.rates(cm(spark, d), 5)).groupBy("cloud_id").agg(F.avg("iou").alias("miou")), "miou")


@query("e9_na_rules", f"""WITH {RATES}, k AS (SELECT *, tp+fp+fn = 0 AS none FROM r) SELECT cloud_id, class, round(tp/nullif(tp+fp+fn,0), 6) AS iou, round(2*tp/nullif(2*tp+fp+fn,0), 6) AS dice, round(tp/nullif(tp+fn,0), 6) AS recall,
 round(tp/nullif(tp+fp,0), 6) AS precision, CASE WHEN NOT none THEN round(CASE WHEN tn+fp > 0 THEN tn/(tn+fp) WHEN fn = 0 THEN 1 ELSE 0 END, 6) END AS specificity, CASE WHEN NOT none THEN round((tp+tn)/(tp+fp+fn+tn), 6) END AS accuracy,
 none::int AS both_empty, (tp+fn = 0 AND fp > 0)::int AS truth_empty, (tp+fn > 0 AND tp+fp = 0)::int AS pred_empty FROM k""")
def _(spark, d):
    return rounded(ev.cloud_class_metrics(ev.rates(cm(spark, d), 5)), "iou", "dice", "recall", "precision", "specificity", "accuracy")


@query("e10_reduced", f"""WITH {RATES}, m AS (SELECT cloud_id, class, tp/nullif(tp+fp+fn,0) AS v FROM r)
 SELECT (SELECT round(avg(a), 6) FROM (SELECT avg(v) a FROM m GROUP BY class)) AS class_mean, (SELECT round(avg(a), 6) FROM (SELECT avg(v) a FROM m GROUP BY cloud_id)) AS cloud_mean""")
def _(spark, d):
    return rounded(ev.reduced(ev.cloud_class_metrics(ev.rates(cm(spark, d), 5)), "iou"), "class_mean", "cloud_mean")


#: Sums over a confusion table, as SQL: foreground and background on both sides, and what goes wrong there.
KINDS = """SELECT * FROM (SELECT cloud_id, sum(n) t, sum(n) FILTER (label <> 0) fg, sum(n) FILTER (label = 0) bg, sum(n) FILTER (pred <> 0) pfg, sum(n) FILTER (label <> 0 AND pred <> 0) fgs, coalesce(sum(n) FILTER (label <> 0 AND pred = 0), 0) fneg, coalesce(sum(n) FILTER (label = 0 AND pred <> 0), 0) fpos,
 coalesce(sum(n) FILTER (label <> 0 AND pred <> 0 AND label <> pred), 0) wp, coalesce(sum(n) FILTER (label <> pred), 0) wrong, coalesce(sum(n) FILTER (label <> 0 AND pred <> 0 AND abs(label - pred) = 1 AND NOT (least(label, pred) = 12 AND greatest(label, pred) = 13)), 0) nr,
 coalesce(sum(n) FILTER (label <> 0 AND pred <> 0 AND (abs(label - pred) > 1 OR (least(label, pred) = 12 AND greatest(label, pred) = 13))), 0) fr FROM cm GROUP BY 1)"""


@query("e12_error_rates", f"""WITH {RIB_CM}, k AS ({KINDS}) SELECT cloud_id, round(fneg/nullif(fg,0), 6) AS fnr, round(fpos/nullif(bg,0), 6) AS fpr, round(wp/nullif(fgs,0), 6) AS wpr, round((t-wrong)/t, 6) AS cr, round(wrong/t, 6) AS wr,
 round(fneg/nullif(wrong,0), 6) AS fnr_conditional, round(fpos/nullif(wrong,0), 6) AS fpr_conditional, round(wp/nullif(wrong,0), 6) AS wpr_conditional, round(coalesce(pfg,0)/nullif(fg,0), 6) AS fg_ratio FROM k""")
def _(spark, d):
    return rounded(ev.error_rates(rib_cm(spark, d)), "fnr", "fpr", "wpr", "cr", "wr", "fnr_conditional", "fpr_conditional", "wpr_conditional", "fg_ratio")


@query("e13_rib_shift", f"WITH {RIB_CM}, k AS ({KINDS}) SELECT cloud_id, round(nr/nullif(fgs,0), 6) AS near_rate, round(fr/nullif(fgs,0), 6) AS far_rate, round(nr/nullif(wp,0), 6) AS near_conditional, round(fr/nullif(wp,0), 6) AS far_conditional FROM k")
def _(spark, d):
    return rounded(ev.rib_shift_rates(rib_cm(spark, d)), "near_rate", "far_rate", "near_conditional", "far_conditional")


CONSENSUS = RIB_CM + ", co AS (SELECT cloud_id, label, n, abs(label - pred) AS shift FROM cm WHERE label <> 0 AND pred <> 0 AND NOT (least(label, pred) = 12 AND greatest(label, pred) = 13))"


@query("e14_class_shift", f"""WITH {CONSENSUS} SELECT l::int AS label, coalesce(sum(n), 0)::bigint AS n, round(coalesce(sum(n) FILTER (shift = 1), 0)/sum(n), 6) AS near_rate, round(coalesce(sum(n) FILTER (shift > 1), 0)/sum(n), 6) AS far_rate FROM range(1, 25) r(l) LEFT JOIN co ON label = l GROUP BY 1""")
def _(spark, d):
    return rounded(ev.class_shift_rates(rib_cm(spark, d)), "near_rate", "far_rate")


@query("e14_shift_summary", f"""WITH {CONSENSUS}, c AS (SELECT cloud_id, sum(n)::bigint AS n_consensus, sum(n) FILTER (label <= 12) l, sum(n) FILTER (label > 12) r, coalesce(sum(n) FILTER (shift = 1), 0) ns, coalesce(sum(n) FILTER (shift = 1 AND label <= 12), 0) nl, coalesce(sum(n) FILTER (shift = 1 AND label > 12), 0) nr,
 coalesce(sum(n) FILTER (shift > 1), 0) fs, coalesce(sum(n) FILTER (shift > 1 AND label <= 12), 0) fl, coalesce(sum(n) FILTER (shift > 1 AND label > 12), 0) frr FROM co GROUP BY 1), k AS ({KINDS})
 SELECT k.cloud_id, coalesce(n_consensus, 0)::bigint AS n_consensus, round(coalesce(bg, 0)/t, 6) AS bg_ratio, round(ns/nullif(n_consensus,0), 6) AS near, round(nl/nullif(l,0), 6) AS near_left, round(nr/nullif(r,0), 6) AS near_right, round(fs/nullif(n_consensus,0), 6) AS far, round(fl/nullif(l,0), 6) AS far_left, round(frr/nullif(r,0), 6) AS far_right,
 round(fneg/nullif(fg,0), 6) AS fnr, round(fpos/nullif(bg,0), 6) AS fpr FROM (SELECT cloud_id, t, fg, bg, fneg, fpos FROM k) k LEFT JOIN c ON c.cloud_id = k.cloud_id""")
def _(spark, d):
    return rounded(ev.shift_summary(rib_cm(spark, d), ["cloud_id"]), "bg_ratio", "near", "near_left", "near_right", "far", "far_left", "far_right", "fnr", "fpr")


INTEGRITY = RIB_CM + """, s AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, label ORDER BY n DESC, pred) rk, sum(n) OVER (PARTITION BY cloud_id, label) t, count(*) OVER (PARTITION BY cloud_id, label) f FROM cm WHERE label<>0 AND pred<>0),
 it AS (SELECT a.cloud_id, a.label, coalesce(t, 0)::bigint AS recognised, pred AS dominant, n AS most, n/t AS share, coalesce(f, 0) AS fragments FROM (SELECT DISTINCT cloud_id, label FROM cm WHERE label <> 0) a LEFT JOIN s ON s.cloud_id = a.cloud_id AND s.label = a.label AND rk = 1)"""


@query("e15_integrity", f"WITH {INTEGRITY} SELECT cloud_id, label, recognised, dominant, round(share, 6) AS share, fragments FROM it")
def _(spark, d):
    return rounded(ev.integrity(rib_cm(spark, d)).drop("distribution"), "share")


@query("e15_integrity_summary", f"WITH {INTEGRITY} SELECT cloud_id, round(avg(share), 6) AS mean_integrity, round(sum(most)/nullif(sum(recognised),0), 6) AS weighted_mean_integrity, round(sum(most)/nullif(sum(recognised),0), 6) AS global_integrity FROM it GROUP BY 1")
def _(spark, d):
    return rounded(ev.integrity_summary(ev.integrity(rib_cm(spark, d))), "mean_integrity", "weighted_mean_integrity", "global_integrity")


PURITY = RIB_CM + """, w AS (SELECT *, sum(CASE WHEN pred<>0 THEN n ELSE 0 END) OVER (PARTITION BY cloud_id, label) fd FROM cm WHERE label<>0),
 p AS (SELECT cloud_id, label, sum(n) size, max(fd) found, max(n) FILTER (pred<>0) AS most, sum(CASE WHEN label=pred THEN n ELSE 0 END) AS rt, sum(CASE WHEN pred<>0 AND n >= 0.05*fd THEN 1 ELSE 0 END) fr FROM w GROUP BY 1, 2),
 e AS (SELECT DISTINCT cloud_id, l::int AS label FROM cm, range(1, 25) r(l)),
 pu AS (SELECT e.cloud_id, e.label, CASE WHEN size IS NULL THEN 'absent' WHEN found = 0 THEN 'unrecognised' ELSE 'scored' END AS state, most/nullif(found,0) AS purity, rt/nullif(found,0) AS recall, found/nullif(size,0) AS coverage,
 CASE WHEN found > 0 THEN fr END::bigint AS fragments, rt/nullif(size,0) AS label_recall FROM e LEFT JOIN p ON e.cloud_id = p.cloud_id AND e.label = p.label)"""


@query("e16_foreground_purity", f"WITH {PURITY} SELECT cloud_id, label, state, round(purity, 6) AS purity, round(recall, 6) AS recall, round(coverage, 6) AS coverage, fragments, round(label_recall, 6) AS label_recall FROM pu")
def _(spark, d):
    return rounded(ev.foreground_purity(rib_cm(spark, d)), "purity", "recall", "coverage", "label_recall")


@query("e17_purity_summary", f"""WITH {PURITY} SELECT count(*) FILTER (state='scored') AS scored, count(*) FILTER (state='absent') AS absent, count(*) FILTER (state='unrecognised') AS unrecognised, round(avg(purity), 6) AS mean, round(min(purity), 6) AS least, round(median(purity), 6) AS median, round(max(purity), 6) AS most,
 round(avg(fragments), 6) AS fragments_mean, round(avg((fragments > 1)::int), 6) AS fragments_gt1, round(avg((fragments = 0)::int), 6) AS fragments_eq0, round(avg((purity < 0.95)::int), 6) AS lt95, count(DISTINCT cloud_id) FILTER (purity < 0.95) AS lt95_clouds, round(avg(coverage), 6) AS coverage,
 count(*) FILTER (purity < 0.9) AS tail, round(median(purity) FILTER (purity < 0.9), 6) AS tail_median, round(max(purity) FILTER (purity < 0.9), 6) AS tail_max, round(min(purity) FILTER (purity < 0.9), 6) AS tail_min FROM pu""")
def _(spark, d):
    found = ev.purity_summary(ev.foreground_purity(rib_cm(spark, d)))
    return rounded(found, "mean", "least", "median", "most", "fragments_mean", "fragments_gt1", "fragments_eq0", "lt95", "coverage", "tail_median", "tail_max", "tail_min")


@query("e18_label_accuracy", f"""WITH {PURITY}, k AS (SELECT cloud_id, CASE WHEN label>12 THEN label-12 ELSE label END AS nr, CASE WHEN state<>'absent' THEN (label_recall > 0.85)::int END AS ok FROM pu)
 SELECT cloud_id, round(avg(ok), 6) AS all_acc, round(avg(CASE WHEN nr=1 THEN ok END), 6) AS first_acc, round(avg(CASE WHEN nr BETWEEN 2 AND 11 THEN ok END), 6) AS middle_acc, round(avg(CASE WHEN nr=12 THEN ok END), 6) AS last_acc FROM k GROUP BY 1""")
def _(spark, d):
    return rounded(ev.label_accuracy(ev.foreground_purity(rib_cm(spark, d)), 0.85), "all_acc", "first_acc", "middle_acc", "last_acc")


@query("e19_cloud_record", f"""WITH {INTEGRITY}, k AS ({KINDS}), m AS (SELECT cloud_id, sum(most)/nullif(sum(recognised),0) AS gi FROM it GROUP BY 1), c AS (SELECT cloud_id, label AS class, sum(n) AS truth FROM cm GROUP BY 1, 2), g AS (SELECT cloud_id, pred AS class, sum(n) AS guess, coalesce(sum(n) FILTER (label = pred), 0) AS tp FROM cm GROUP BY 1, 2),
 o AS (SELECT coalesce(c.cloud_id, g.cloud_id) AS cloud_id, round(avg(coalesce(tp, 0)/(coalesce(truth, 0)+coalesce(guess, 0)-coalesce(tp, 0))), 6) AS iou FROM c FULL JOIN g ON c.cloud_id = g.cloud_id AND c.class = g.class GROUP BY 1)
 SELECT k.cloud_id, t::bigint AS n_points, iou, round(fneg/nullif(fg,0), 6) AS fnr, round(wrong/t, 6) AS wr, round(nr/nullif(fgs,0), 6) AS near_rate, round(gi, 6) AS global_integrity FROM k LEFT JOIN m ON m.cloud_id = k.cloud_id JOIN o ON o.cloud_id = k.cloud_id""")
def _(spark, d):
    found = ev.cloud_record(rib_cm(spark, d), 25)
    mean = F.aggregate(F.filter("iou_cw", lambda v: v.isNotNull()), F.lit(0.0), lambda acc, v: acc + v) / F.size(F.filter("iou_cw", lambda v: v.isNotNull()))
    return rounded(found.select("cloud_id", "n_points", mean.alias("iou"), "fnr", "wr", "near_rate", "global_integrity"), "iou", "fnr", "wr", "near_rate", "global_integrity")


@query("e20_e21_distribution", f"""WITH {RATES}, v AS (SELECT class, tp/nullif(tp+fp+fn,0) AS v FROM r) SELECT class, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS least, round(max(v), 6) AS most, round(median(v), 6) AS median, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.95), 6) AS p95 FROM v GROUP BY 1""")
def _(spark, d):
    return rounded(ev.distribution(ev.class_metrics(ev.rates(cm(spark, d), 5)), "iou", ["class"]), "mean", "std", "least", "most", "median", "p5", "p95")


@query("e22_bootstrap", f"""WITH {RATES}, m AS (SELECT cloud_id, avg(tp/nullif(tp+fn,0)) - avg(tp/nullif(tp+fp,0)) AS v FROM r GROUP BY 1), k AS (SELECT v, row_number() OVER (ORDER BY cloud_id, v) - 1 AS at, count(*) OVER () AS n FROM m WHERE v IS NOT NULL),
 dr AS (SELECT b, floor({draw_sql(3, 'b', 'i')} * n)::bigint AS at FROM (SELECT DISTINCT n FROM k WHERE n > 1) q, range(200) x(b), range(1000000) y(i) WHERE i < n), bs AS (SELECT b, avg(v) AS m FROM dr JOIN k ON k.at = dr.at GROUP BY 1)
 SELECT (SELECT round(avg(v), 6) FROM k) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM bs""")
def _(spark, d):
    m = ev.class_metrics(ev.rates(cm(spark, d), 5)).groupBy("cloud_id").agg((F.avg("recall") - F.avg("precision")).alias("delta"))
    return rounded(ev.bootstrap_mean(m, "delta", 200, 0.05, 3), "mean", "low", "high")


@query("e23_row_normalised", "SELECT label::int AS label, pred::int AS pred, count(*)::bigint AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM pts GROUP BY label, pred")
def _(spark, d):
    return rounded(ev.row_normalised(cm(spark, d)), "share")


@query("e26_part_iou", f"""WITH {RATES}, k AS (SELECT cloud_id, avg(coalesce(tp/nullif(tp+fp+fn,0), 1)) AS iou FROM r GROUP BY 1) SELECT cloud_id % 4 AS category, round(avg(iou), 6) AS iou, count(*) AS clouds FROM k GROUP BY 1""")
def _(spark, d):
    return rounded(ev.part_iou(points(spark, d).withColumn("category", F.col("cloud_id") % 4), 5, "category"), "iou")


PROBS = "pr AS (SELECT cloud_id, point_id, f AS fragment, c::int AS class, CASE WHEN c = pred THEN 0.6 ELSE 0.1 END + ((point_id + f) % 3)/100.0 * (c + 1) AS p FROM pts, range(3) a(f), range(5) b(c))"


def probs(spark, d):
    """Soft predictions of three fragments for each point."""
    df = points(spark, d).withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return df.withColumn("p", F.when(F.col("class") == F.col("pred"), 0.6).otherwise(0.1) + ((F.col("point_id") + F.col("fragment")) % 3) / 100.0 * (F.col("class") + 1))


@query("e27_vote", f"WITH {PROBS}, s AS (SELECT cloud_id, point_id, class, sum(p) AS p FROM pr GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, point_id ORDER BY round(p, 9) DESC, class) AS rk FROM s) SELECT cloud_id, point_id, class AS pred, round(p, 6) AS score FROM k WHERE rk = 1")
def _(spark, d):
    return rounded(ev.vote(probs(spark, d).withColumn("p", F.round("p", 9))), "score")


@query("k4_top3_classes", f"WITH {PROBS}, s AS (SELECT cloud_id, point_id, class, round(sum(p), 9) AS p FROM pr GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, point_id ORDER BY p DESC, class) AS rk FROM s) SELECT cloud_id, point_id, rk AS rank, class FROM k WHERE rk <= 3")
def _(spark, d):
    from pyspark.sql import Window

    sums = probs(spark, d).groupBy("cloud_id", "point_id", "class").agg(F.round(F.sum("p"), 9).alias("p"))
    w = Window.partitionBy("cloud_id", "point_id").orderBy(F.desc("p"), "class")
    return sums.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 3").select("cloud_id", "point_id", "rank", "class")


@query("e30_clustering_scores", """WITH c AS (SELECT (vec_id % 12) AS k, label AS c, count(*)::double AS n FROM embeddings GROUP BY 1, 2), a AS (SELECT k, sum(n) a FROM c GROUP BY 1), b AS (SELECT c, sum(n) b FROM c GROUP BY 1), t AS (SELECT sum(n) t FROM c),
 j AS (SELECT sum(n/t*ln(n*t/(a*b))) mi, sum(n*(n-1)/2) s FROM c JOIN a USING (k) JOIN b USING (c), t), ha AS (SELECT sum(-a/t*ln(a/t)) h, sum(a*(a-1)/2) s FROM a, t), hb AS (SELECT sum(-b/t*ln(b/t)) h, sum(b*(b-1)/2) s FROM b, t), m AS (SELECT sum(m) m FROM (SELECT max(n) m FROM c GROUP BY k)),
 am AS (SELECT a, count(*) AS ka FROM a GROUP BY 1), bm AS (SELECT b, count(*) AS kb FROM b GROUP BY 1), ov AS (SELECT a, b, ka, kb, t, unnest(range(greatest(1, a+b-t)::bigint, least(a, b)::bigint + 1)) AS n FROM am, bm, t),
 em AS (SELECT sum(ka*kb*n/t*ln(t*n/(a*b))*exp(lgamma(a+1)+lgamma(b+1)+lgamma(t-a+1)+lgamma(t-b+1)-lgamma(t+1)-lgamma(n+1)-lgamma(a-n+1)-lgamma(b-n+1)-lgamma(t-a-b+n+1))) AS e FROM ov)
 SELECT round(m.m/t.t, 6) AS purity, round(mi/((ha.h+hb.h)/2), 6) AS nmi, round((mi - e)/((ha.h+hb.h)/2 - e), 6) AS ami, round((j.s - ha.s*hb.s/(t*(t-1)/2))/((ha.s+hb.s)/2 - ha.s*hb.s/(t*(t-1)/2)), 6) AS ari FROM j, ha, hb, m, t, em""")
def _(spark, d):
    df = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("k", F.col("vec_id") % 12)
    return rounded(ev.clustering_scores(df, "k", "label"), "purity", "nmi", "ami", "ari")


@query("e31_latest_records", "SELECT run, arg_min(value, (iter, name)) AS value FROM metrics WHERE iter = 0 GROUP BY 1")
def _(spark, d):
    from cloudloom.sources.fixtures import metrics

    return ev.latest_records(metrics(spark, d).where("iter = 0"), "run", "name").select("run", "value")


@query("e32_offset_error", "WITH e AS (SELECT cloud_id, avg((abs(x-y)+abs(y-z))/2) AS e FROM pts GROUP BY 1) SELECT round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std FROM e")
def _(spark, d):
    return rounded(ev.offset_error(points(spark, d), [("x", "y"), ("y", "z")]), "mean", "std")


@query("e6_miou_after_grid", """WITH mn AS (SELECT *, floor(x/4) - min(floor(x/4)) OVER w AS cx, floor(y/4) - min(floor(y/4)) OVER w AS cy, floor(z/4) - min(floor(z/4)) OVER w AS cz FROM pts WINDOW w AS (PARTITION BY cloud_id)),
 rep AS (SELECT *, first_value(pred) OVER (PARTITION BY cloud_id, cx, cy, cz ORDER BY point_id) AS cell_pred FROM mn),
 cm AS (SELECT label, cell_pred AS p, count(*) AS n FROM rep GROUP BY ALL), r AS (SELECT c::int AS class, coalesce(sum(n) FILTER (label=c AND p=c),0) tp, coalesce(sum(n) FILTER (label<>c AND p=c),0) fp, coalesce(sum(n) FILTER (label=c AND p<>c),0) fn FROM range(5) x(c), cm GROUP BY 1)
 SELECT class, round(tp/(tp+fp+fn), 6) AS iou, round(2*tp/(2*tp+fp+fn), 6) AS dice FROM r""")
def _(spark, d):
    back = grid.cells(points(spark, d), 4.0).withColumn("cell_pred", grid.of_first_in_cell("pred"))
    m = ev.class_metrics(ev.rates(ev.confusion(back, pred="cell_pred", by=()), 5, by=()))
    return rounded(m.select("class", "iou", "dice"), "iou", "dice")
