"""Evaluation of labelled points (E*): one confusion count, everything else an aggregate of it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.tables import materialise

BACKGROUND = 0
FIRST, LAST = 1, 24
#: The last rib of one side and the first of the other: neighbours by number, far apart in the body.
SIDES = (12, 13)


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Counts of (label, pred), for each cloud unless told otherwise."""
    return df.groupBy(*by, F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))


def rates(cm: DataFrame, classes: int, ignore: Sequence[int] = (), by: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Tp, fp, fn, tn of every class of every group; rows whose label is ignored don't count."""
    kept = cm.where(~F.col("label").isin(*ignore)) if ignore else cm
    every = F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))
    groups = cm.select(*by).distinct().withColumn("class", every) if by else cm.sparkSession.range(1).select(every.alias("class"))
    both = F.explode(F.array(F.struct(F.col("label").alias("class"), F.lit(1).alias("truth")), F.struct(F.col("pred").alias("class"), F.lit(0).alias("truth"))))
    sides = kept.withColumn("side", both).select(*by, "side.*", "n", (F.col("label") == F.col("pred")).alias("hit"))
    sums = sides.groupBy(*by, "class").agg(
        F.sum(F.when(F.col("hit") & (F.col("truth") == 1), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("hit") & (F.col("truth") == 0), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~F.col("hit") & (F.col("truth") == 1), F.col("n")).otherwise(0)).alias("fn"),
    )
    total = kept.groupBy(*by).agg(F.sum("n").alias("total"))
    out = groups.join(sums, [*by, "class"], "left").na.fill(0, ["tp", "fp", "fn"])
    out = out.join(total, list(by), "left") if by else out.crossJoin(F.broadcast(total))  # one row
    return out.withColumn("tn", F.coalesce("total", F.lit(0)) - F.col("tp") - F.col("fp") - F.col("fn")).drop("total")


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0: not applicable, never 0."""
    return F.try_divide(a.cast("double"), b)


def class_metrics(r: DataFrame) -> DataFrame:
    """Overlap and rate metrics of each class; null where not applicable."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return r.withColumns({
        "iou": ratio(tp, tp + fp + fn), "dice": ratio(2 * tp, 2 * tp + fp + fn), "recall": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp),
        "specificity": ratio(tn, tn + fp), "accuracy": ratio(tp + tn, tp + fp + fn + tn),
    })


def summable(m: DataFrame, metrics: Sequence[str] = ("iou", "dice", "recall", "precision")) -> DataFrame:
    """For each class the sum of a metric over the groups and how many it applies to."""
    return m.groupBy("class").agg(*[x for c in metrics for x in (F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))])


def mean_iou(r: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean IoU and mean accuracy over all classes, absent ones as 0, and the share of right points."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return r.groupBy(*by).agg(
        F.avg(tp / (tp + fp + fn + F.lit(1e-10))).alias("miou"), F.avg(tp / (tp + fn + F.lit(1e-10))).alias("macc"), (F.sum("tp") / (F.sum(tp + fn) + F.lit(1e-10))).alias("all_acc")
    )


def f_beta(r: DataFrame, beta: float = 1.0) -> DataFrame:
    """F-beta of each class."""
    b = beta * beta
    return r.withColumn("f", (1 + b) * F.col("tp") / ((1 + b) * F.col("tp") + b * F.col("fn") + F.col("fp") + F.lit(1e-10)))


def _sums():
    """n of the pairs (label, pred) that meet a condition, as an aggregate."""
    return lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))


def error_rates(cm: DataFrame, by: Sequence[str] = ("cloud_id",), bg: int = BACKGROUND) -> DataFrame:
    """Foreground missed (fnr, of the foreground), background taken (fpr, of the background), the wrong class among what
    is foreground in both (wpr), right and wrong shares of all points (cr, wr), the three kinds' shares of the wrong points
    (_conditional), and predicted over true foreground. Null without a denominator."""
    s, fg, pfg = _sums(), F.col("label") != bg, F.col("pred") != bg
    wrong = F.col("label") != F.col("pred")
    fn, fp, wp = s(fg & ~pfg), s(~fg & pfg), s(fg & pfg & wrong)
    return cm.groupBy(*by).agg(
        ratio(fn, s(fg)).alias("fnr"), ratio(fp, s(~fg)).alias("fpr"), ratio(wp, s(fg & pfg)).alias("wpr"), ratio(s(~wrong), F.sum("n")).alias("cr"), ratio(s(wrong), F.sum("n")).alias("wr"),
        ratio(fn, s(wrong)).alias("fnr_conditional"), ratio(fp, s(wrong)).alias("fpr_conditional"), ratio(wp, s(wrong)).alias("wpr_conditional"), ratio(s(pfg), s(fg)).alias("fg_ratio"),
    )


def across_sides() -> Column:
    return (F.least("label", "pred") == SIDES[0]) & (F.greatest("label", "pred") == SIDES[1])


def _shifts():
    """Foreground in both; a neighbouring rib there; one farther away, 12 and 13 among these."""
    rib = (F.col("label") != BACKGROUND) & (F.col("pred") != BACKGROUND)
    apart = F.abs(F.col("label") - F.col("pred"))
    return rib, rib & (apart == 1) & ~across_sides(), rib & ((apart > 1) | across_sides())


def rib_shift_rates(cm: DataFrame, by: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Of the points that are ribs in both, the shares taken for a neighbouring rib and for one farther away (12 and 13
    are far); _conditional: of the wrong ones among them."""
    s, (rib, near, far) = _sums(), _shifts()
    wrong = rib & (F.col("label") != F.col("pred"))
    return cm.groupBy(*by).agg(
        ratio(s(near), s(rib)).alias("near_rate"), ratio(s(far), s(rib)).alias("far_rate"), ratio(s(near), s(wrong)).alias("near_conditional"), ratio(s(far), s(wrong)).alias("far_conditional")
    )


def class_shift_rates(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For every class 1 to 24 of each group the points that are ribs in both (12 and 13 taken for each other left out), and
    the shares of them taken for a neighbouring rib and for one farther away; null where there are none."""
    s, (rib, near, far) = _sums(), _shifts()
    counts = cm.groupBy(*by, "label").agg(s(rib & ~across_sides()).alias("n"), s(near).alias("_near"), s(far & ~across_sides()).alias("_far"))
    every = F.explode(F.sequence(F.lit(FIRST), F.lit(LAST))).alias("label")
    groups = cm.select(*by).distinct().select(*by, every) if by else cm.sparkSession.range(1).select(every)
    out = groups.join(counts, [*by, "label"], "left").na.fill(0, ["n", "_near", "_far"])
    return out.select(*by, "label", "n", ratio(F.col("_near"), F.col("n")).alias("near_rate"), ratio(F.col("_far"), F.col("n")).alias("far_rate"))


def shift_summary(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The shift rates over all ribs, the left and the right ones (by label), with 12 and 13 taken for each other left out;
    how many points that is, the background's share of all points, fnr and fpr."""
    s, (rib, near, far) = _sums(), _shifts()
    rib, far = rib & ~across_sides(), far & ~across_sides()
    left, right = F.col("label").between(FIRST, SIDES[0]), F.col("label").between(SIDES[1], LAST)
    bg, pbg = F.col("label") == BACKGROUND, F.col("pred") == BACKGROUND
    rates_of = {f"{name}{side}": ratio(s(kind & of), s(rib & of)) for name, kind in (("near", near), ("far", far)) for side, of in (("", F.lit(True)), ("_left", left), ("_right", right))}
    return cm.groupBy(*by).agg(
        s(rib).alias("n_consensus"), ratio(s(bg), F.sum("n")).alias("bg_ratio"), *[v.alias(k) for k, v in rates_of.items()],
        ratio(s(~bg & pbg), s(~bg)).alias("fnr"), ratio(s(bg & ~pbg), s(bg)).alias("fpr"),
    )


def integrity(cm: DataFrame) -> DataFrame:
    """For each true rib of a cloud its points predicted as any rib (recognised), the share of the commonest prediction among
    them (ties to the smaller), the number of different predictions, and their counts. A rib wholly missed has no share."""
    seen = (F.col("label") != BACKGROUND) & (F.col("pred") != BACKGROUND)
    best = F.max(F.when(seen, F.struct("n", (-F.col("pred")).alias("p"))))
    per = cm.where(F.col("label") != BACKGROUND).groupBy("cloud_id", "label").agg(
        F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("recognised"), best.alias("_b"), F.count_if(seen).alias("fragments"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(seen, F.struct("pred", "n"))))).alias("distribution"),
    )
    return per.select("cloud_id", "label", "recognised", (-F.col("_b.p")).alias("dominant"), ratio(F.col("_b.n"), F.col("recognised")).alias("share"), "fragments", "distribution")


def integrity_summary(per_rib: DataFrame) -> DataFrame:
    """For each cloud the mean share over its recognised ribs, and the share weighted by their points, which is that of all
    recognised points that have their rib's commonest prediction."""
    weighted = ratio(F.sum(F.round(F.col("share") * F.col("recognised"))), F.sum("recognised"))
    return per_rib.groupBy("cloud_id").agg(F.avg("share").alias("mean_integrity"), weighted.alias("weighted_mean_integrity"), weighted.alias("global_integrity"))


def foreground_purity(cm: DataFrame, small: float = 0.05) -> DataFrame:
    """For each rib of each cloud, of its recognised points (predicted as a rib) the share of the commonest prediction
    (purity), of the right one (recall), and how many predictions hold at least ``small`` of them (fragments); coverage is the
    recognised share of the rib. state: scored, unrecognised (coverage only) or absent (nothing). label_recall: the right
    points among all of the rib, for E18."""
    n, right, found = F.col("n"), F.col("label") == F.col("pred"), F.col("pred") != BACKGROUND
    ribs = cm.where(F.col("label") != BACKGROUND).withColumn("_found", F.sum(F.when(found, n).otherwise(0)).over(Window.partitionBy("cloud_id", "label")))
    per = ribs.groupBy("cloud_id", "label").agg(
        F.sum("n").alias("size"), F.max("_found").alias("found"), F.sum(F.when(right, n).otherwise(0)).alias("right"), F.max(F.when(found, n)).alias("most"),
        F.count_if(found & (n / F.col("_found") >= small)).alias("fragments"),
    )
    every = cm.select("cloud_id").distinct().withColumn("label", F.explode(F.sequence(F.lit(FIRST), F.lit(LAST))))
    out = every.join(per, ["cloud_id", "label"], "left")
    state = F.when(F.col("size").isNull(), "absent").when(F.col("found") == 0, "unrecognised").otherwise("scored")
    return out.select(
        "cloud_id", "label", state.alias("state"), ratio(F.col("most"), F.col("found")).alias("purity"), ratio(F.col("right"), F.col("found")).alias("recall"),
        ratio(F.col("found"), F.col("size")).alias("coverage"), F.when(F.col("found") > 0, F.col("fragments")).alias("fragments"), ratio(F.col("right"), F.col("size")).alias("label_recall"),
    )


def purity_summary(p: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row over all pairs of cloud and rib: statistics of the scored pairs, counts of the other states, the mean coverage of
    the pairs that aren't absent, and the tail of purity below ``threshold``."""
    scored = F.col("state") == "scored"
    tail = F.when(scored & (F.col("purity") < threshold), F.col("purity"))
    low = scored & (F.col("purity") < 0.95)
    share = lambda c: F.avg(F.when(scored, c.cast("int")))
    return p.agg(
        F.count_if(scored).alias("scored"), F.count_if(F.col("state") == "absent").alias("absent"), F.count_if(F.col("state") == "unrecognised").alias("unrecognised"),
        F.avg("purity").alias("mean"), F.min("purity").alias("least"), F.median("purity").alias("median"), F.max("purity").alias("most"),
        F.avg("fragments").alias("fragments_mean"), share(F.col("fragments") > 1).alias("fragments_gt1"), share(F.col("fragments") == 0).alias("fragments_eq0"),
        share(F.col("purity") < 0.95).alias("lt95"), F.countDistinct(F.when(low, F.col("cloud_id"))).alias("lt95_clouds"), F.avg("coverage").alias("coverage"),
        F.count(tail).alias("tail"), F.median(tail).alias("tail_median"), F.max(tail).alias("tail_max"), F.min(tail).alias("tail_min"),
    )


def label_accuracy(p: DataFrame, recall: float = 0.7) -> DataFrame:
    """For each cloud the share of present ribs with a recall above the limit: all, first, middle and last ribs."""
    number = F.when(F.col("label") > SIDES[0], F.col("label") - SIDES[0]).otherwise(F.col("label"))
    ok = F.when(F.col("state") != "absent", (F.col("label_recall") > recall).cast("int"))
    group = lambda c: F.avg(F.when(c, ok))
    return p.groupBy("cloud_id").agg(F.avg(ok).alias("all_acc"), group(number == 1).alias("first_acc"), group((number > 1) & (number < 12)).alias("middle_acc"), group(number == 12).alias("last_acc"))


def cloud_class_metrics(r: DataFrame) -> DataFrame:
    """Metrics with the not-applicable rules for a class of a cloud: all of them are null for a class absent in both; recall is
    null without truth, precision without predictions. Specificity without negatives is 1 where nothing is predicted negative
    either, else 0. Counters tell which side was empty."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    truth, guess = tp + fn, tp + fp
    none = (truth == 0) & (guess == 0)
    held = lambda c: F.when(~none, c)
    return r.select(
        "cloud_id", "class", held(ratio(tp, truth + fp)).alias("iou"), held(ratio(2 * tp, truth + guess)).alias("dice"), held(ratio(tp, truth)).alias("recall"), held(ratio(tp, guess)).alias("precision"),
        held(F.coalesce(ratio(tn, tn + fp), F.when(fn == 0, 1.0).otherwise(0.0))).alias("specificity"), held(ratio(tp + tn, tp + fp + fn + tn)).alias("accuracy"),
        (none.cast("int")).alias("both_empty"), ((truth == 0) & (guess > 0)).cast("int").alias("truth_empty"), ((truth > 0) & (guess == 0)).cast("int").alias("pred_empty"),
    )


def reduced(m: DataFrame, metric: str) -> DataFrame:
    """The metric averaged by class, then over classes; and by cloud, then over clouds. Nulls are skipped."""
    by_class = m.groupBy("class").agg(F.avg(metric).alias("v")).agg(F.avg("v").alias("class_mean"))
    by_cloud = m.groupBy("cloud_id").agg(F.avg(metric).alias("v")).agg(F.avg("v").alias("cloud_mean"))
    return by_class.crossJoin(F.broadcast(by_cloud))  # one row each


def distribution(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, population deviation, extremes and linear percentiles, nulls and NaN skipped."""
    v = F.when(~F.isnan(value), F.col(value))
    p = lambda q: F.percentile(v, q)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"), F.median(v).alias("median"), p(0.05).alias("p5"), p(0.95).alias("p95"))


def bootstrap_mean(df: DataFrame, value: Column | str, n_resamples: int, alpha: float, seed: int, key: str = "cloud_id", chunk: int = 8_192) -> DataFrame:
    """The mean of a value, such as the difference of two metrics, and its bootstrap interval; a resample draws n of the n
    rows with replacement.

    Without rows the mean is null; with one there are no bounds. The rows are numbered by ``key`` over ranges, and their
    n * n_resamples draws, made ``chunk`` at a time, meet them by a shuffled join.
    """
    from cloudloom.functions.random import draw
    from cloudloom.functions.ranking import global_rank

    held = df.select(F.col(key).alias("_key"), (F.col(value) if isinstance(value, str) else value).alias("value")).where("value is not null")
    rows = materialise(global_rank(held, ["_key", "value"], "at").select((F.col("at") - 1).alias("at"), "value"))
    whole = rows.agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: small rows of chunks become many draws
    resamples = df.sparkSession.range(n_resamples).select(F.col("id").alias("b")).crossJoin(F.broadcast(whole.where("n > 1").select("n")))  # one row
    chunks = resamples.select("b", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk))).alias("_c")).repartition(tasks, "b", "_c")
    places = F.sequence(F.col("_c") * chunk, F.least((F.col("_c") + 1) * chunk, F.col("n")) - 1)
    draws = chunks.select("b", "n", F.explode(places).alias("i")).select("b", F.floor(draw(seed, "b", "i") * F.col("n")).alias("at"))
    # the planner takes the draws for as few rows as there are resamples and would broadcast them
    means = draws.hint("merge").join(rows, "at").groupBy("b").agg(F.avg("value").alias("m"))
    bounds = means.agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"))
    return whole.select("mean").crossJoin(F.broadcast(bounds))  # one row each


def row_normalised(cm: DataFrame) -> DataFrame:
    """Shares of each label's predictions over all clouds."""
    total = cm.groupBy("label", "pred").agg(F.sum("n").alias("n"))
    return total.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def part_iou(df: DataFrame, parts: int, category: str) -> DataFrame:
    """For each category the mean over its clouds of the mean part IoU; a part absent in both counts as 1."""
    r = rates(confusion(df), parts)
    per = r.withColumn("iou", F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")), F.lit(1.0))).groupBy("cloud_id").agg(F.avg("iou").alias("iou"))
    return per.join(df.select("cloud_id", category).distinct(), "cloud_id").groupBy(category).agg(F.avg("iou").alias("iou"), F.count("*").alias("clouds"))


def vote(probs: DataFrame, keys: Sequence[str] = ("cloud_id", "point_id")) -> DataFrame:
    """Sum class probabilities over fragments and copies; the best class, ties to the smaller, and the sum."""
    sums = probs.groupBy(*keys, "class").agg(F.sum("p").alias("p"))
    best = F.max(F.struct(F.col("p"), (-F.col("class")).alias("c")))
    return sums.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.c")).alias("pred"), F.col("b.p").alias("score"))


def _expected_terms(a: int, sizes: np.ndarray, times: np.ndarray, t: int) -> float:
    """The expected mutual information that a cluster of size a has with classes of these sizes, each so many times.

    An overlap's odds are hypergeometric. They follow from those of the mode by the ratios of neighbours and are divided by their
    sum, so no factorial is needed. Overlaps farther from the mean than 12 deviations and 40 have odds under e^-60 in all.
    """
    total = 0.0
    for b, m in zip(sizes.tolist(), times.tolist()):
        mean = a * b / t
        reach = 12 * (mean * (1 - a / t) * (t - b) / max(1, t - 1)) ** 0.5 + 40
        low, high = max(0, a + b - t, int(mean - reach)), min(a, b, int(mean + reach) + 1)
        n = np.arange(low, high + 1, dtype=np.float64)
        steps = np.log((a - n[:-1]) * (b - n[:-1])) - np.log(n[1:] * (t - a - b + n[1:]))
        odds = np.concatenate([[0.0], np.cumsum(steps)])
        odds = np.exp(odds - odds.max())
        some = n > 0
        total += m * float((odds[some] * n[some] / t * (np.log(n[some] / a) + np.log(t / b))).sum() / odds.sum())
    return total


def expected_information(a: DataFrame, b: DataFrame, t: DataFrame) -> DataFrame:
    """One row, emi: the mutual information expected of margins a (a, a_times) and b (b, b_times) of a table of t (t) rows.

    Sizes of b are sent to the tasks: k different sizes need k(k+1)/2 rows, so there are at most the root of 2t, a few MB.
    """
    total = t.first()[0] or 0
    got = b.select("b", "b_times").toArrow()
    sent = a.sparkSession.sparkContext.broadcast((got["b"].to_numpy().astype(np.int64), got["b_times"].to_numpy().astype(np.int64)))

    def run(batches):
        sizes, times = sent.value
        for batch in batches:
            own = [m * _expected_terms(x, sizes, times, total) for x, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.float64())], ["emi"])

    return a.select("a", "a_times").mapInArrow(run, "emi double").agg(F.sum("emi").alias("emi"))


def clustering_scores(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Purity, normalised and adjusted mutual information (arithmetic means) and adjusted Rand index from the contingency table.

    The expected mutual information runs over the pairs of different margins, clusters' and classes' sizes, and the overlaps
    around the mean of each; equal margins are counted once.
    """
    c = df.groupBy(F.col(cluster).alias("k"), F.col(label).alias("c")).agg(F.count("*").cast("double").alias("n"))
    a, b = c.groupBy("k").agg(F.sum("n").alias("a")), c.groupBy("c").agg(F.sum("n").alias("b"))
    total = c.agg(F.sum("n").alias("t"))
    pairs = lambda x: x * (x - 1) / 2
    cells = c.join(a, "k").join(b, "c").crossJoin(F.broadcast(total))
    joint = cells.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"), F.sum(pairs(F.col("n"))).alias("s"), F.max("t").alias("t"))
    h = lambda m, x: m.crossJoin(F.broadcast(total)).agg(F.sum(-F.col(x) / F.col("t") * F.ln(F.col(x) / F.col("t"))).alias(f"h{x}"), F.sum(pairs(F.col(x))).alias(f"s{x}"))
    top = c.groupBy("k").agg(F.max("n").alias("m")).agg(F.sum("m").alias("m"))
    sizes = lambda m, x: m.groupBy(F.col(x).cast("bigint").alias(x)).agg(F.count("*").alias(f"{x}_times"))
    emi = expected_information(sizes(a, "a"), sizes(b, "b"), total.select(F.col("t").cast("bigint")))
    one = joint.crossJoin(h(a, "a")).crossJoin(h(b, "b")).crossJoin(top).crossJoin(emi)  # single rows
    expected = F.col("sa") * F.col("sb") / pairs(F.col("t"))
    mean = (F.col("ha") + F.col("hb")) / 2
    return one.select(
        (F.col("m") / F.col("t")).alias("purity"), F.try_divide(F.col("mi"), mean).alias("nmi"), F.try_divide(F.col("mi") - F.col("emi"), mean - F.col("emi")).alias("ami"),
        F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected).alias("ari"),
    )


def relabelled_scores(df: DataFrame, mapping: DataFrame, cluster: str, label: str) -> DataFrame:
    """E30 after C8: accuracy and macro precision, recall and F1 (0 where nothing is predicted or true) of clusters renamed by
    ``mapping`` (cluster, label); clusters that it doesn't name become class 0."""
    named = df.groupBy(F.col(cluster).alias("_k"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    names = mapping.select(F.col(cluster).alias("_k"), F.col(label).alias("pred"))
    cm = named.join(names, "_k", "left").select("label", F.coalesce("pred", F.lit(0)).alias("pred"), "n")
    both = F.explode(F.array(F.struct(F.col("label").alias("class"), F.lit(1).alias("truth")), F.struct(F.col("pred").alias("class"), F.lit(0).alias("truth"))))
    s = _sums()
    per = cm.select("n", (F.col("label") == F.col("pred")).alias("hit"), both.alias("side")).select("n", "hit", "side.*").groupBy("class").agg(
        s(F.col("hit") & (F.col("truth") == 1)).alias("tp"), s(F.col("truth") == 1).alias("true"), s(F.col("truth") == 0).alias("guessed")
    )
    zero = lambda x, y: F.coalesce(ratio(x, y), F.lit(0.0))
    return per.agg(
        ratio(F.sum("tp"), F.sum("true")).alias("acc"), F.avg(zero(F.col("tp"), F.col("guessed"))).alias("precision"), F.avg(zero(F.col("tp"), F.col("true"))).alias("recall"),
        F.avg(zero(2 * F.col("tp"), F.col("true") + F.col("guessed"))).alias("f1"),
    )


def cloud_record(cm: DataFrame, classes: int) -> DataFrame:
    """One row for each cloud: arrays of the class metrics (E9, by class, null where not applicable), the number of points, error
    rates (E12), shift rates (E13, and the sides of E14), integrity (E15), purity arrays of the ribs (E16) and label accuracy (E18)."""
    per = cloud_class_metrics(rates(cm, classes))
    metrics = ("iou", "dice", "precision", "recall", "specificity", "accuracy")
    by_class = lambda rows, order, names: rows.groupBy("cloud_id").agg(F.array_sort(F.collect_list(F.struct(order, *names))).alias("_v")).select("cloud_id", *[F.col(f"_v.{c}").alias(f"{c}_cw") for c in names])
    purity = foreground_purity(cm)
    sides = shift_summary(cm, ["cloud_id"]).select("cloud_id", "near_left", "near_right", "far_left", "far_right")
    out = by_class(per, "class", metrics).join(cm.groupBy("cloud_id").agg(F.sum("n").alias("n_points")), "cloud_id")
    for part in (error_rates(cm), rib_shift_rates(cm), sides, label_accuracy(purity), by_class(purity.select("cloud_id", "label", "purity", F.col("recall").alias("fg_recall"), "fragments", "coverage"), "label", ("purity", "fg_recall", "fragments", "coverage"))):
        out = out.join(part, "cloud_id")
    return out.join(integrity_summary(integrity(cm)), "cloud_id", "left")  # a cloud without true ribs has no integrity


def latest_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """One record for each key, the first by order."""
    return records.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rank = 1").drop("_rank")


def offset_error(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Mean absolute error over a cloud's points, then its mean and population deviation over clouds."""
    error = sum((F.abs(F.col(a) - F.col(b)) for a, b in pairs), F.lit(0.0)) / len(pairs)
    return df.groupBy("cloud_id").agg(F.avg(error).alias("e")).agg(F.avg("e").alias("mean"), F.stddev_pop("e").alias("std"))
