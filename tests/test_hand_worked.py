"""Evaluation and truncation against figures worked out by hand from the definitions."""

import pytest

from cloudloom.operators import cloud, cluster, evaluate


def table(spark, counts):
    """A confusion table of one cloud: {(label, pred): n}."""
    return spark.createDataFrame([(1, a, b, n) for (a, b), n in counts.items()], "cloud_id bigint, label int, pred int, n bigint")


CM = {(0, 0): 50, (0, 3): 10, (3, 3): 20, (3, 4): 30, (3, 0): 10, (12, 13): 8, (12, 12): 12, (13, 20): 5, (13, 13): 15, (5, 0): 4}


def test_error_rates(spark):
    r = evaluate.error_rates(table(spark, CM)).first()
    total, fg, both, wrong = 164, 104, 90, 10 + 30 + 10 + 8 + 5 + 4
    assert (r.fnr, r.fpr, r.wpr) == pytest.approx((14 / fg, 10 / 60, 43 / both))
    assert (r.cr, r.wr) == pytest.approx((97 / total, wrong / total))
    assert (r.fnr_conditional, r.fpr_conditional, r.wpr_conditional, r.fg_ratio) == pytest.approx((14 / wrong, 10 / wrong, 43 / wrong, 100 / fg))
    none = evaluate.error_rates(table(spark, {(0, 0): 5})).first()
    assert none.fnr is None and none.wpr is None and none.fpr_conditional is None and none.fpr == 0 and none.fg_ratio is None


def test_shift_rates(spark):
    r = evaluate.rib_shift_rates(table(spark, CM)).first()
    assert (r.near_rate, r.far_rate, r.near_conditional, r.far_conditional) == pytest.approx((30 / 90, 13 / 90, 30 / 43, 13 / 43))
    per = {x.label: x for x in evaluate.class_shift_rates(table(spark, CM)).collect()}
    assert len(per) == 24 and (per[3].n, per[3].near_rate, per[3].far_rate) == (50, 0.6, 0.0)
    assert (per[12].n, per[12].near_rate) == (12, 0.0) and (per[13].n, per[13].far_rate) == (20, 0.25) and per[5].near_rate is None
    s = evaluate.shift_summary(table(spark, CM)).first()
    assert s.n_consensus == 82 and (s.bg_ratio, s.near, s.near_left, s.near_right) == pytest.approx((60 / 164, 30 / 82, 30 / 62, 0))
    assert (s.far, s.far_left, s.far_right, s.fnr, s.fpr) == pytest.approx((5 / 82, 0, 5 / 20, 14 / 104, 10 / 60))


def test_integrity_and_purity(spark):
    per = evaluate.integrity(table(spark, CM))
    got = {r.label: r for r in per.collect()}
    assert (got[3].dominant, got[3].share, got[3].fragments, got[3].recognised) == (4, 0.6, 2, 50) and got[3].distribution == {3: 20, 4: 30}
    assert got[5].share is None and got[5].fragments == 0 and got[5].recognised == 0
    s = evaluate.integrity_summary(per).first()
    assert s.mean_integrity == pytest.approx((0.6 + 0.6 + 0.75) / 3) and s.weighted_mean_integrity == s.global_integrity == pytest.approx((30 + 12 + 15) / 90)
    p = {r.label: r for r in evaluate.foreground_purity(table(spark, CM)).collect()}
    assert (p[3].purity, p[3].recall, p[3].coverage, p[3].fragments, p[3].label_recall) == pytest.approx((0.6, 0.4, 50 / 60, 2, 20 / 60))
    assert p[5].state == "unrecognised" and p[5].coverage == 0 and p[5].purity is None and p[1].state == "absent" and p[1].coverage is None
    q = evaluate.purity_summary(evaluate.foreground_purity(table(spark, CM)), 0.7).first()
    assert (q.scored, q.absent, q.unrecognised, q.tail, q.lt95_clouds) == (3, 20, 1, 2, 1)
    assert (q.mean, q.tail_max, q.fragments_mean, q.coverage, q.lt95) == pytest.approx((0.65, 0.6, 2, (50 / 60 + 1 + 1 + 0) / 4, 1))
    acc = evaluate.label_accuracy(evaluate.foreground_purity(table(spark, CM)), 0.7).first()
    assert (acc.all_acc, acc.first_acc, acc.middle_acc, acc.last_acc) == pytest.approx((1 / 4, 1, 0, 0))


def test_rules_for_absent_classes(spark):
    got = {r["class"]: r for r in evaluate.cloud_class_metrics(evaluate.rates(table(spark, {(1, 1): 3, (1, 0): 1}), 3)).collect()}
    assert got[2].both_empty == 1 and all(got[2][m] is None for m in ("iou", "dice", "recall", "precision", "specificity", "accuracy"))
    assert got[0].truth_empty == 1 and got[0].recall is None and got[0].precision == 0 and got[0].specificity == 0.75
    assert got[1].specificity == 0  # no negatives, yet one predicted
    one = {r["class"]: r for r in evaluate.cloud_class_metrics(evaluate.rates(table(spark, {(1, 1): 3}), 2)).collect()}
    assert one[1].specificity == 1


def test_truncation_keeps_what_lies_strictly_beyond(spark):
    rows = [(1, k, float(z), rib) for k, (z, rib) in enumerate([(10, 1), (9, 1), (8, 2), (6, 14), (5, 3), (7, 0), (1, 12)])] + [(2, 0, 4.0, 1), (2, 1, 3.0, 5), (2, 2, 2.0, 0)]
    df = spark.createDataFrame(rows, "cloud_id bigint, point_id bigint, z double, rib int")
    kept = lambda *a, **k: {(r.cloud_id, r.point_id) for r in cloud.truncate_at_rib(df, *a, **k).collect()}
    assert kept(2, "s", "m") == {(1, 3), (1, 4), (1, 6), (2, 1), (2, 2)}  # pair 2 and 14 has its middle at 7; cloud 2 keeps ribs 3 to 12
    assert kept(2, "s", "b") == {(1, 4), (1, 6), (2, 1), (2, 2)}
    assert kept(1, "i", "b") == {(1, k) for k in range(6)} | {(2, 0), (2, 1), (2, 2)}  # pair 12 goes, with the points under its top
    assert kept(2, "s", "m", min_points=3) == {(1, 3), (1, 4), (1, 6), (2, 0), (2, 1), (2, 2)}


def test_average_precision_of_a_worked_case(spark):
    guesses = spark.createDataFrame([(1, 1, 1, 0.9, 10, 0), (1, 2, 1, 0.8, 10, 0), (1, 3, 1, 0.3, 10, 0), (1, 4, 1, 0.2, 10, 6), (1, 5, 3, 0.2, 10, 0)], "cloud_id bigint, inst bigint, class int, score double, size int, void int")
    truth = spark.createDataFrame([(1, 1, 1, 12), (1, 2, 1, 10), (1, 9, 2, 10)], "cloud_id bigint, gt bigint, class int, size int")
    overlaps = spark.createDataFrame([(1, 1, 1, 9), (1, 3, 2, 8)], "cloud_id bigint, inst bigint, gt bigint, inter int")
    got = {r["class"]: r.ap for r in cluster.average_precision(guesses, truth, overlaps, [0.5]).collect()}
    # scores 0.9 right, 0.8 false, 0.3 right; the one on void is excused. Points (p, r): (2/3, 1), (1/2, 1/2), (1, 1/2), then (1, 0)
    assert got[1] == pytest.approx(2 / 3 * 0.25 + 0.5 * 0.25 + 1 * 0.25 + 0.25)
    assert got[2] == 0 and got[3] is None


def test_anatomical_orientation(spark):
    rows = [(1, k, float(k % 2 * 10), float(k)) for k in range(6)] + [(2, 7, 3.0, 1.0), (2, 8, 3.0, 2.0)]
    df = spark.createDataFrame(rows, "cloud_id bigint, instance bigint, cx double, cz double")
    ribs = lambda **k: {(r.cloud_id, r.instance): r.rib for r in cluster.anatomical_labels(df, "cx", "cz", **k).collect()}
    assert ribs(right_is_higher=True) == {(1, 4): 1, (1, 2): 2, (1, 0): 3, (1, 5): 13, (1, 3): 14, (1, 1): 15, (2, 8): 1, (2, 7): 2}
    assert ribs(right_is_higher=False, superior_is_higher=True) == {(1, 1): 1, (1, 3): 2, (1, 5): 3, (1, 0): 13, (1, 2): 14, (1, 4): 15, (2, 7): 13, (2, 8): 14}


def test_adjusted_mutual_information_of_a_worked_case(spark):
    # two clusters of two points each against classes 0, 0, 0, 1: MI 0.2158, its expectation the same by symmetry of a single odd point
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 1)], "k int, c int")
    r = evaluate.clustering_scores(df, "k", "c").first()
    assert r.purity == 0.75 and r.ami == pytest.approx(0, abs=1e-9)
