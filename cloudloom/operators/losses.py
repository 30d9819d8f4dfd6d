"""Loss values as measurements over stored probabilities (L*): long rows (cloud_id, point_id, class, p, label)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cross_entropy(df: DataFrame, ignore: int = -1, smoothing: float = 0.0, weights: Mapping[int, float] | None = None, by=("cloud_id",)) -> DataFrame:
    """L1, L2: mean of -log p over the points, with class weights and label smoothing; ignored labels don't count."""
    w = F.lit(1.0) if weights is None else F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("label")]
    classes = df.agg(F.countDistinct("class").alias("_k"))
    rows = df.where(F.col("label") != ignore).crossJoin(F.broadcast(classes))  # one row
    target = F.when(F.col("class") == F.col("label"), 1.0 - smoothing).otherwise(0.0) + F.lit(smoothing) / F.col("_k")
    weight = F.when(F.col("class") == F.col("label"), w).otherwise(0.0)
    return rows.groupBy(*by).agg(F.try_divide(F.sum(-target * w * F.ln(F.greatest(F.col("p"), F.lit(1e-12)))), F.sum(weight)).alias("loss"))


def smoothed_cross_entropy(df: DataFrame, smoothing: float = 0.1, by=("cloud_id",)) -> DataFrame:
    """L2: the mean over points of the cross-entropy against a target that gives the other classes equal parts of ``smoothing``; points
    with a loss that isn't finite (a class of probability 0) don't count."""
    share = F.when(F.col("class") == F.col("label"), 1.0 - smoothing).otherwise(smoothing / (F.col("_k") - 1))
    classes = df.agg(F.countDistinct("class").alias("_k"))
    term = F.when(F.col("p") > 0, -share * F.ln("p"))  # null for p = 0
    one = df.crossJoin(F.broadcast(classes)).groupBy(*by, "point_id").agg(F.when(F.count(term) == F.count("*"), F.sum(term)).alias("_l"))  # one row
    return one.groupBy(*by).agg(F.avg("_l").alias("loss"))


def focal(df: DataFrame, gamma: float = 2.0, alpha: float = 0.5, by=("cloud_id",)) -> DataFrame:
    """L3, L4: sigmoid focal loss over classes, averaged over points and classes."""
    t = F.col("class") == F.col("label")
    pt = F.when(t, F.col("p")).otherwise(1 - F.col("p"))
    a = F.when(t, alpha).otherwise(1 - alpha)
    return df.groupBy(*by).agg(F.avg(-a * F.pow(1 - pt, F.lit(gamma)) * F.ln(F.greatest(pt, F.lit(1e-12)))).alias("loss"))


def dice(df: DataFrame, smooth: float = 1.0, exponent: float = 2.0, by=("cloud_id",)) -> DataFrame:
    """1 - soft Dice of each class, averaged over classes."""
    t = (F.col("class") == F.col("label")).cast("double")
    num, den = 2 * F.sum(F.col("p") * t) + smooth, F.sum(F.pow("p", F.lit(exponent)) + F.pow(t, F.lit(exponent))) + smooth
    return df.groupBy(*by, "class").agg((1 - num / den).alias("_d")).groupBy(*by).agg(F.avg("_d").alias("loss"))


def lovasz_softmax(df: DataFrame, by=("cloud_id",)) -> DataFrame:
    """Lovász extension of the Jaccard loss, averaged over the classes present in a group: errors in descending order,
    weighted by the steps of the cumulative Jaccard index."""
    fg = (F.col("class") == F.col("label")).cast("double")
    rows = df.withColumns({"_fg": fg, "_e": F.abs(fg - F.col("p"))})
    order = Window.partitionBy(*by, "class").orderBy(F.desc("_e"), "point_id")
    run, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by, "class")
    rows = rows.withColumns({"_c": F.sum("_fg").over(run), "_n": F.row_number().over(order), "_t": F.sum("_fg").over(whole)})
    jaccard = 1 - (F.col("_t") - F.col("_c")) / (F.col("_t") + F.col("_n") - F.col("_c"))
    rows = rows.where("_t > 0").withColumn("_j", jaccard)
    rows = rows.withColumn("_step", F.col("_j") - F.coalesce(F.lag("_j").over(order), F.lit(0.0)))
    return rows.groupBy(*by, "class").agg(F.sum(F.col("_e") * F.col("_step")).alias("_l")).groupBy(*by).agg(F.avg("_l").alias("loss"))


def offset_terms(df: DataFrame, pred: tuple[str, str, str], truth: tuple[str, str, str], by=("cloud_id",)) -> DataFrame:
    """Mean L1 distance of offsets and mean negative cosine between them."""
    l1 = sum((F.abs(F.col(a) - F.col(b)) for a, b in zip(pred, truth)), F.lit(0.0))
    norm = lambda c: F.sqrt(sum((F.col(x) ** 2 for x in c), F.lit(0.0))) + F.lit(1e-8)
    dot = sum((F.col(a) * F.col(b) for a, b in zip(pred, truth)), F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(l1).alias("l1"), F.avg(-dot / (norm(pred) * norm(truth))).alias("cosine"))


def info_nce(pairs: DataFrame, similarity: str, temperature: float, anchor: list[str], by=("cloud_id",)) -> DataFrame:
    """Per anchor -log of the share of its positives' exp(similarity / temperature) among all, then the mean over
    anchors and groups."""
    w = Window.partitionBy(*anchor)
    rows = pairs.withColumn("_s", F.col(similarity) / temperature).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    one = rows.groupBy(*anchor).agg(F.sum(F.when(F.col("positive"), F.col("_e")).otherwise(0.0)).alias("_p"), F.sum("_e").alias("_a")).where("_p > 0")
    return one.groupBy(*by).agg(F.avg(-F.ln(F.col("_p") / F.col("_a"))).alias("loss"))


def instance_info_nce(pairs: DataFrame, similarity: str, temperature: float, anchor: list[str], label: str) -> DataFrame:
    """The anchors' terms (as in info_nce) averaged over the anchors of a class, then the classes of a cloud, then clouds."""
    per_class = info_nce(pairs, similarity, temperature, [*anchor, label], ("cloud_id", label))
    return per_class.groupBy("cloud_id").agg(F.avg("loss").alias("loss")).agg(F.avg("loss").alias("loss"))


def sinkhorn(df: DataFrame, row: str, column: str, value: str, rounds: int = 3) -> DataFrame:
    """Alternate normalisation of columns and rows of a long matrix."""
    out = df
    for _ in range(rounds):
        for key in (column, row):
            out = out.withColumn(value, F.col(value) / F.sum(value).over(Window.partitionBy("cloud_id", key)))
    return out


def mask_terms(df: DataFrame, p: str, t: str, by: list[str]) -> DataFrame:
    """Dice, binary cross-entropy and soft IoU of predicted and true masks."""
    x, y = F.col(p), F.col(t).cast("double")
    bce = -(y * F.ln(F.greatest(x, F.lit(1e-12))) + (1 - y) * F.ln(F.greatest(1 - x, F.lit(1e-12))))
    hard = (x > 0.5).cast("double")
    return df.groupBy(*by).agg(
        (1 - (2 * F.sum(x * y) + 1) / (F.sum(x) + F.sum(y) + 1)).alias("dice"), F.avg(bce).alias("bce"), F.try_divide(F.sum(hard * y), F.sum(F.greatest(hard, y))).alias("iou")
    )


def weighted_total(parts: Mapping[str, float]) -> Column:
    """A weighted sum of loss columns."""
    return sum((F.col(c) * w for c, w in parts.items()), F.lit(0.0))
