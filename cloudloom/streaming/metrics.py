"""Streams of metric records and confusion counts (T1-T4); each has the same result in batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smoothed(metrics: DataFrame, size: int) -> DataFrame:
    """T2, W7 in batch: mean, median and latest of the trailing ``size`` values, and the mean so far."""
    w = Window.partitionBy("run", "name").orderBy("iter")
    tail = w.rowsBetween(-(size - 1), 0)
    return metrics.withColumns({"mean": F.avg("value").over(tail), "median": F.expr(f"percentile(value, 0.5) over (partition by run, name order by iter rows {size - 1} preceding)"), "global": F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, 0))})


def best_so_far(metrics: DataFrame) -> DataFrame:
    """T3, W8 in batch: the greatest value so far and whether this one is a new best."""
    w = Window.partitionBy("run", "name").orderBy("iter")
    before = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return metrics.withColumns({"best": F.greatest("value", before), "new_best": before.isNull() | (F.col("value") > before)})


def running_confusion(counts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Running totals of (label, pred) over arriving per-cloud counts (ts, cloud_id, label, pred, n).

    A cell of a cloud counts once: copies that arrive within the delay are dropped, later ones as late data. The same
    call works on a batch.
    """
    key = ["cloud_id", "label", "pred"]
    once = counts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key) if counts.isStreaming else counts.dropDuplicates(key)
    return once.groupBy("label", "pred").agg(F.sum("n").alias("n"))


def hourly_confusion(counts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """T1 in tumbling hours of event time; late data beyond the delay is dropped."""
    rows = counts.withWatermark("ts", delay) if counts.isStreaming else counts
    return rows.groupBy(F.window("ts", "1 hour").alias("hour"), "label", "pred").agg(F.sum("n").alias("n")).withColumn("hour", F.col("hour.start"))


def smoothed_stream(metrics: DataFrame, size: int) -> DataFrame:
    """T2 on a stream: the state of a series is its last values, its sum and its count; one row out for each row in."""
    out = "run bigint, name string, iter bigint, value double, mean double, median double, global double"

    def step(key, batches, state):
        tail, total, n = (list(state.get[0]), *state.get[1:]) if state.exists else ([], 0.0, 0)
        rows = pd.concat(list(batches)).sort_values("iter")
        found = []
        for it, v in zip(rows["iter"], rows["value"]):
            tail, total, n = (tail + [float(v)])[-size:], total + float(v), n + 1
            found.append((key[0], key[1], it, v, sum(tail) / len(tail), float(pd.Series(tail).median()), total / n))
        state.update((tail, total, n))
        yield pd.DataFrame(found, columns=["run", "name", "iter", "value", "mean", "median", "global"])

    return metrics.select("run", "name", "iter", "value").groupBy("run", "name").applyInPandasWithState(step, out, "tail array<double>, total double, n long", "append", "NoTimeout")
