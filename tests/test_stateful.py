"""Streams with state against batch, out-of-order rows, and batches that run twice."""

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cloudloom.streaming import metrics, stateful

METRIC = "run bigint, name string, event_id bigint, ts timestamp, value double"


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_series_out_of_order_equal_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    rng, source = random.Random(4), str(tmp_path / "in")
    begin = datetime(2024, 1, 1)
    rows = [(i % 3, "ab"[i % 2], i, begin + timedelta(seconds=i, microseconds=rng.randrange(10**6)), float(rng.randrange(20))) for i in range(240)]
    rows.append((1, "a", 999, begin, None))
    late = sorted(rows[:240], key=lambda r: r[2] + rng.randrange(30))  # up to half a minute out of order
    for k in range(4):
        feed(spark, source, late[60 * k : 60 * k + 60] + rows[240:], METRIC)
    feed(spark, source, [(-1, "end", -1, begin + timedelta(days=9), 0.0)], METRIC)
    target = str(tmp_path / "out")
    for _ in range(2):  # nothing is left for the second run
        stateful.start(stateful.series_stream(stream(spark, source, METRIC), 5, "40 seconds"), target, str(tmp_path / "ck")).awaitTermination()
    got = sorted(tuple(r)[:-1] for r in stateful.all_batches(spark, target, stateful.SERIES).collect())
    plain = spark.createDataFrame(rows[:240], METRIC).withColumn("iter", F.row_number().over(Window.partitionBy("run", "name").orderBy("ts", "event_id")).cast("bigint") - 1)
    want = metrics.best_so_far(metrics.smoothed(plain, 5)).select("run", "name", "event_id", "iter", "mean", "median", F.coalesce("best", "value"), "new_best")
    want = sorted(map(tuple, want.collect()))
    assert len(got) == 240 and [g[:4] + g[5:] for g in got] == [w[:4] + w[5:] for w in want]
    assert all(abs(g[4] - w[4]) < 1e-9 for g, w in zip(got, want))


def test_late_rows_are_dropped(spark, tmp_path):
    from datetime import datetime, timedelta

    source, begin = str(tmp_path / "in"), datetime(2024, 1, 1)
    for k, at in enumerate((0, 100, 150, 1, 200, 10**6)):
        feed(spark, source, [(1, "a", k, begin + timedelta(seconds=at), float(k))], METRIC)
    stateful.start(stateful.series_stream(stream(spark, source, METRIC), 5, "5 seconds"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.event_id, r.iter) for r in stateful.all_batches(spark, str(tmp_path / "out"), stateful.SERIES).collect()) == [(0, 0), (1, 1), (2, 2), (4, 3)]


@pytest.mark.parametrize("crash", ["after the sink", "within the sink"])
def test_a_batch_that_runs_again_counts_once(spark, tmp_path, crash, monkeypatch):
    source, target, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    build = lambda df: df.groupBy("cloud_id").agg(F.count("*").alias("n"), F.sum("point_id").alias("ids"))
    schema, result = "cloud_id bigint, point_id bigint", "cloud_id bigint, n bigint, ids bigint"
    run = lambda: stateful.incremental_build(stream(spark, source, schema), build, target, ck).awaitTermination()
    feed(spark, source, [(c, p) for c in range(5) for p in range(10)], schema)
    run()
    feed(spark, source, [(c, p) for c in range(3, 8) for p in range(10, 14)], schema)
    if crash == "within the sink":
        real = stateful.batch_sink
        monkeypatch.setattr(stateful, "batch_sink", lambda target: lambda df, n: (df.limit(1).write.parquet(f"{target}/_left"), 1 / 0))
        with pytest.raises(Exception):
            run()
        monkeypatch.setattr(stateful, "batch_sink", real)
    else:
        run()
        last = max(int(x) for x in os.listdir(f"{ck}/commits") if x.isdigit())
        os.remove(f"{ck}/commits/{last}")  # as if the driver had died before the batch was marked as done
        os.path.exists(f"{ck}/commits/.{last}.crc") and os.remove(f"{ck}/commits/.{last}.crc")
    before = sorted(os.listdir(target))
    run()
    got = sorted(map(tuple, stateful.newest(spark, target, result, ["cloud_id"]).collect()))
    assert got == [(c, 10 * (c < 5) + 4 * (c >= 3), 45 * (c < 5) + 46 * (c >= 3)) for c in range(8)]
    if crash == "after the sink":
        assert sorted(os.listdir(target)) == before
        assert stateful.all_batches(spark, target, result).count() == 10


def test_totals_count_copies_once(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "cloud_id bigint, label int, pred int, n bigint, ts timestamp"
    rows = [(c, c % 2, 0, 5, None) for c in range(6)]
    for _ in range(2):
        spark.createDataFrame(rows, schema).withColumn("ts", F.lit("2026-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    stateful.running_totals(stream(spark, source, schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = stateful.newest(spark, str(tmp_path / "out"), "label int, pred int, n bigint", ["label", "pred"])
    assert sorted(map(tuple, got.collect())) == [(0, 0, 15), (1, 0, 15)]
