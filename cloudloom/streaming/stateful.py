"""Streams with their own state, and a sink that takes each batch once.

A batch is written to a folder named by its number, beside it first and then renamed, so a batch that runs again after a crash takes its
earlier result's place, and readers never see half of one. Results that later batches amend carry their key: ``newest`` reads the last of each.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

STORE = "spark.sql.streaming.stateStore.providerClass"
SERIES = "run bigint, name string, event_id bigint, iter bigint, mean double, median double, best double, new_best boolean"


# ---------------------------------------------------------------- exactly once


def batch_sink(target: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: batch n becomes target/batch=n, whatever an earlier attempt at it has left."""

    def write(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        part = f"{target}/_{uuid.uuid4().hex}"  # hidden from readers
        df.write.parquet(part)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        source, final = path(part), path(f"{target}/batch={n}")
        fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(final, True)
        if not fs.rename(source, final):
            raise OSError(f"batch {n} can't be moved to {target}")

    return write


def start(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", **options: str) -> StreamingQuery:
    """A query that writes what has arrived to a sink keyed by batch and stops; a later call with the same folders goes on from there.
    State is kept in RocksDB, so it may be larger than an executor's memory."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = stream.writeStream.foreachBatch(batch_sink(target)).outputMode(mode).options(**options)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)


def all_batches(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """Every batch's rows, with the batch's number."""
    return spark.read.schema(f"{schema}, batch bigint").parquet(target)


def newest(spark: SparkSession, target: str, schema: str, keys: list[str]) -> DataFrame:
    """The rows of the last batch that has their key."""
    rows = all_batches(spark, target, schema)
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, "_last.*")


def incremental_build(files: DataFrame, build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """T4: keeps what ``build`` (an aggregation by key) makes of all rows so far. Newly arrived rows amend the keys that they have; read the
    result with ``newest``. The checkpoint remembers what is done."""
    return start(build(files), target, checkpoint, "update")


def running_totals(counts: DataFrame, target: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Totals of (label, pred) over arriving per-cloud counts; read the result with ``newest``. Copies of a cloud's cell that arrive
    within the delay count once."""
    from cloudloom.streaming.metrics import running_confusion

    return start(running_confusion(counts, delay), target, checkpoint, "update")


# ---------------------------------------------------------------- series in the order of events


#: Waiting rows, then for each series its count, best and last values (``kept`` of them).
STATE = "w_run array<bigint>, w_name array<string>, w_at array<bigint>, w_event array<bigint>, w_value array<double>, run array<bigint>, name array<string>, n array<bigint>, best array<double>, kept array<int>, tail array<double>"


def series_step(size: int):
    """Rows wait until the watermark has passed them, then go through in the order of (time, event_id): the place of each in its series, mean
    and median of the last ``size`` values, the greatest value so far and whether it is a new one.

    A call takes the series of a bucket, as a call for each series takes longer than its work. The timeout is at the earliest waiting
    row; as Spark ends a timeout only after its millisecond, a row whose millisecond the watermark has just reached may wait for
    the next batch.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, series = [], {}
        if state.exists:
            *waiting, runs, names, counts, bests, kept, tails = state.get
            held, at = list(zip(*waiting)), 0
            for run, name, n, best, k in zip(runs, names, counts, bests, kept):
                series[run, name] = (n, best, list(tails[at : at + k]))
                at += k
        if not state.hasTimedOut:
            for pdf in batches:
                held += [r for r in zip(*(pdf[c].tolist() for c in ("run", "name", "at", "event_id", "value"))) if not math.isnan(r[4])]
        now = state.getCurrentWatermarkMs()
        ready, rest = sorted((r for r in held if r[2] <= now * 1000), key=lambda r: r[2:4]), [r for r in held if r[2] > now * 1000]
        out = []
        for run, name, _, event, value in ready:
            n, best, tail = series.get((run, name), (0, None, []))
            tail = [*tail, value][-size:]
            middle = sorted(tail)
            median = (middle[(len(tail) - 1) // 2] + middle[len(tail) // 2]) / 2
            first = best is None or value > best
            best = value if first else best
            out.append((run, name, event, n, sum(tail) / len(tail), median, best, first))
            series[run, name] = (n + 1, best, tail)
        waiting = [list(c) for c in zip(*rest)] or [[], [], [], [], []]
        held_series = list(series.items())
        state.update((*waiting, [k[0] for k, _ in held_series], [k[1] for k, _ in held_series], *([v[i] for _, v in held_series] for i in (0, 1)), [len(v[2]) for _, v in held_series], [x for _, v in held_series for x in v[2]]))
        if rest:
            state.setTimeoutTimestamp(max(-(-min(r[2] for r in rest) // 1000) - 1, now + 1))
        if out:
            yield pd.DataFrame(out, columns=["run", "name", "event_id", "iter", "mean", "median", "best", "new_best"])

    return step


def series_stream(metrics: DataFrame, size: int, delay: str, buckets: int = 1024) -> DataFrame:
    """T2, T3 on a stream of (run, name, event_id, ts, value): one row out for each that isn't late, once the watermark has passed it. Rows that
    come up to ``delay`` out of order take their place. Rows without a time or a value are left out. Series are dealt to ``buckets`` groups of
    state, of which each is held by a task at a time; streams with many millions of series need more of them."""
    rows = metrics.where("ts is not null and value is not null and run is not null and name is not null").withWatermark("ts", delay)
    rows = rows.select("run", "name", "event_id", "ts", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.pmod(F.hash("run", "name"), F.lit(buckets)).alias("bucket"))
    return rows.groupBy("bucket").applyInPandasWithState(series_step(size), SERIES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
