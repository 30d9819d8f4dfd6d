"""Forms for tables much larger than those of the other tests: what a plan broadcasts, parts of files, growth of pairs."""

import numpy as np
from pyspark.sql import functions as F

from cloudloom.functions import tables
from cloudloom.operators import cluster, evaluate, neighbors
from cloudloom.plans import catalog
from cloudloom.sources import fixtures, formats, io
from cloudloom.streaming import stateful

from tests.conftest import SMALL


def test_draws_of_a_bootstrap_are_not_broadcast(spark):
    """The planner takes the draws for as few rows as there are resamples; chunks don't change the draws."""
    rows = spark.range(500).select(F.col("id").alias("cloud_id"), (F.col("id") % 7).cast("double").alias("v"))
    whole = evaluate.bootstrap_mean(rows, "v", 20, 0.1, 3)
    plan = whole._jdf.queryExecution().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "at#" in x and "Broadcast" in x]
    assert whole.collect() == evaluate.bootstrap_mean(rows, "v", 20, 0.1, 3, chunk=7).collect()


def test_parts_of_a_text_object_are_one_object(spark, tmp_path):
    """A file for each task that holds some of an object: its number and class are those of the whole."""
    rows = spark.range(60).selectExpr("concat('room/', if(id < 30, 'chair_', 'lamp_'), id div 15 % 2) cloud", "id % 15 point_id", "double(id) x", "double(0) y", "double(0) z")
    formats.write_clouds(rows, str(tmp_path / "out"), "cloud_txt", points_per_part="4")
    got = io.text_points(spark, str(tmp_path / "out/*/*.txt"), ["x", "y", "z"]).collect()
    assert sorted((int(r.x), r["class"], r.instance) for r in got) == [(i, "chair" if i < 30 else "lamp", i // 15) for i in range(60)]


def test_cells_meet_their_neighbours_across_blocks(spark):
    """Every pair of near cells once, over borders of blocks, negative places and turns of a task; no row for each of the 62 places around."""
    rng = np.random.default_rng(5)
    rows = [(c, lab, *map(int, v)) for c in (1, 2) for lab in (0, 1) for v in np.unique(rng.integers(-20, 20, (400, 3)) // (2, 4, 3) * (1, 1, 2), axis=0)]
    boxes = spark.createDataFrame([(c, lab, x, y, z, 1, n, float(x), float(x), float(y), float(y), float(z), float(z)) for n, (c, lab, x, y, z) in enumerate(rows)], "cloud_id bigint, _l int, _cx bigint, _cy bigint, _cz bigint, _n bigint, _id bigint, _lox double, _hix double, _loy double, _hiy double, _loz double, _hiz double")
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and a[:2] == b[:2] and sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])) <= 5}
    for rows_of_a_turn in (1, 1 << 18):
        pairs = cluster._neighbour_cells(boxes, 5.0, rows_of_a_turn)
        got = [tuple(sorted((r.src, r.dst))) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_series_share_their_calls(spark, tmp_path):
    """2,000 series in two buckets of state: a call for each bucket and not for each series, and the same rows as series by series."""
    schema = "run bigint, name string, event_id bigint, ts timestamp, value double"
    rows = spark.range(4000).selectExpr("id % 2000 run", "'a' name", "id event_id", "timestamp_seconds(1704067200 + id) ts", "double(id * 37 % 101) value")
    end = spark.range(1).selectExpr("-1L run", "'end' name", "-1L event_id", "timestamp_seconds(1904067200) ts", "0D value")
    for part in (rows.where("event_id < 2000"), rows.where("event_id >= 2000"), end):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stateful.start(stateful.series_stream(arriving, 5, "9 seconds", buckets=2), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.event_id: r for r in stateful.all_batches(spark, str(tmp_path / "out"), stateful.SERIES).collect()}
    value = lambda i: float(i * 37 % 101)
    assert len(got) == 4000
    for i in range(2000):
        one, two = got[i], got[i + 2000]
        assert (one.iter, one.mean, one.best, one.new_best) == (0, value(i), value(i), True)
        assert (two.iter, two.mean, two.best, two.new_best) == (1, (value(i) + value(i + 2000)) / 2, max(value(i), value(i + 2000)), value(i + 2000) > value(i))


def test_points_are_dealt_in_parts_that_follow_the_table(spark, monkeypatch):
    """However many points there are, a task sorts and adds up what about DEALT of them give; results stay."""
    names = ("l10_sinkhorn", "e27_vote", "k4_top3_classes")
    want = {n: sorted(map(tuple, catalog.QUERIES[n](spark, SMALL).collect())) for n in names}
    monkeypatch.setattr(tables, "DEALT", 300)
    p = fixtures.points(spark, SMALL)
    parts = p.groupBy(F.spark_partition_id()).count().collect()
    assert p.rdd.getNumPartitions() == -(-p.count() // 300) and max(r["count"] for r in parts) < p.count() / 4
    for n in names:
        assert sorted(map(tuple, catalog.QUERIES[n](spark, SMALL).collect())) == want[n]


def test_radius_search_asks_few_cells_and_carries_columns(spark):
    """Every pair once, over borders of cells, with columns of both ends; a point among others of its cloud asks five cells at most on average."""
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.uniform(-6, 6, (300, 3)), rng.integers(-4, 5, (200, 3)) * 0.75, np.nextafter(rng.integers(-2, 3, (60, 3)) * 1.5, np.inf)])
    p = spark.createDataFrame([(i % 2, i, *map(float, x), i * 10) for i, x in enumerate(v)], "cloud_id bigint, point_id bigint, x double, y double, z double, own int")
    gap = lambda i, j: (v[i][0] - v[j][0]) ** 2 + (v[i][1] - v[j][1]) ** 2 + (v[i][2] - v[j][2]) ** 2
    for closed in (False, True):
        want = {(i, j) for i in range(len(v)) for j in range(len(v)) if i % 2 == j % 2 and (gap(i, j) <= 2.25 if closed else gap(i, j) < 2.25)}
        for other in (p, p.select("*")):  # a cloud with itself, and two clouds
            edges = neighbors.radius_edges(p, other, 1.5, closed=closed, carry=["own"])
            got = [tuple(r) for r in edges.select("src", "dst", "src_own", "dst_own").collect()]
            assert sorted(got) == sorted((i, j, i * 10, j * 10) for i, j in want)
    asked = neighbors.asked_cells(p, 1.5, [], True)
    assert asked.count() <= 5 * len(v)
    for name in ("l8_info_nce", "l9_instance_info_nce", "j11_ball_group"):
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1, name
