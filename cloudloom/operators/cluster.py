"""Clusters and instances (C*, E24, E25, R17): edge tables and rounds of joins; small sequential parts run cloud by cloud."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cloudloom.functions.tables import discard, materialise
from cloudloom.operators.spacetree import groups

AXES = ["x", "y", "z"]


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(cloud_id, point_id, root) with the smallest point of each node's component. Edges go both ways.

    Each round takes the least root among the neighbours and then jumps to that root's root, so the number of rounds
    grows with the logarithm of a component's length. Rounds are written to the shared folder.
    """
    written = state = materialise(nodes.select("cloud_id", "point_id", F.col("point_id").alias("root")))
    edges = materialise(edges.select("cloud_id", "src", "dst").where("src <> dst"))
    for _ in range(max_rounds):
        near = edges.join(state.withColumnRenamed("point_id", "dst"), ["cloud_id", "dst"]).groupBy("cloud_id", F.col("src").alias("point_id")).agg(F.min("root").alias("_near"))
        hooked = state.join(near, ["cloud_id", "point_id"], "left").select("cloud_id", "point_id", "root", F.least("root", F.coalesce("_near", "root")).alias("_low"))
        # a root takes the least value that any of its members has seen
        best = hooked.groupBy("cloud_id", F.col("root").alias("_r")).agg(F.min("_low").alias("_b"))
        moved = hooked.join(best.withColumnRenamed("_r", "root"), ["cloud_id", "root"]).select("cloud_id", "point_id", F.col("root").alias("_old"), F.least("_low", "_b").alias("root"))
        jump = moved.select("cloud_id", F.col("point_id").alias("root"), F.col("root").alias("_next"))
        new = materialise(moved.join(jump, ["cloud_id", "root"], "left").select("cloud_id", "point_id", "_old", F.least("root", F.coalesce("_next", "root")).alias("root")))
        changed = not new.where("_old <> root").isEmpty()
        discard(written)
        written, state = new, new.drop("_old")
        if not changed:
            return state
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")


#: Pairs of points up to which two neighbouring cells are compared point by point instead of by halves of the cells.
DIRECT = 1_024
CELL = ["cloud_id", "_l", "_cx", "_cy", "_cz"]


def _boxes(points: DataFrame, side: float) -> DataFrame:
    """One row a cell: its number of points, least point id and the box that its points span."""
    cells = points.withColumns({f"_c{a}": F.floor(F.col(a) / side) for a in AXES})
    ends = [f(a).alias(f"_{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    return cells.groupBy(*CELL).agg(F.count("*").alias("_n"), F.min("point_id").alias("_id"), *ends)


def _side(boxes: DataFrame, which: str) -> DataFrame:
    """The columns of one side of a pair of cells, all but the cloud and the label with a prefix."""
    return boxes.select("cloud_id", "_l", *[F.col(c).alias(which + c) for c in boxes.columns if c not in ("cloud_id", "_l")])


#: Cells along an edge of a block of cells, a power of two: a task compares the cells of whole blocks.
BLOCK = 16


def _neighbour_cells(boxes: DataFrame, limit: float, rows: int = 1 << 18) -> DataFrame:
    """Pairs (src, dst, and the columns of both with a_ and b_) of cells up to two apart whose boxes are nearer than the root of limit, each once.

    A cell is dealt to its block and to those before that may ask for it, so it is shuffled about twice and not once for each of the
    62 places around. A block has a cell once at most, which bounds it; a task takes blocks in turns of about ``rows`` cells.
    """
    bits, wide = BLOCK.bit_length() - 1, BLOCK + 4
    offsets = [(i, j, k) for i in range(3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0) and min(map(abs, (i, j, k))) < 2]
    dealt = boxes.where("cloud_id is not null")
    for a, after in zip(AXES, (0, 2, 2)):
        dealt = dealt.withColumn(f"_b{a}", F.explode(F.sequence(F.shiftright(F.col(f"_c{a}") - 2, bits), F.shiftright(F.col(f"_c{a}") + after, bits))))
    block = ["cloud_id", "_l", *[f"_b{a}" for a in AXES]]
    dealt = dealt.repartition(*block).sortWithinPartitions(*block)
    own = [c for c in boxes.columns if c not in ("cloud_id", "_l")]

    def compare(table: pa.Table, starts: np.ndarray) -> pa.Table:
        c = {a: table[f"_c{a}"].to_numpy() - (table[f"_b{a}"].to_numpy() << bits) for a in AXES}
        mine = np.flatnonzero(np.logical_and.reduce([(v >= 0) & (v < BLOCK) for v in c.values()]))
        key = ((np.cumsum(starts) * wide + c["x"]) * wide + c["y"] + 2) * wide + c["z"] + 2
        order = np.argsort(key)
        ranked = key[order]
        mine = mine[np.argsort(key[mine])]
        lo, hi = (np.stack([table[f"_{n}{a}"].to_numpy() for a in AXES], axis=1) for n in ("lo", "hi"))
        found = []
        for i, j, k in offsets:
            want = key[mine] + (i * wide + j) * wide + k
            at = np.minimum(np.searchsorted(ranked, want), len(ranked) - 1)
            hit = ranked[at] == want
            a, b = mine[hit], order[at[hit]]
            gap = np.maximum(np.maximum(lo[a] - hi[b], lo[b] - hi[a]), 0.0)
            near = (gap * gap).sum(axis=1) <= limit * (1 + 1e-9)  # the caller tests again, exactly
            found.append((a[near], b[near]))
        a, b = (np.concatenate([f[n] for f in found]) for n in (0, 1))
        left, right = table.take(pa.array(a)), table.take(pa.array(b))
        sides = {"cloud_id": left["cloud_id"], "_l": left["_l"]} | {f"{w}{c}": t[c] for w, t in (("a", left), ("b", right)) for c in own}
        return pa.table(sides | {"src": left["_id"], "dst": right["_id"]})

    def changes(table: pa.Table) -> np.ndarray:
        out = np.zeros(len(table), bool)
        for c in block:
            codes = table[c].combine_chunks().dictionary_encode().indices.to_numpy()
            out[1:] |= codes[1:] != codes[:-1]
        return out

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= rows:
                table = pa.Table.from_batches(held).combine_chunks()
                starts = changes(table)
                last = int(np.flatnonzero(starts)[-1]) if starts.any() else 0  # a block may go on in the next batch
                if last:
                    yield from compare(table.slice(0, last), starts[:last]).to_batches(65_536)
                held = table.slice(last).to_batches()
        if sum(map(len, held)):
            table = pa.Table.from_batches(held).combine_chunks()
            yield from compare(table, changes(table)).to_batches(65_536)

    names = {f.name: f.dataType for f in boxes.schema}
    schema = StructType([StructField(c, names[c]) for c in ("cloud_id", "_l")] + [StructField(f"{w}{c}", names[c]) for w in "ab" for c in own] + [StructField(c, names["_id"]) for c in ("src", "dst")])
    return dealt.mapInArrow(run, schema)


def cell_links(points: DataFrame, radius: float, direct: int = DIRECT, max_rounds: int = 40) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Cells (CELL, _id) of a diagonal within the radius and links (cloud_id, src, dst), both ways, between the ids of cells that hold
    points (cloud_id, _l, point_id, x, y, z) nearer than the radius to each other.

    Points of a cell needn't be compared at all. Two cells are linked at once if even the farthest corners of their boxes are
    near enough, and parted if the nearest aren't; few points are compared one by one; else halves of the cells are compared
    in the next round, so crowded cells don't meet point by point. Equal points have a box without extent, which is always
    near or far; the last round, with cells below a double's precision, compares what is left. Also the tables written on the way.
    """
    side, limit = radius / 3**0.5 * (1 - 1e-9), radius * radius
    boxes = materialise(_boxes(points, side))
    cells = boxes.select(*CELL, "_id")
    gap = [F.greatest(F.col(f"a_lo{a}") - F.col(f"b_hi{a}"), F.col(f"b_lo{a}") - F.col(f"a_hi{a}"), F.lit(0.0)) for a in AXES]
    reach = [F.greatest(F.col(f"a_hi{a}") - F.col(f"b_lo{a}"), F.col(f"b_hi{a}") - F.col(f"a_lo{a}")) for a in AXES]
    square = lambda parts: sum((v**2 for v in parts), F.lit(0.0))
    way = lambda last: F.when(square(reach) < limit, "linked").when((F.col("a_n") * F.col("b_n") <= direct) | F.lit(last), "few").otherwise("many")
    keys = ["cloud_id", "_l", "src", "dst", *[f"{w}_c{a}" for w in "ab" for a in AXES]]
    links, scratch, scale, pairs = None, [boxes], 1, _neighbour_cells(boxes, limit)
    for turn in range(max_rounds):
        judged = materialise(pairs.where(square(gap) < limit).select(*keys, way(turn == max_rounds - 1).alias("_way")))
        scratch.append(judged)
        ways = {r["_way"] for r in judged.select("_way").distinct().collect()}
        own = points.withColumns({f"_c{a}": F.floor(F.col(a) / (side / scale)) for a in AXES}).select(*CELL, *AXES)
        few = judged.where("_way = 'few'").drop("_way").join(_side(own, "a"), ["cloud_id", "_l", *[f"a_c{a}" for a in AXES]]).join(_side(own, "b"), ["cloud_id", "_l", *[f"b_c{a}" for a in AXES]])
        near = few.where(square([F.col(f"a{a}") - F.col(f"b{a}") for a in AXES]) < limit).select("cloud_id", "src", "dst")
        linked = judged.where("_way = 'linked'").select("cloud_id", "src", "dst")
        found = materialise((linked.unionByName(near) if "few" in ways else linked).distinct())  # without few pairs, no point is read
        scratch.append(found)
        links = found if links is None else links.unionByName(found)
        if "many" not in ways:
            break
        many = judged.where("_way = 'many'").drop("_way").join(found, ["cloud_id", "src", "dst"], "left_anti")  # one way to a link is enough
        if many.isEmpty():
            break
        scale *= 2
        held = [many.select("cloud_id", "_l", *[F.col(f"{w}_c{a}").alias(f"_c{a}") for a in AXES]) for w in "ab"]
        crowded = points.withColumns({f"_c{a}": F.floor(F.col(a) / (side / (scale // 2))) for a in AXES}).join(held[0].unionByName(held[1]).distinct(), CELL, "left_semi")
        finer = materialise(_boxes(crowded.drop("_cx", "_cy", "_cz"), side / scale))
        scratch.append(finer)
        halves = lambda w: _side(finer, w).withColumns({f"_p{w}{a}": F.shiftright(f"{w}_c{a}", 1) for a in AXES})
        up = lambda w: [f"_p{w}{a}" for a in AXES]
        parents = many.withColumnsRenamed({f"{w}_c{a}": f"_p{w}{a}" for w in "ab" for a in AXES})
        pairs = parents.join(halves("a"), ["cloud_id", "_l", *up("a")]).join(halves("b"), ["cloud_id", "_l", *up("b")])
    both = links.unionByName(links.select("cloud_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return cells, both, scratch


def label_components(points: DataFrame, radius: float, least: int, label: str = "label", direct: int = DIRECT) -> DataFrame:
    """Clusters of points of one label within the radius; those of fewer than ``least`` points go. Clusters of a cloud
    are numbered by their first points. A point with a null label or coordinate, or NaN, is a cluster by itself.

    Cells of a diagonal within the radius are joined by ``cell_links``, so a crowded place costs no pairs of its points.
    """
    usable = F.lit(True)
    for a in AXES:
        usable = usable & F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double"))
    rows = points.select("cloud_id", "point_id", F.col(label).alias("_l"), *[F.col(a).cast("double").alias(a) for a in AXES], F.coalesce(usable & F.col(label).isNotNull(), F.lit(False)).alias("_ok"))
    rows = materialise(rows)
    placed = rows.where("_ok")
    cells, links, written = cell_links(placed, radius, direct)
    groups = components(links.select("cloud_id", F.col("src").alias("point_id")).distinct(), links)  # the other cells are clusters by themselves
    for table in written[1:]:  # the first has the cells, read below
        discard(table)
    side = radius / 3**0.5 * (1 - 1e-9)
    of_cell = cells.join(groups.select("cloud_id", F.col("point_id").alias("_id"), "root"), ["cloud_id", "_id"], "left").withColumn("root", F.coalesce("root", "_id"))
    roots = placed.withColumns({f"_c{a}": F.floor(F.col(a) / side) for a in AXES}).join(of_cell, CELL).select("cloud_id", "point_id", "root")
    roots = materialise(roots.unionByName(rows.where("not _ok").select("cloud_id", "point_id", F.col("point_id").alias("root"))))
    discard(rows)
    discard(written[0])
    sizes = roots.groupBy("cloud_id", "root").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    number = F.dense_rank().over(Window.partitionBy("cloud_id").orderBy("root")) - 1  # over clusters, not points
    numbered = sizes.select("cloud_id", "root", number.alias("cluster"))
    return points.join(roots.join(numbered, ["cloud_id", "root"]).select("cloud_id", "point_id", "cluster"), ["cloud_id", "point_id"])


def shifted_centres(df: DataFrame, bias: Sequence[str], size: float) -> DataFrame:
    """Coordinates moved by the predicted offsets, in units of the voxel size: what the proposals are clustered in."""
    return df.withColumns({a: (F.col(a) + F.col(b)) / size for a, b in zip(AXES, bias)})


def by_score(instances: DataFrame, score: str, ident: str) -> DataFrame:
    """K2: the rank of each instance of its cloud by falling score, ties to the smaller id."""
    return instances.withColumn("rank", F.row_number().over(Window.partitionBy("cloud_id").orderBy(F.desc(score), ident)))


def attach_segments(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Each point's segment of a partition (cloud_id, point_id, segment); -1 for points that it lacks."""
    out = points.join(segments.select("cloud_id", "point_id", "segment"), ["cloud_id", "point_id"], "left")
    return out.withColumn("segment", F.coalesce("segment", F.lit(-1)))


def cluster_statistic(clustered: DataFrame, statistic: Column, name: str) -> DataFrame:
    """Clusters with a statistic of their points, any aggregate expression (a grouped pandas_udf too)."""
    return clustered.groupBy("cloud_id", "cluster").agg(F.count("*").alias("n"), statistic.alias(name))


def matching_costs(pairs: DataFrame, parts: Sequence[tuple[float, Column]]) -> DataFrame:
    """A cost for each pair, the weighted sum of any cost columns; NaN and infinite ones become a large constant."""
    total = sum((w * c for w, c in parts), F.lit(0.0))
    return pairs.withColumn("cost", F.when(F.isnan(total) | (F.abs(total) > 1e12), 1e12).otherwise(total))


def proposals(clustered: DataFrame, label: str, score: str) -> DataFrame:
    """Instances of clusters: the label of the first member, the mean score, the number of points."""
    return clustered.groupBy("cloud_id", "cluster").agg(F.min_by(label, "point_id").alias("class"), F.avg(score).alias("score"), F.count("*").alias("n"))


def matrix_nms(instances: DataFrame, masks: DataFrame, top: int, least: float, most: int, sigma: float | None = None) -> DataFrame:
    """Decay each instance's score by its overlap with better ones of its class, compensated by their own overlaps;
    linear, or gaussian with sigma. Only the best ``top`` of a cloud take part and at most ``most`` stay."""
    w = Window.partitionBy("cloud_id").orderBy(F.desc("score"), "inst_id")
    best = instances.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    m = masks.join(best.select("cloud_id", "inst_id", "class", "_r"), ["cloud_id", "inst_id"])
    size = m.groupBy("cloud_id", "_r").agg(F.count("*").alias("_n"))
    other = m.select("cloud_id", "point_id", "class", F.col("_r").alias("_q"))
    inter = m.join(other, ["cloud_id", "point_id", "class"]).where("_q < _r").groupBy("cloud_id", "_r", "_q").agg(F.count("*").alias("_i"))
    iou = inter.join(size, ["cloud_id", "_r"]).join(size.withColumnsRenamed({"_r": "_q", "_n": "_m"}), ["cloud_id", "_q"]).withColumn("_iou", F.col("_i") / (F.col("_n") + F.col("_m") - F.col("_i")))
    comp = iou.groupBy("cloud_id", F.col("_r").alias("_q")).agg(F.max("_iou").alias("_c"))
    both = iou.join(comp, ["cloud_id", "_q"], "left").na.fill(0.0, ["_c"])
    factor = F.try_divide(1 - F.col("_iou"), 1 - F.col("_c")) if sigma is None else F.exp(-sigma * (F.col("_iou") ** 2 - F.col("_c") ** 2))
    decay = both.groupBy("cloud_id", "_r").agg(F.min(F.coalesce(factor, F.lit(1.0))).alias("_d"))
    out = best.join(decay, ["cloud_id", "_r"], "left").withColumn("score", F.col("score") * F.least(F.coalesce("_d", F.lit(1.0)), F.lit(1.0))).where(F.col("score") >= least)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("cloud_id", "inst_id", "class", "score", "rank")


def _assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Rows to columns at least cost: shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = np.nan_to_num(cost.T if flip else cost, nan=1e12, posinf=1e12, neginf=-1e12)
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            gain = c[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = gain < low[free]
            low[free[better]], way[free[better]] = gain[better], j0
            j1 = free[np.argmin(low[free])]
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def assignment(costs: DataFrame, row: str, column: str, cost: str) -> DataFrame:
    """The one-to-one assignment of least total cost within each cloud; pairs that aren't listed cost a lot."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.sort(pdf[row].unique()), np.sort(pdf[column].unique())
        c = np.full((len(rows), len(cols)), 1e9)
        c[np.searchsorted(rows, pdf[row]), np.searchsorted(cols, pdf[column])] = pdf[cost]
        pairs = _assign(c)
        return pd.DataFrame({"cloud_id": pdf["cloud_id"].iloc[0], row: rows[[a for a, _ in pairs]], column: cols[[b for _, b in pairs]]})

    return costs.groupBy("cloud_id").applyInPandas(run, f"cloud_id bigint, {row} bigint, {column} bigint")


def best_assignment(points: DataFrame, cluster: str, label: str) -> DataFrame:
    """Clusters to classes with the greatest overlap, one to one."""
    overlap = points.groupBy("cloud_id", F.col(cluster).cast("bigint").alias(cluster), F.col(label).cast("bigint").alias(label)).agg((-F.count("*")).cast("double").alias("cost"))
    return assignment(overlap, cluster, label, "cost")


def anatomical_labels(instances: DataFrame, side: str, height: str, right_is_higher: bool = False, superior_is_higher: bool = False, rounds: int = 8, per_side: int = 12) -> DataFrame:
    """Two sides by 1-D 2-means on the centroids (from the least and the greatest), each sorted from the top: 1 to 12 on
    the left side, 13 to 24 on the right one; more than 12 on a side are dropped.

    A round that leaves a side empty parts at the median instead. The orientation says whether the right side has the higher
    values of ``side``, and the order of ``height``: rising with superior_is_higher, else falling. Ties go by instance, in the
    order of the heights.
    """
    cloud = Window.partitionBy("cloud_id")
    out = instances.withColumns({"_a": F.min(side).over(cloud), "_b": F.max(side).over(cloud), "_med": F.median(side).over(cloud), "_n": F.count("*").over(cloud)})
    for _ in range(rounds):
        near = F.coalesce(F.abs(F.col(side) - F.col("_a")) <= F.abs(F.col(side) - F.col("_b")), F.lit(False))
        out = out.withColumn("_m", near).withColumn("_k", F.count_if("_m").over(cloud))
        out = out.withColumn("_m", F.when((F.col("_k") == 0) | (F.col("_k") == F.col("_n")), F.col(side) <= F.col("_med")).otherwise(F.col("_m")))
        out = out.withColumns({"_a": F.avg(F.when(F.col("_m"), F.col(side))).over(cloud), "_b": F.avg(F.when(~F.col("_m"), F.col(side))).over(cloud)})
    higher = F.coalesce(F.col("_b") > F.col("_a"), F.lit(True))  # a side without instances counts as the higher one
    out = out.withColumn("_right", F.when(higher == F.lit(right_is_higher), ~F.col("_m")).otherwise(F.col("_m")))
    order = [F.asc(height), F.asc("instance")] if superior_is_higher else [F.desc(height), F.desc("instance")]
    out = out.withColumn("_k", F.row_number().over(Window.partitionBy("cloud_id", "_right").orderBy(*order))).where(F.col("_k") <= per_side)
    return out.select("cloud_id", "instance", (F.col("_k") + F.when(F.col("_right"), per_side).otherwise(0)).cast("int").alias("rib"))


def farthest_points(points: DataFrame, n: int) -> DataFrame:
    """From the first point on, again and again the point farthest from those chosen, ties to the smaller id.

    One cloud is one task's work, clouds run in parallel; a task holds its cloud's coordinates, and a batch of rows beside it.
    """
    names = ["cloud_id", "point_id", *AXES]

    def chosen(cloud: pa.Table) -> pa.Table:
        x = np.column_stack([cloud[a].to_numpy() for a in AXES])
        picks, d2 = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(picks) < min(n, len(x)):
            k = int(np.argmax(d2))
            picks.append(k)
            d2 = np.minimum(d2, ((x - x[k]) ** 2).sum(axis=1))
        rows = cloud.select(names[:2]).take(pa.array(picks))
        return rows.append_column("rank", pa.array(np.arange(1, len(picks) + 1, dtype=np.int32)))

    def run(batches):
        parts = []  # of the cloud that goes on
        for b in batches:
            if not b.num_rows:
                continue
            if parts and b["cloud_id"][0] != parts[0]["cloud_id"][0]:
                yield from chosen(pa.Table.from_batches(parts).combine_chunks()).to_batches()
                parts = []
            *whole, last = groups(pa.Table.from_batches([b]), ["cloud_id"]).values()
            found = []
            for start, end in whole:
                found.append(chosen(pa.Table.from_batches([*parts, b.slice(start, end - start)]).combine_chunks()))
                parts = []
            parts.append(b.slice(last[0], last[1] - last[0]))
            if found:
                yield from pa.concat_tables(found).combine_chunks().to_batches()
        if parts:
            yield from chosen(pa.Table.from_batches(parts).combine_chunks()).to_batches()

    # many clouds a batch, in the order of their points
    whole = points.select(*[F.col(c).cast("bigint").alias(c) for c in names[:2]], *[F.col(a).cast("double").alias(a) for a in AXES])
    return whole.repartition("cloud_id").sortWithinPartitions("cloud_id", "point_id").mapInArrow(run, "cloud_id bigint, point_id bigint, rank int")


def segment_graph(edges: DataFrame, k: float, least: int) -> DataFrame:
    """C4: graph segmentation of (cloud_id, a, b, weight): edges by weight, merged where the weight is within both sides'
    thresholds (the last merged weight + k / size), then segments under ``least`` nodes join a neighbour. The order is
    sequential within a cloud; clouds run in parallel. Returns (cloud_id, point_id, segment), numbered by first nodes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "a", "b"])
        ids, ends = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
        ends = ends.reshape(-1, 2)
        parent, size, limit = list(range(len(ids))), [1] * len(ids), [k] * len(ids)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def join(a: int, b: int) -> int:
            a, b = min(a, b), max(a, b)
            parent[b] = a
            size[a] += size[b]
            return a

        for (i, j), w in zip(ends.tolist(), pdf["weight"]):
            a, b = root(i), root(j)
            if a != b and w <= limit[a] and w <= limit[b]:
                r = join(a, b)
                limit[r] = w + k / size[r]
        for i, j in ends.tolist():
            a, b = root(i), root(j)
            if a != b and (size[a] < least or size[b] < least):
                join(a, b)
        _, dense = np.unique([root(i) for i in range(len(ids))], return_inverse=True)
        return pd.DataFrame({"cloud_id": pdf["cloud_id"].iloc[0], "point_id": ids, "segment": dense})

    return edges.groupBy("cloud_id").applyInPandas(run, "cloud_id bigint, point_id bigint, segment bigint")


def associate(points: DataFrame, pred: str, truth: str) -> DataFrame:
    """Every overlapping pair of predicted instance (>= 0, or > 0 where 0 is no instance) and true instance (> 0)."""
    p, t = points.where(F.col(pred) >= (0 if pred == "instance" else 1)), points.where(F.col(truth) > 0)
    sizes = p.groupBy("cloud_id", F.col(pred).alias("inst")).agg(F.count("*").alias("size"), F.min_by("label", "point_id").alias("class"))
    truths = t.groupBy("cloud_id", F.col(truth).alias("gt")).agg(F.count("*").alias("gt_size"))
    inter = p.where(F.col(truth) > 0).groupBy("cloud_id", F.col(pred).alias("inst"), F.col(truth).alias("gt")).agg(F.count("*").alias("inter"))
    out = inter.join(sizes, ["cloud_id", "inst"]).join(truths, ["cloud_id", "gt"])
    return out.withColumn("iou", F.col("inter") / (F.col("size") + F.col("gt_size") - F.col("inter")))


def _examples(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(columns, (pa.float64(), pa.int32(), pa.int32(), pa.float64()))], ["threshold", "class", "hit", "score"])


def average_precision(guesses: DataFrame, truth: DataFrame, overlaps: DataFrame, thresholds: Sequence[float], least: int = 0) -> DataFrame:
    """Average precision of each class and overlap threshold.

    guesses: cloud_id, inst, class, score, size, void (points that lie on ignored ground); truth: cloud_id, gt, class, size;
    overlaps: cloud_id, inst, gt, inter. Truths of fewer than ``least`` points don't count but excuse what lies on them.

    In each cloud and class the truths, by id, take the guesses, by id, that overlap by more than the threshold and aren't
    taken: the first wins; a further one leaves the better score with the truth and the worse as a false guess. A guess that
    overlaps no truth enough is false too, unless more than the threshold's share of it is void or on small truths. The curve
    has a point for each score, then precision 1 at recall 0; a point's weight is half the distance of its neighbours'
    recalls. Without truths of a class the result is null, without guesses 0.
    """
    thr = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    gt = truth.select("cloud_id", "gt", F.col("class").alias("_t"), F.col("size").alias("_gs"))
    pairs = overlaps.join(guesses, ["cloud_id", "inst"]).join(gt, ["cloud_id", "gt"]).where("class = _t")
    pairs = pairs.withColumn("iou", F.col("inter") / (F.col("size") + F.col("_gs") - F.col("inter")))
    big, hit = F.col("_gs") >= least, F.col("iou") > F.col("threshold")
    at = pairs.select("*", thr)

    def greedy(close: list) -> list:
        rows = []
        for t in thresholds:
            taken, best = set(), {}
            for kind, truth_id, inst, score, iou in close:
                if iou <= t or (kind, inst) in taken:
                    continue
                if (kind, truth_id) in best:
                    rows.append((t, kind, 0, min(best[kind, truth_id], score)))
                    best[kind, truth_id] = max(best[kind, truth_id], score)
                else:
                    best[kind, truth_id] = score
                    taken.add((kind, inst))
            rows += [(t, kind, 1, score) for (kind, _), score in best.items()]
        return rows

    def run(batches):
        now, close = None, []
        for b in batches:
            found = []
            for cloud, *pair in zip(*(c.to_pylist() for c in b.columns)):
                if cloud != now:
                    found += greedy(close)
                    now, close = cloud, []
                close.append(pair)
            yield _examples(found)
        yield _examples(greedy(close))

    # a group is the close pairs of a cloud: a guess overlaps few truths by more than the least threshold
    near = pairs.where(big & (F.col("iou") > min(thresholds))).select("cloud_id", "class", "gt", "inst", F.coalesce(F.col("score").cast("double"), F.lit(float("nan"))), "iou")
    near = near.repartition("cloud_id").sortWithinPartitions("cloud_id", "class", "gt", "inst")  # many clouds a batch, a few rows each
    matched = near.mapInArrow(run, "threshold double, class int, hit int, score double")
    excused = at.groupBy("cloud_id", "inst", "threshold").agg(F.max(hit.cast("int")).alias("_hit"), F.sum(F.when(~big, F.col("inter")).otherwise(0)).alias("_small"))
    false = guesses.select("*", thr).join(excused, ["cloud_id", "inst", "threshold"], "left").na.fill(0, ["_hit", "_small"])
    false = false.where((F.col("_hit") == 0) & ((F.col("void") + F.col("_small")) / F.col("size") <= F.col("threshold")))
    examples = matched.unionByName(false.select("threshold", F.col("class").cast("int").alias("class"), F.lit(0).alias("hit"), "score"))
    total = truth.where(F.col("size") >= least).groupBy("class").agg(F.count("*").alias("_truth"))
    # found truths and misses make up the recall's denominator: it is the same at every point
    per_score = examples.groupBy("threshold", "class", "score").agg(F.sum("hit").alias("_h"), F.count("*").alias("_c"))
    kind = Window.partitionBy("threshold", "class").orderBy("score")
    above = kind.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    curve = per_score.join(total, "class").select("threshold", "class", "score", (F.sum("_h").over(above) / F.sum("_c").over(above)).alias("_p"), (F.sum("_h").over(above) / F.col("_truth")).alias("_r"))
    before, after = F.coalesce(F.lag("_r").over(kind), F.col("_r")), F.lead("_r").over(kind)
    width = (before - F.coalesce(after, F.lit(0.0))) / 2
    ap = curve.withColumn("_s", F.col("_p") * width + F.when(after.isNull(), F.col("_r") / 2).otherwise(0.0)).groupBy("threshold", "class").agg(F.sum("_s").alias("ap"))
    classes = guesses.select("class").union(truth.select("class")).distinct().select("class", thr)
    return classes.join(total, "class", "left").join(ap, ["threshold", "class"], "left").select("threshold", "class", F.when(F.col("_truth") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"))


def select_instances(scores: DataFrame, masks: DataFrame, top: int, least_score: float, least_points: int) -> DataFrame:
    """The best (query, class) scores of a cloud, times the mean of their mask's probabilities over one half; weak and
    small ones go; by falling score. scores: cloud_id, query, class, score; masks: cloud_id, query, point_id, p."""
    w = Window.partitionBy("cloud_id").orderBy(F.desc("score"), "query", "class")
    best = scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")
    inside = masks.where("p > 0.5").groupBy("cloud_id", "query").agg(F.avg("p").alias("_m"), F.count("*").alias("points"))
    out = best.join(inside, ["cloud_id", "query"]).withColumn("score", F.col("score") * F.col("_m"))
    out = out.where((F.col("score") >= least_score) & (F.col("points") >= least_points)).drop("_m")
    return out.withColumn("rank", F.row_number().over(w))
