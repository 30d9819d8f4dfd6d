"""Label tables, frames and staged predictions (P9-P21, S6-S20, J20-J27): joins with small dimensions, lags, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.ranking import global_rank


def by_prefix(names: DataFrame, prefixes: Sequence[tuple[str, int]], name: str, target: str, other: int = 0) -> DataFrame:
    """The id of the first prefix that the name begins with."""
    pick = F.lit(other)
    for prefix, value in reversed(prefixes):
        pick = F.when(F.col(name).startswith(prefix), value).otherwise(pick)
    return names.withColumn(target, pick)


def unmatched_prefixes(names: DataFrame, prefixes: Sequence[tuple[str, int]], name: str) -> list[str]:
    """Prefixes that no name begins with; a taxonomy with such is an error."""
    hits = names.agg(*[F.max(F.col(name).startswith(p)).alias(f"h{k}") for k, (p, _) in enumerate(prefixes)]).first()
    return [p for k, (p, _) in enumerate(prefixes) if not hits[k]]


def fine_ids(names: DataFrame, coarse: str, order: str, start: int = 1) -> DataFrame:
    """Consecutive ids by coarse kind, then by the given order."""
    return global_rank(names, [coarse, order], "fine").withColumn("fine", (F.col("fine") + start - 1).cast("int"))


def suppress(label: str, classes: Sequence[int]) -> Column:
    """P20."""
    return F.when(F.col(label).isin(*classes), 0).otherwise(F.col(label))


def combine_labels(manual: str, predicted: str, table: dict[int, int]) -> Column:
    """The manual label where it's positive, else the table's entry for the predicted one, else 0."""
    t = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.when(F.col(manual) > 0, F.col(manual)).otherwise(F.coalesce(F.try_element_at(t, F.col(predicted)), F.lit(0)))


def map_classes(values: DataFrame, mapping: DataFrame, name: str) -> DataFrame:
    """Rename by a table (src, dst, ord): the first entry wins, a null dst drops the row, a missing one keeps it."""
    first = mapping.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("ord"))).where("_r = 1").select(F.col("src").alias(name), "dst", F.lit(True).alias("_hit"))
    out = values.join(first, name, "left").where("_hit is null or dst is not null")
    return out.withColumn(name, F.coalesce("dst", name)).drop("dst", "_hit")


def split_by_ratio(ids: DataFrame, key: str, ratio: float, rank: Column) -> DataFrame:
    """A reproducible split: the first round(n * ratio) ids by the given order are ``val``."""
    n = ids.count()
    return global_rank(ids, [rank, key], "_at").withColumn("split", F.when(F.col("_at") <= round(n * ratio), "val").otherwise("train")).drop("_at")


def evaluation_set(listed: DataFrame, incomplete_clouds: DataFrame, excluded: DataFrame, only_incomplete: bool = False) -> DataFrame:
    """The clouds of a split and the incomplete ones (or these alone), less the excluded ones; each table has cloud_id."""
    chosen = incomplete_clouds.select("cloud_id") if only_incomplete else listed.select("cloud_id").union(incomplete_clouds.select("cloud_id"))
    return chosen.distinct().join(excluded.select("cloud_id"), "cloud_id", "left_anti")


def still_to_do(wanted: DataFrame, written: DataFrame, key: str = "cloud_id") -> DataFrame:
    """The ids that the target doesn't hold yet."""
    return wanted.select(key).distinct().join(written.select(key).distinct(), key, "left_anti")


def every_kth(frames: DataFrame, k: int, usable: Column) -> DataFrame:
    """Every kth frame of a sequence whose pose is usable."""
    return frames.where((F.col("frame_idx") % k == 0) & usable)


def repeat(df: DataFrame, times: int) -> DataFrame:
    """The rows again and again; ``pass`` numbers the copies."""
    return df.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def weighted_union(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Several sets, each in so many passes; ``source`` tells them apart."""
    out = None
    for k, (df, times) in enumerate(parts):
        part = repeat(df, times).withColumn("source", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def shard(ids: DataFrame, key: str, n: int) -> DataFrame:
    """Round robin by order into n shards."""
    return global_rank(ids, [key], "_at").withColumn("shard", ((F.col("_at") - 1) % n).cast("int")).drop("_at")


def keep_labelled(points: DataFrame, subset: DataFrame, ignore: int = -1) -> DataFrame:
    """Labels outside the labelled subset of (cloud_id, point_id) are ignored."""
    hit = subset.select("cloud_id", "point_id").distinct().withColumn("_hit", F.lit(True))
    return points.join(hit, ["cloud_id", "point_id"], "left").withColumn("label", F.when(F.col("_hit"), F.col("label")).otherwise(ignore)).drop("_hit")


def underfilled(points: DataFrame, least: int) -> DataFrame:
    """Clouds with too few points, for one report."""
    return points.groupBy("cloud_id").agg(F.count("*").alias("n")).where(F.col("n") < least)


def incomplete(points: DataFrame, label: str, classes: int) -> DataFrame:
    """Clouds that lack classes."""
    return points.groupBy("cloud_id").agg(F.countDistinct(label).alias("classes")).where(F.col("classes") < classes)


def integral(df: DataFrame, value: str) -> DataFrame:
    """Whether all values of a cloud are finite and whole, and their range: decides the stored type."""
    v = F.col(value)
    return df.groupBy("cloud_id").agg(F.max(F.abs(v - F.rint(v))).alias("_f"), F.min(v).alias("least"), F.max(v).alias("most")).withColumn("whole", F.coalesce(F.col("_f") == 0, F.lit(False))).drop("_f")


def run_lengths(points: DataFrame, instance: str) -> DataFrame:
    """Each instance's points as text of 1-based starts and lengths of runs of consecutive ids."""
    w = Window.partitionBy("cloud_id", instance).orderBy("point_id")
    runs = points.withColumn("_g", F.col("point_id") - F.row_number().over(w)).groupBy("cloud_id", instance, "_g").agg(F.min("point_id").alias("s"), F.count("*").alias("n"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("s", "n"))), lambda r: F.concat_ws(" ", r["s"], r["n"]))
    return runs.groupBy("cloud_id", instance).agg(F.array_join(text, " ").alias("rle"))


def sweeps(frames: DataFrame, n: int) -> DataFrame:
    """For each frame the n before it: their ids and lags in days; short chains repeat the last one they have, the
    first frame itself."""
    w = Window.partitionBy("seq_id").orderBy("frame_idx")
    out = frames
    for k in range(1, n + 1):
        prev = f"sweep{k - 1}" if k > 1 else "frame_id"
        out = out.withColumn(f"sweep{k}", F.coalesce(F.lag("frame_id", k).over(w), F.col(prev)))
        day = F.coalesce(F.lag("day", k).over(w), F.col(f"_day{k - 1}") if k > 1 else F.col("day"))
        out = out.withColumn(f"_day{k}", day)
    return out.withColumns({f"lag{k}": F.datediff("day", f"_day{k}") for k in range(1, n + 1)}).drop(*[f"_day{k}" for k in range(1, n + 1)])


def fuse_frames(frames: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """Pairs of each frame with those at the given offsets in its sequence, with the move from one to the other
    (planar pose tx, yaw)."""
    other = frames.select("seq_id", F.col("frame_idx").alias("_at"), F.col("frame_id").alias("ref_id"), F.col("tx").alias("_tx"), F.col("yaw_deg").alias("_yaw"))
    want = frames.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("_at", F.col("frame_idx") + F.col("offset"))
    turn = F.radians(-F.col("yaw_deg"))
    out = want.join(other, ["seq_id", "_at"])
    return out.withColumns({"dx": (F.col("_tx") - F.col("tx")) * F.cos(turn), "dy": (F.col("_tx") - F.col("tx")) * F.sin(turn), "dyaw": F.col("_yaw") - F.col("yaw_deg")}).select("seq_id", "frame_id", "offset", "ref_id", "dx", "dy", "dyaw")


def segment_labels(points: DataFrame, groups: DataFrame, segment: str) -> DataFrame:
    """Groups (ord, label, segments) onto points by segment; a later group overwrites an earlier one."""
    parts = groups.select("cloud_id", "ord", F.col("label").alias("group_label"), F.explode("segments").alias(segment))
    last = parts.groupBy("cloud_id", segment).agg(F.max_by("group_label", "ord").alias("group_label"))
    return points.join(last, ["cloud_id", segment], "left").withColumn("group_label", F.coalesce("group_label", F.lit(-1)))


def combine_stages(cache: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The second stage's label where it has one, else 0, for every point of the first stage."""
    s = second.select("cloud_id", "point_id", F.col("pred").alias("_second"))
    return cache.join(first.select("cloud_id", "point_id", F.col("pred").alias("fg")), ["cloud_id", "point_id"]).join(s, ["cloud_id", "point_id"], "left").withColumn("pred", F.coalesce("_second", F.lit(0)))


def stage_faults(cache: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Counts that must all be 0: points of either set missing in the other, second-stage points outside the
    first stage or outside its foreground."""
    key = ["cloud_id", "point_id"]
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        count(cache.join(first, key, "left_anti"), "cache_only"), count(first.join(cache, key, "left_anti"), "first_only"),
        count(second.join(first, key, "left_anti"), "second_only"), count(second.join(first.where("pred = 1"), key, "left_anti"), "second_in_background"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # single rows
    return out


def over_threshold(pairs: DataFrame, value: str, limit: float, closed: bool = False) -> DataFrame:
    """Pairs of a list above the limit, or at it too (closed)."""
    return pairs.where(F.col(value) >= limit if closed else F.col(value) > limit)


def inverse_remap(df: DataFrame, label: str, table: DataFrame, ignore: int) -> DataFrame:
    """P10: labels back to raw ids by a table (raw, label), where a label of several raw ids has one marked ``canonical``, or else the
    least; a label that the table lacks becomes ``ignore``."""
    first = F.min(F.struct((~F.coalesce("canonical", F.lit(False))).alias("_c"), F.col("raw").alias("_raw"))) if "canonical" in table.columns else F.min(F.struct(F.col("raw").alias("_raw")))
    back = table.groupBy(F.col("label").alias("_label")).agg(first.alias("_f")).select("_label", F.col("_f._raw").alias("_raw"))
    out = df.join(F.broadcast(back), F.col(label) == F.col("_label"), "left")  # at most one row a class
    return out.withColumn(label, F.coalesce("_raw", F.lit(ignore))).drop("_label", "_raw")


def match_tuples(df: DataFrame, columns: Sequence[str], table: DataFrame, target: str, other: int = -1) -> DataFrame:
    """The class of a tuple of image values, by equality with the table's columns; others get ``other``."""
    keys = table.select(*[F.col(c).alias(f"_{c}") for c in columns], F.col("class").alias("_class")).dropDuplicates([f"_{c}" for c in columns])
    on = [F.col(c) == F.col(f"_{c}") for c in columns]
    return df.join(F.broadcast(keys), on, "left").withColumn(target, F.coalesce("_class", F.lit(other))).drop("_class", *[f"_{c}" for c in columns])  # a palette's colours


#: Spellings of the annotated categories that differ from the class list.
SPELLINGS = {"trashcan": "trash can", "fridge": "refrigerator"}


def colour_hex(r: str, g: str, b: str) -> Column:
    """The six upper-case hexadecimal digits of a colour."""
    return F.concat(*[F.lpad(F.hex(F.col(c).cast("bigint")), 2, "0") for c in (r, g, b)])


def colour_instances(df: DataFrame, mapping: DataFrame, classes: DataFrame, channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Instance: the colour's place among the cloud's colours, from 0; segment: the class of the colour's category in mapping
    (hex, category), by classes (category, class), spellings put right; -1 for colours without one."""
    fixed = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    named = mapping.select(F.upper("hex").alias("_hex"), F.coalesce(F.try_element_at(fixed, F.col("category")), F.col("category")).alias("category"))
    known = named.join(classes, "category").select("_hex", F.col("class").alias("_class")).dropDuplicates(["_hex"])
    out = df.withColumn("_hex", colour_hex(*channels)).join(known, "_hex", "left")
    place = F.dense_rank().over(Window.partitionBy("cloud_id").orderBy(*channels)) - 1
    return out.withColumns({"instance": place, "segment": F.coalesce("_class", F.lit(-1))}).drop("_hex", "_class")


def check_ids(fine: DataFrame, expected: Mapping[int, str], ident: str = "fine", name: str = "name") -> DataFrame:
    """Rows (fine, expected, found) where a fine id doesn't have the name that the code relies on; empty if the check holds."""
    want = fine.sparkSession.createDataFrame(list(expected.items()), "fine int, expected string")
    own = fine.select(F.col(ident).cast("int").alias("fine"), F.col(name).alias("found"))
    return want.join(own, "fine", "left").where(~F.col("expected").eqNullSafe(F.col("found")))


def missing_inputs(splits: DataFrame, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """The clouds of a split (cloud_id, split) that an input has no rows of, with the inputs' names; the rest can be combined."""
    out = splits
    for name, df in inputs.items():
        out = out.join(df.select("cloud_id").distinct().withColumn(f"_{name}", F.lit(True)), "cloud_id", "left")
    lacking = F.array_compact(F.array(*[F.when(F.col(f"_{name}").isNull(), F.lit(name)) for name in inputs]))
    return out.select("split", "cloud_id", F.array_join(lacking, ",").alias("missing")).where("missing <> ''")


def face_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Each face's doubled-area normal, from its three corners."""
    out = faces
    for k in range(3):
        out = out.join(vertices.select("cloud_id", F.col("vertex_id").alias(f"v{k}"), *[F.col(a).alias(f"{a}{k}") for a in "xyz"]), ["cloud_id", f"v{k}"])
    d = lambda a, k: F.col(f"{a}{k}") - F.col(f"{a}0")
    cross = {"nx": d("y", 1) * d("z", 2) - d("z", 1) * d("y", 2), "ny": d("z", 1) * d("x", 2) - d("x", 1) * d("z", 2), "nz": d("x", 1) * d("y", 2) - d("y", 1) * d("x", 2)}
    return out.withColumns(cross).withColumn("area", F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2) / 2).select("cloud_id", "face_id", "v0", "v1", "v2", "nx", "ny", "nz", "area")


def vertex_normals(normals: DataFrame) -> DataFrame:
    """The unit sum of the normals of a vertex's faces, weighted by area."""
    corner = F.explode(F.array("v0", "v1", "v2")).alias("vertex_id")
    s = normals.select("cloud_id", corner, "nx", "ny", "nz").groupBy("cloud_id", "vertex_id").agg(*[F.sum(c).alias(c) for c in ("nx", "ny", "nz")])
    length = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2) + F.lit(1e-8)
    return s.withColumn("_l", length).withColumns({c: F.col(c) / F.col("_l") for c in ("nx", "ny", "nz")}).drop("_l")


def vertex_majority(faces: DataFrame, label: str) -> DataFrame:
    """A10: the commonest label of a vertex's faces, ties to the smaller, then less 1."""
    c = faces.select("cloud_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"), label).groupBy("cloud_id", "vertex_id", label).agg(F.count("*").alias("_n"))
    return c.groupBy("cloud_id", "vertex_id").agg((F.max(F.struct("_n", (-F.col(label)).alias("_l"))).getField("_l") * -1 - 1).alias("label"))


def box_edges(boxes: DataFrame) -> DataFrame:
    """The integer points on the twelve edges of boxes (id, x0, y0, z0, x1, y1, z1), each once."""
    parts = []
    for k, a in enumerate("xyz"):
        b, c = [d for d in "xyz" if d != a]
        ends = F.explode(F.array(*[F.struct(F.col(f"{b}{i}").alias("b"), F.col(f"{c}{j}").alias("c")) for i in (0, 1) for j in (0, 1)]))
        run = boxes.withColumn("_e", ends).withColumn("_t", F.explode(F.sequence(f"{a}0", f"{a}1")))
        parts.append(run.select("id", *[{a: F.col("_t"), b: F.col("_e.b"), c: F.col("_e.c")}[d].alias(d) for d in "xyz"]))
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def surface_sample_sizes(normals: DataFrame, density: float) -> DataFrame:
    """How many points to draw from each mesh: area / density^2, rounded down."""
    return normals.groupBy("cloud_id").agg(F.sum("area").alias("area")).withColumn("samples", F.floor(F.col("area") / (density * density)))


def barycentric(samples: DataFrame, corners: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attributes at samples (cloud_id, sample_id, face_id, u, v) from those of the face's three corners (k = 0, 1, 2)."""
    weight = F.when(F.col("k") == 0, 1 - F.col("u") - F.col("v")).when(F.col("k") == 1, F.col("u")).otherwise(F.col("v"))
    hit = samples.join(corners, ["cloud_id", "face_id"])
    return hit.groupBy("cloud_id", "sample_id").agg(*[F.sum(weight * F.col(c)).alias(c) for c in columns])


def vertex_label_slots(labels: DataFrame, slots: int = 3) -> DataFrame:
    """Of (cloud_id, vertex_id, ord, label, instance) each vertex's first labels in annotation order; the one of the
    smallest instance, counted by the slots that it won, goes first."""
    v = Window.partitionBy("cloud_id", "vertex_id")
    kept = labels.withColumn("_s", F.row_number().over(v.orderBy("ord"))).where(F.col("_s") <= slots)
    sized = kept.withColumn("_size", F.count("*").over(Window.partitionBy("cloud_id", "instance")))
    main = sized.withColumn("_main", F.row_number().over(v.orderBy("_size", "_s")) == 1)
    at = F.max(F.when(F.col("_main"), F.col("_s"))).over(v)
    moved = main.withColumn("slot", F.when(F.col("_main"), 1).when(F.col("_s") == 1, at).otherwise(F.col("_s")))
    return moved.select("cloud_id", "vertex_id", F.col("slot").cast("int").alias("slot"), "label", "instance")
