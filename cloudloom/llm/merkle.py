"""A Merkle manifest of a table: one binary hash tree a language, one over their roots, and a proof for each row.

1. A leaf is the SHA-256 of a row's fields. Rows are dealt by ranges of (language, doc_id), so a row's place in its tree
   is its place in its range and the sizes of the ranges before; no task holds a language.
2. Levels are built twelve at a time: 4,096 neighbours meet in one row, which stores all their levels. What a block
   comes to is a node of the next stage, until each tree has one node; these are the leaves of the tree of languages.
3. Stored nodes have a link to their ancestor twelve levels up and the siblings on the way there. A recursive query
   climbs from every leaf along those links, appends the siblings to its proof and folds the tampered leaf's hash.

A node of stage s has up to 4096^s leaves below, all of which join it; it is stored as often as it takes for 65,536 of
them to join each copy, so no key is hot, and the copies are a 65,536th of the leaves a stage.
"""

from __future__ import annotations

import contextlib
import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, materialise

#: Levels of a block, its nodes, and the rows that may climb through one copy of a node.
STRIDE = 12
WIDTH = 1 << STRIDE
CLIMBERS = 65_536
#: The tree of languages; a language's own is "=" and its name, "-" for null, which keeps their order.
TOP = "^"
RESULT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields one after another."""
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree, leaf and tampered (null where tampering changes nothing), both as 32 bytes."""
    number = F.col("n_chars").cast("decimal(38,0)")
    hashed = lambda n: F.unhex(digest(*(_field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")))))
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tree.alias("tree"), hashed(number).alias("leaf"), F.when(hit, hashed(number + 1)).alias("tampered"))


def placed(rows: DataFrame, order: list[str], keep: Scratch) -> DataFrame:
    """rows with their place (from 0) in their tree in this order, null first, and the tree's size m. Which of two equal rows comes first is open."""
    keys = [F.asc_nulls_first(k) for k in ("tree", *order)]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys)
    dealt = keep(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))  # a row's range and place in it, stored
    span = F.shiftright("_at", 33)
    whole = Window.partitionBy("tree")
    runs = dealt.groupBy("tree", span.alias("_span")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    runs = keep(runs.withColumn("_before", F.sum("_n").over(whole.orderBy("_span")) - F.col("_n")).withColumn("m", F.sum("_n").over(whole)))
    few = runs.count() <= BROADCAST_ROWS // 10  # a row for each range and each tree's begin
    out = dealt.withColumn("_span", span).join(F.broadcast(runs) if few else runs, ["tree", "_span"])
    return out.withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_span", "_n", "_first", "_before", "_at")


def _top() -> Column:
    """The one hash of a block's last level."""
    return F.unhex(F.element_at(F.element_at("levels", -1), 1))


def blocks_of(nodes: DataFrame, payload: list[str], keep: Scratch) -> DataFrame:
    """Stored blocks of 4,096 neighbours: tree, block, m (the tree's nodes at this stage), below (the leaves under the
    block), own (place, hash and payload of its nodes) and levels (hex hashes, as many levels as the tree still has)."""
    own = F.sort_array(F.collect_list(F.struct("place", "hash", *payload)))  # at most 4,096
    rows = nodes.groupBy("tree", F.shiftright("place", STRIDE).alias("block")).agg(F.first("m").alias("m"), F.sum("below").alias("below"), own.alias("own"))
    depth = F.when(F.col("m") > 1, F.least(F.lit(STRIDE), F.length(F.bin(F.col("m") - 1)))).otherwise(0)
    built = f"""
        aggregate(slice(sequence(1, {STRIDE}), 1, depth), array(transform(own, x -> lower(hex(x.hash)))), (built, l) -> concat(built, array(
          transform(sequence(0, cast((size(element_at(built, -1)) + 1) div 2 as int) - 1), i ->
            sha2(concat(get(element_at(built, -1), 2 * i), coalesce(get(element_at(built, -1), 2 * i + 1), '')), 256)))))"""
    return keep(rows.withColumn("depth", depth).withColumn("levels", F.expr(built)))


def _stages(nodes: DataFrame, payload: list[str], keep: Scratch) -> list[DataFrame]:
    """Blocks of each stage, until every tree has come to one node."""
    built = [blocks_of(nodes, payload, keep)]
    while not (rest := built[-1].where(F.col("m") > WIDTH)).isEmpty():
        up = rest.select("tree", F.col("block").alias("place"), F.ceil(F.col("m") / WIDTH).alias("m"), "below", _top().alias("hash"))
        built.append(blocks_of(up, ["below"], keep))
    return built


def _roots(built: list[DataFrame]) -> DataFrame:
    """tree, hash and below of the trees' roots."""
    ended = [b.where(F.col("m") <= WIDTH).select("tree", _top().alias("hash"), "below") for b in built]
    return functools.reduce(DataFrame.unionByName, ended)


def linked(blocks: DataFrame, stage: int, ends: DataFrame | None) -> DataFrame:
    """For each node of the blocks: own, path (for each level up to its ancestor, the sibling or null and whether it is on
    the left), top (the ancestor's hash if it is its tree's root) and the link to_tree, to_stage, to_place, to_copies.
    ends: name and place of the trees in the tree of languages; None for that tree itself, where links end."""
    last = F.col("m") <= WIDTH
    up = blocks.where(~last).select("*", F.col("tree").alias("to_tree"), F.lit(stage + 1).alias("to_stage"), F.col("block").alias("to_place"))
    if ends is None:
        done = blocks.where(last).select("*", F.lit(None).cast("string").alias("to_tree"), F.lit(0).alias("to_stage"), F.lit(0).cast("bigint").alias("to_place"))
    else:
        done = blocks.where(last).join(ends.select(F.col("name").alias("tree"), F.lit(TOP).alias("to_tree"), F.lit(0).alias("to_stage"), F.col("place").alias("to_place")), "tree")
    path = f"transform(slice(sequence(0, {STRIDE - 1}), 1, depth), l -> named_struct('sibling', get(levels[l], shiftright(i, l) ^ 1), 'left', shiftright(i, l) & 1 = 1))"
    rows = up.unionByName(done).withColumn("node", F.explode(F.expr(f"transform(own, (x, i) -> named_struct('own', x, 'path', {path}))")))
    top = F.when(last & F.lit(ends is not None), _top())
    return rows.select("tree", F.lit(stage).alias("stage"), "node.own", "node.path", top.alias("top"), "to_tree", "to_stage", "to_place", F.ceil(F.col("below") / CLIMBERS).cast("int").alias("to_copies"))


_FOLD = """aggregate({path}, {start}, (h, s) -> unhex(sha2(CASE WHEN s.sibling IS NULL THEN lower(hex(h))
  WHEN s.left THEN concat(s.sibling, lower(hex(h))) ELSE concat(lower(hex(h)), s.sibling) END, 256)))"""
_PROOF = "unhex(concat_ws('', transform({path}, s -> s.sibling)))"
CLIMB = f"""
WITH RECURSIVE climb(doc_id, leaf, place, subroot, proof, folded, to_tree, to_stage, to_place, to_copies) AS (
  SELECT own.doc_id, own.hash, own.place, top, {_PROOF.format(path="path")}, {_FOLD.format(path="path", start="coalesce(own.tampered, own.hash)")},
    to_tree, to_stage, to_place, to_copies
  FROM {{leaves}}
  UNION ALL
  SELECT c.doc_id, c.leaf, c.place, coalesce(c.subroot, n.top), concat(c.proof, {_PROOF.format(path="n.path")}), {_FOLD.format(path="n.path", start="c.folded")},
    n.to_tree, n.to_stage, n.to_place, n.to_copies
  FROM climb c JOIN {{nodes}} n ON n.tree = c.to_tree AND n.stage = c.to_stage AND n.place = c.to_place AND n.copy = pmod(c.place, c.to_copies)
)
SELECT doc_id, lower(hex(leaf)) AS leaf, lower(hex(subroot)) AS subroot, sha2(lower(hex(proof)), 256) AS proof_sha256, lower(hex(folded)) AS folded_root
FROM climb WHERE to_tree IS NULL
"""


@contextlib.contextmanager
def _any_number_of_rows(spark):
    """Recursive queries stop at a million rows unless told otherwise."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root folded from its tampered leaf.

    Reads doc_id, source, lang, n_chars and text alone. Null fields count as "-". Leaves ascend by doc_id, null first,
    then by hash; rows alike in all five fields have the same leaf but a place each. Rows of a null doc_id or n_chars
    aren't tampered with. An empty table gives no rows.
    """
    spark, keep = docs.sparkSession, Scratch()
    rows = placed(leaves(docs), ["doc_id", "leaf"], keep)
    built = _stages(rows.withColumnRenamed("leaf", "hash").withColumn("below", F.lit(1).cast("bigint")), ["doc_id", "tampered"], keep)
    ends = placed(_roots(built).select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "hash", "below"), ["name"], keep)
    tops = _stages(ends, ["below"], keep)
    root = _roots(tops).first()
    if root is None:
        return spark.createDataFrame([], RESULT)

    upper = [linked(b, s, ends) for s, b in enumerate(built)][1:] + [linked(b, s, None) for s, b in enumerate(tops)]
    nodes = functools.reduce(DataFrame.unionByName, upper).withColumn("place", F.col("own.place"))
    nodes = keep(nodes.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("own.below") / CLIMBERS).cast("int") - 1))).drop("own"))
    with _any_number_of_rows(spark):
        out = materialise(spark.sql(CLIMB, leaves=linked(built[0], 0, ends), nodes=nodes))
    keep.clear()
    root = F.lit(bytes(root["hash"]).hex())
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
